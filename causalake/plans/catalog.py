"""All named queries and the SQL that checks them."""

from __future__ import annotations

from . import associations, services, systems, targets

QUERIES = dict(associations.Q) | dict(targets.Q) | dict(systems.Q) | dict(services.Q)
ORACLES = dict(associations.SQL) | dict(targets.SQL) | dict(systems.SQL) | dict(services.SQL)
