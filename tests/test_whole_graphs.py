"""The graph queries cover all edges of the tables, cycles included."""

from __future__ import annotations

from collections import defaultdict

from causalake.plans import targets as T
from causalake.plans.associations import COLLISIONS_SQL
from tests.graph_brute import is_admissible


def resolved(duck):
    return duck.sql(f"WITH {COLLISIONS_SQL} SELECT graph_id, source_id, target_id, edge_type, evidence_class FROM resolved").fetchall()


def cyclic(pairs):
    """Nodes that reach themselves."""
    children = defaultdict(set)
    for a, b in pairs:
        children[a].add(b)
    out = set()
    for n in list(children):
        seen, stack = set(), list(children[n])
        while stack:
            if (x := stack.pop()) not in seen:
                seen.add(x)
                stack += children.get(x, ())
        out |= {n} & seen
    return out


def test_all_edges(spark, sf, duck):
    edges = resolved(duck)
    nodes = {(g, x) for g, a, b, _, _ in edges for x in (a, b)}
    held = defaultdict(list)
    for g, a, b, t, c in edges:
        if is_admissible(t, c):
            held[g].append((a, b))
    loops = {(g, n) for g, pairs in held.items() for n in cyclic(pairs)}
    assert loops and {(r.graph_id, r.node_id) for r in T.Q["cyclic_components"](spark, sf).collect()} == loops
    assert {(r.graph_id, r.node_id) for r in T.Q["betweenness"](spark, sf).collect()} == nodes
    assert {(r.graph_id, r.node_id) for r in T.Q["pagerank"](spark, sf).collect()} == nodes
    assert {(r.graph_id, r.treatment) for r in T.Q["counterfactual"](spark, sf).collect()} == nodes
    _, e, pairs = T.disease_graph(spark, sf)
    assert e.where("target_id <> 'D'").count() == len(edges) and pairs.count() == len(nodes)
