"""Keys, flags and lists in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def match_key(x) -> Column:
    """The identity of a symbol or node id: outer white space dropped, lower case."""
    return F.lower(F.regexp_replace(col(x), r"^\s+|\s+$", ""))


def flag(x) -> Column:
    """Text of a flag column: 1 and true (any case) are true; anything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(col(x).cast("string"))).isin("1", "true"), F.lit(False))


def split_list(x, separator: str = ";") -> Column:
    """The non-empty parts of a joined list; null gives an empty one."""
    parts = F.split(F.coalesce(col(x), F.lit("")), "[" + separator.replace("\\", "\\\\") + "]" if len(separator) == 1 else separator)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def pubmed_ids(x) -> Column:
    """The numeric ends of `label:id` references, distinct and sorted."""
    tails = F.transform(split_list(x, ";"), lambda p: F.substring_index(p, ":", -1))
    return F.array_sort(F.array_distinct(F.filter(tails, lambda p: p.rlike("^[0-9]+$"))))


def strip_tags(x) -> Column:
    return F.regexp_replace(col(x), "<[^>]+>", "")


def name_tokens(x) -> Column:
    """A gene name and its parts between - and /, as keys."""
    key = match_key(x)
    return F.array_distinct(F.concat(F.array(key), F.filter(F.split(key, "[-/]"), lambda p: p != "")))


def cache_key(**parts) -> Column:
    """16 hex digits that identify a set of named parameters."""
    fields = [col(v).alias(k) for k, v in sorted(parts.items())]
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16)


def starts_with_any(x, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | col(x).startswith(p)
    return out


def first_containing(x, table: dict[str, object], otherwise=None) -> Column:
    """The value of the first key of an ordered dictionary that the text contains."""
    text, out = F.lower(col(x)), None
    for k, v in table.items():
        out = F.when(text.contains(k), F.lit(v)) if out is None else out.when(text.contains(k), F.lit(v))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)
