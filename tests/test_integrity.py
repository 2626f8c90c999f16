"""Digests of runs, records and integrity findings."""

from __future__ import annotations

from causalake.operators import integrity as I

ROWS = [("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", 1, ""), ("b", None, "y"), (None, 1, "z")]
SCHEMA = "run string, n int, v string"


def digests(spark, rows, parts=1):
    return {r.run: (r.n_rows, r.digest) for r in I.run_digests(spark.createDataFrame(rows, SCHEMA).repartition(parts), ["n", "v"]).collect()}


def test_digest_of_a_multiset(spark):
    base = digests(spark, ROWS)
    assert digests(spark, ROWS[::-1], 5) == base and len(base) == 3
    assert digests(spark, [("a", 1, "x"), ("a", 2, None)])["a"] != base["a"]  # a repeated row counts
    assert digests(spark, [("b", 1, None), ("b", None, "y")])["b"] != base["b"]  # null isn't empty
    assert digests(spark, [("a", 1, "y"), *ROWS[1:]])["a"] != base["a"] and digests(spark, [("a", 1, "y"), *ROWS[1:]])["b"] == base["b"]
    assert digests(spark, []) == {}


def test_finalised(spark):
    runs = [("a", "complete", False, False), ("b", "complete", True, False), ("c", "failed", False, False), ("d", "odd", False, False), ("e", "complete", False, False), ("f", "complete", False, True)]
    runs = spark.createDataFrame(runs, "run string, status string, git_dirty boolean, allow_large boolean")
    rows = spark.createDataFrame([*ROWS, ("e", 1, "w" * 500), ("f", 1, "w" * 500)], SCHEMA)
    got = {r.run: r for r in I.finalised(runs, rows, ["n", "v"], most_bytes=400).collect()}
    assert {r: (x.citable, x.refused) for r, x in got.items()} == {"a": (True, None), "b": (False, None), "c": (False, None), "d": (False, "unknown status"), "e": (False, "too large"), "f": (True, None)}
    assert got["c"].n_rows == 0 and got["c"].digest and got["e"].digest is None and got["a"].n_rows == 3


def test_findings(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    now = {r.run: r for r in I.run_digests(rows, ["n", "v"]).collect()}
    kept = [("a", True, 3, now["a"].digest), ("b", False, 3, now["b"].digest), ("gone", True, 1, "0"), ("old", True, 0, None)]
    records = spark.createDataFrame(kept, "run string, citable boolean, n_rows long, digest string")
    got = sorted((str(r.run), r.finding) for r in I.integrity_findings(records, rows, ["n", "v"]).collect())
    assert got == [("None", "no record"), ("b", "not citable"), ("b", "rows"), ("gone", "digest"), ("gone", "rows"), ("old", "no digest")]
    tracked = spark.createDataFrame([("a",)], "run string")
    assert ("b", "not citable") not in {(r.run, r.finding) for r in I.integrity_findings(records, rows, ["n", "v"], tracked).collect()}
    edited = spark.createDataFrame([("a", 1, "w"), *ROWS[1:]], SCHEMA)  # as many rows, one changed
    assert [(r.finding, r.expected == now["a"].digest) for r in I.integrity_findings(records.where("run = 'a'"), edited.where("run = 'a'"), ["n", "v"]).collect()] == [("digest", True)]


def test_empty_run_has_the_empty_digest(spark):
    runs = spark.createDataFrame([("x", "complete", False, False)], "run string, status string, git_dirty boolean, allow_large boolean")
    rows = spark.createDataFrame([], SCHEMA)
    record = I.finalised(runs, rows, ["n", "v"])
    assert I.integrity_findings(record, rows, ["n", "v"]).collect() == []
