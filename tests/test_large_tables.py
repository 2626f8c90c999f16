"""Queries on tables that the small ones don't hold: parts without line items, copies of rows, dense graphs."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest

from causalake.functions import proteins as FP
from causalake.operators import causal as C
from causalake.operators import molecules as M
from causalake.operators import paths as PA
from causalake.plans import catalog
from tests.conftest import rows, sql_rows
from tests.test_nearest_drugs import brute, words


def given(spark, folder, source, **tables):
    """The small tables in another folder, some of them replaced by SQL over the small ones; and a connection to them."""
    c = duckdb.connect()
    for t in "region nation supplier part lineitem".split():
        c.sql(f"copy (select * from ({tables.get(t, f'select * from {t}')})) to '{folder}/{t}.parquet'".replace(f"from {t}", f"from '{source}/{t}.parquet'"))
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), c


def same(spark, folder, c, name):
    df = catalog.QUERIES[name](spark, folder)
    assert rows(df) == sql_rows(c, catalog.ORACLES[name], df.columns)


def test_entries_without_structures(spark, sf, tmp_path):
    folder, c = given(spark, tmp_path, sf, lineitem="select * from lineitem where l_partkey % 2 = 0")
    assert c.sql("select count(*) from part where p_partkey % 2 = 1 and p_size % 4 <> 0 and p_size % 5 = 0 and p_size % 7 <> 0").fetchall()[0][0]
    same(spark, folder, c, "protein_entries")


def test_residues_of_repeated_parts(spark, sf, tmp_path):
    folder, c = given(spark, tmp_path, sf, part="select * from part union all select * from part where p_partkey < 50")
    same(spark, folder, c, "residue_forms")


def dense(spark, n=140, seed=5):
    """Graphs over several blocks of places, with repeated edges of all kinds."""
    r = random.Random(seed)
    kinds = [("activates", "literature"), ("interacts_with", "literature"), ("associated_with", "genetic_association"), ("associated_with", "literature")]
    held = [(g, f"n{r.randrange(n)}", f"n{r.randrange(n)}", *r.choice(kinds)) for g in "ab" for _ in range(n * (12 if g == "a" else 1)) for _ in range(2)]
    return held, spark.createDataFrame(held, "graph_id string, source_id string, target_id string, edge_type string, evidence_class string")


def hops_from(pairs, start):
    far, level = {start: 0}, [start]
    while level:
        level = list(dict.fromkeys(b for a in level for b in pairs.get(a, ()) if b not in far))
        far |= dict.fromkeys(level, max(far.values()) + 1)
    return far


def test_reachable_over_blocks(spark):
    held, e = dense(spark)
    starts = spark.createDataFrame([("a", "n1"), ("a", "n77"), ("b", "n1"), ("b", "n139"), ("b", "away")], "graph_id string, treatment string")
    got = {(r.graph_id, r.treatment, r.node): r.hops for r in PA.reachable(e, starts).collect()}
    expected = {}
    for g, s in [tuple(r) for r in starts.collect()]:
        pairs = {}
        for h in held:
            if h[0] == g:
                pairs.setdefault(h[1], []).append(h[2])
        expected |= {(g, s, n): h for n, h in hops_from(pairs, s).items()}
    assert got == expected and ("b", "away", "away") in got
    near = {k: v for k, v in expected.items() if v <= 1}
    assert {(r.graph_id, r.treatment, r.node): r.hops for r in PA.reachable(e, starts, 1).collect()} == near


def test_near_misses_over_blocks(spark):
    held, e = dense(spark)
    up = {h[:3] for h in held if h[3] == "activates" and h[1] != h[2]}
    weak = {h[:3] for h in held if h[1] != h[2] and (h[3] == "interacts_with" or h[3:] == ("associated_with", "literature"))}
    expected = Counter((g, t, o) for g, r, t in up for g2, r2, o in weak if (g, r) == (g2, r2) and t != o)
    got = {(r.graph_id, r.treatment, r.outcome): r.n for r in C.near_misses(e).collect()}
    assert got == dict(expected)


def test_counterfactuals_together(spark, monkeypatch):
    monkeypatch.setattr(C, "TREATED", 3)
    walks = []
    for edges in ([("a", "c", 1.0), ("b", "c", 3.0), ("c", "D", 0.5), ("b", "D", 0.5)], [("a", "b", 1.0), ("b", "a", 1.0), ("b", "D", 2.0), ("c", "D", 0.0)]):
        e = spark.createDataFrame([("g", *x) for x in edges], "graph_id string, source_id string, target_id string, weight double")
        n = spark.createDataFrame([("g", "a", 0.8), ("g", "b", None), ("g", "c", 0.4)], "graph_id string, node_id string, score double")
        p = spark.createDataFrame([("g", x, "D") for x in "abcDz"] + [("g", "a", "away")], "graph_id string, treatment string, outcome string")
        walks.append({(r.treatment, r.outcome): (r.factual, r.counterfactual) for r in C.counterfactual(e, n, p).collect()})
    first, loop = walks
    c = (0.8 + 3 * 0.5) / 4
    assert first["a", "D"] == ((c + 0.5) / 2, (1.5 / 4 + 0.5) / 2) and first["c", "D"][1] == 0.25 and first["D", "D"][1] == 0.0
    assert first["z", "D"] == (first["a", "D"][0],) * 2 and first["a", "away"] == (None, None)
    # In name order D comes first, before its parents have values; c's edge weighs nothing.
    assert loop["a", "D"] == loop["b", "D"] == (0.5, 0.5) and loop["D", "D"] == (0.5, 0.0) and len(loop) == 6


def test_isoelectric_points_of_arrays(spark):
    def by_hand(s):
        low, high = 0.0, 14.0
        for _ in range(40):
            mid = (low + high) / 2
            q = 1 / (1 + 10 ** (mid - FP.N_TERM)) - 1 / (1 + 10 ** (FP.C_TERM - mid))
            q += sum(s.count(k) / (1 + 10 ** (mid - v)) for k, v in FP.BASE.items()) - sum(s.count(k) / (1 + 10 ** (v - mid)) for k, v in FP.ACID.items())
            q = round(q, 3)
            if abs(q) < 0.01:
                break
            low, high = (mid, high) if q > 0 else (low, mid)
        return round((low + high) / 2, 2)

    r = random.Random(4)
    given_ = ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(r.randrange(60))) for _ in range(300)] + ["D" * 5_000, "K" * 5_000]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given_)] + [(-1, None)], "i int, s string").select("i", FP.isoelectric_point("s").alias("p"))
    got = {x.i: x.p for x in df.collect()}
    assert got.pop(-1) is None and all(got[i] == pytest.approx(by_hand(s), abs=0.0101) for i, s in enumerate(given_))
    # No expression is walked 40 times a row.
    assert "aggregate(" not in df._jdf.queryExecution().toString() and sum(got[i] == by_hand(s) for i, s in enumerate(given_)) > 295


def test_nearest_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 40)
    monkeypatch.setattr(M, "ASKED", 7)
    r = random.Random(2)
    held = [(i, words(r.sample(range(128), r.randrange(60)), 2)) for i in range(150)]
    df = spark.createDataFrame(held, "id long, fp array<long>")
    got = {(x.query_id, x["rank"]): (x.reference_id, x.similarity) for x in M.nearest(df.where("id % 8 = 0"), df, 4).collect()}
    assert got == brute([h for h in held if h[0] % 8 == 0], held, 4)
