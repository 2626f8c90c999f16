"""Exact neighbours by Tanimoto similarity: all rows, sparse and dense fingerprints, ties, too few rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from causalake.functions import molecules as FM
from causalake.operators import molecules as M
from causalake.plans import projections as P
from causalake.plans import systems as T

FP = "id long, fp array<long>"


def test_nearest_among_all(spark, sf):
    e = P.table(spark, sf, "embeddings").select(F.col("vec_id").alias("r"), FM.sign_bits("embedding").alias("b"))
    q = e.where("r % 100 = 0").toDF("q", "a")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "r")
    all_pairs = q.crossJoin(e).where("q <> r").withColumn("s", F.round(FM.tanimoto("a", "b"), 4)).withColumn("n", F.row_number().over(order)).where("n <= 5")
    expected = {(x.q, x.n, x.r) for x in all_pairs.collect()}
    got = {(x.query_id, x["rank"], x.reference_id) for x in T.Q["nearest_drugs"](spark, sf).collect()}
    assert got == expected


def brute(queries, reference, k):
    out = {}
    for q, a in queries:
        a = a or []
        sims = []
        for r, b in reference:
            b = b or [0] * len(a)
            both = sum((x & y & (2**64 - 1)).bit_count() for x, y in zip(a, b))
            every = sum(((x | y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))
            sims.append((-math.floor(both / every * 1e4 + 0.5) / 1e4 if every else 0.0, r))
        for n, (s, r) in enumerate(sorted(sims)[:k]):
            out[q, n + 1] = (r, -s)
    return out


def words(bits, n):
    w = [0] * n
    for b in bits:
        w[b // 64] |= 1 << (b % 64)
    return [x - 2**64 if x >= 2**63 else x for x in w]


@pytest.mark.parametrize(("seeds", "k"), [(2000, 5), (10, 4), (0, 3)])
def test_equals_all_pairs(spark, monkeypatch, seeds, k):
    monkeypatch.setattr(M, "SEEDS", seeds)
    r = random.Random(k)
    families = [r.sample(range(512), 40) for _ in range(6)]
    rows = []
    for i in range(150):  # families of near copies, many ties, a bit that all share, rows without bits
        bits = {b for b in r.choice(families) if r.random() < 0.8} | {7}
        rows.append((i, words(bits if i % 20 else [], 8)))
    rows.append((900, None))
    rows += [(1000 + i, words([500 + i % 3], 8)) for i in range(5)]
    queries = rows[::7] + [(2000, words([511], 8)), (2001, words([], 8)), (2002, words(range(512), 8))]
    got = {(x.query_id, x["rank"]): (x.reference_id, x.similarity) for x in M.nearest(spark.createDataFrame(queries, FP), spark.createDataFrame(rows, FP).repartition(3), k).collect()}
    assert got == brute(queries, rows, k)


def test_few_candidates(spark):
    """Sparse fingerprints: of 20,000 rows few are compared with a query."""
    r = random.Random(1)
    rows = [(i, words(r.sample(range(2048), 30), 32)) for i in range(3000)]
    near = [(5000 + i, words([*range(i, i + 30)], 32)) for i in range(5)]
    ref = spark.createDataFrame(rows + near, FP)
    got = M.nearest(spark.createDataFrame([(1, words(range(30), 32))], FP), ref, 3).orderBy("rank").collect()
    assert [x.reference_id for x in got] == [5000, 5001, 5002]


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, [3])], FP), spark.createDataFrame([], FP)
    assert M.nearest(none, some, 2).collect() == [] and M.nearest(some, none, 2).collect() == []
