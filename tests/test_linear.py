"""Moments, PC discovery and linear models against numpy, brute force and planted systems."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest

from causalake.operators import linear as L


def frame(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(3)


def planted(n, seed, links, k):
    """Linear system: links {(i, j): weight} with i < j."""
    r = np.random.default_rng(seed)
    x = np.zeros((n, k))
    for j in range(k):
        x[:, j] = r.normal(size=n) + sum(w * x[:, i] for (i, b), w in links.items() if b == j)
    return x


def brute_skeleton(x, alpha):
    """PC by the definition: residuals of regressions in place of inverted blocks."""
    n, k = x.shape
    limit = NormalDist().inv_cdf(1 - alpha / 2)
    adj = {i: set(range(k)) - {i} for i in range(k)}

    def apart(i, j, given):
        z = np.column_stack([np.ones(n), *(x[:, g] for g in given)])
        a, b = (x[:, c] - z @ np.linalg.lstsq(z, x[:, c], rcond=None)[0] for c in (i, j))
        return np.sqrt(n - len(given) - 3) * abs(np.arctanh(np.corrcoef(a, b)[0, 1])) < limit

    sets, level = {}, 0
    while any(len(adj[i] - {j}) >= level for i in adj for j in adj[i]):
        gone = {}
        for i, j in combinations(range(k), 2):
            if j in adj[i]:
                tries = {s for a, b in ((i, j), (j, i)) for s in combinations(sorted(adj[a] - {b}), level)}
                held = [s for s in sorted(tries) if apart(i, j, s)]
                if held:
                    gone[i, j] = held[0]
        for i, j in gone:
            adj[i].discard(j)
            adj[j].discard(i)
        sets |= gone
        level += 1
    return {(i, j) for i in adj for j in adj[i] if i < j}, sets


def test_moments(spark):
    x = planted(500, 1, {(0, 1): 2.0}, 4) + np.array([1e8, 0, 5, 0])
    names = ["a.x", "b", "c", "d"]
    df = frame(spark, x, names)
    df = df.union(spark.createDataFrame([(None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0)], df.schema))
    got = {(r.a, r.b): r.covariance for r in L.covariances(L.moments(df, names)).collect()}
    want = np.cov(x.T)
    for i, j in combinations(range(4), 2):
        assert got[names[i], names[j]] == pytest.approx(want[i, j], rel=1e-6, abs=1e-6)
    assert L.moments(df.limit(0), names).agg({"n": "max"}).first()[0] in (0, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_skeleton_equals_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    links = {(i, j): r.choice([-1.0, 0.8]) for i, j in combinations(range(6), 2) if r.random() < 0.4}
    x = planted(800, seed, links, 6)
    names = [f"v{i}" for i in range(6)]
    edges, parted = L.skeleton(frame(spark, x, names), names)
    want, sets = brute_skeleton(x, 0.05)
    assert {(r.a, r.b) for r in edges.collect()} == {(names[i], names[j]) for i, j in want}
    assert {(r.a, r.b): r.given for r in parted.collect()} == {(names[i], names[j]): [names[g] for g in s] for (i, j), s in sets.items()}


def test_orientation(spark):
    # a -> c <- b, c -> d: a collider, and Meek's first rule.
    x = planted(4000, 7, {(0, 2): 1.0, (1, 2): 1.0, (2, 3): 1.0}, 4)
    got = {(r.source, r.target, r.directed) for r in L.discovered(frame(spark, x, list("abcd")), list("abcd"), 0.001).collect()}
    assert got == {("a", "c", True), ("b", "c", True), ("c", "d", True)}
    # A chain has no collider: nothing is directed.
    x = planted(4000, 8, {(0, 1): 1.0, (1, 2): 1.0}, 3)
    got = {(r.source, r.target, r.directed) for r in L.discovered(frame(spark, x, list("abc")), list("abc"), 0.001).collect()}
    assert got == {("a", "b", False), ("b", "c", False)}


def test_constant_column_has_no_edges(spark):
    x = planted(300, 3, {(0, 1): 1.0}, 3)
    x[:, 2] = 5.0
    edges, _ = L.skeleton(frame(spark, x, list("abc")), list("abc"))
    assert [(r.a, r.b) for r in edges.collect()] == [("a", "b")]


def test_model(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 3)) + [100, 0, 0]
    nxt = np.column_stack([2 * x[:, 0] - x[:, 2] + 3, 0.5 * x[:, 1] + r.normal(size=600)])
    df = frame(spark, np.column_stack([x, nxt]), ["s0", "s1", "a0", "n0", "n1"])
    m = L.LinearModel.fit(df, {"s0": ["s0", "a0"], "s1": []}, {"s0": "n0", "s1": "n1"})
    assert m.weights["s0"] == pytest.approx({"s0": 2, "a0": -1}) and m.constants["s0"] == pytest.approx(3)
    slope = np.polyfit(x[:, 1], nxt[:, 1], 1)
    assert m.weights["s1"]["s1"] == pytest.approx(slope[0]) and m.constants["s1"] == pytest.approx(slope[1])
    row = spark.createDataFrame([(1.0, 2.0, 3.0)], "s0 double, s1 double, a0 double")
    assert row.select(m.predict()["s0"]).first()[0] == pytest.approx(2)
    held = row.select(*(c.alias(t) for t, c in m.predict({"a0": 0.0, "s1": 9.0}).items())).first()
    assert (held.s0, held.s1) == (pytest.approx(5), 9.0)
    got = {(x.source, x.target): x for x in m.strengths(spark).collect()}
    assert got["a0", "s0"].strength == pytest.approx((5**0.5 + 3) / 2) and got["a0", "s0"].weight == pytest.approx(-1)
    twice = L.LinearModel.fit(df.withColumn("b0", df.a0), {"s0": ["s0", "a0", "b0"]}, {"s0": "n0"})
    assert twice.weights["s0"]["a0"] == pytest.approx(-0.5)
