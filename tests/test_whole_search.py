"""Searches without a bound, from either end, and pagerank to a tolerance."""

from __future__ import annotations

import pytest

from causalake.operators import paths as PA
from causalake.plans import targets as T


def test_long_paths(spark):
    chain = [("g", f"n{i}", f"n{i + 1}", 0.9, "S") for i in range(8)]
    e = spark.createDataFrame(chain, "graph_id string, source_id string, target_id string, weight double, source_db string")
    pairs = lambda rows: spark.createDataFrame([("g", *r) for r in rows], "graph_id string, treatment string, outcome string")
    got = {r.treatment: r for r in PA.path_strength(e, pairs([("n0", "n8"), ("n3", "n8"), ("n8", "n8")])).collect()}  # from the end
    assert got["n0"].path_strength == pytest.approx(0.9**8 / 9) and got["n0"].path == [f"n{i}" for i in range(9)]
    assert got["n3"].path_strength == pytest.approx(0.9**5 / 6) and got["n8"].path_strength == 0
    assert PA.path_strength(e, pairs([("n0", "n8"), ("n0", "n7")])).where("outcome = 'n8'").first().hops == 8  # from the start


def test_pagerank_converges(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "a")]
    nodes = sorted({x for e in edges for x in e})
    rank = dict.fromkeys(nodes, 1 / 6)
    for _ in range(500):
        out = {n: [b for a, b in edges if a == n] for n in nodes}
        loose = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / 6 + 0.85 * (sum(rank[a] / len(out[a]) for a in nodes if n in out[a]) + loose / 6) for n in nodes}
    got = PA.pagerank(spark.createDataFrame([("g", *e) for e in edges], "graph_id string, source_id string, target_id string")).collect()
    assert sum(abs(r["rank"] - rank[r.node_id]) for r in got) < 1e-4


def test_ranked_targets_whole(spark, sf, monkeypatch):
    from causalake.plans import discovery

    seen = {}
    monkeypatch.setattr(discovery, "disease_graphs", lambda *a: seen.update(graphs=a[2:]) or (None, None))
    monkeypatch.setattr(discovery, "ranked_targets", lambda *a, **k: seen.update(caps=a[2:], **k))
    T.Q["ranked_targets"](spark, sf)
    assert seen["graphs"] == () and seen["caps"] == ()  # the operators' own defaults
    f = seen["facts"]
    assert f.select("target_type").distinct().count() > 1 and f.select("tractable").distinct().count() == 2
    assert f.count() == f.select("graph_id", "name").distinct().count()
