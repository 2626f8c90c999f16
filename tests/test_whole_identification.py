"""The search for adjustment sets without bounds: of any size, over all nodes that the treatment doesn't reach."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from causalake.operators import causal as C
from causalake.plans import discovery
from tests import graph_brute as B
from tests.test_identification import frames

PAIR = "graph_id string, treatment string, outcome string"


def dense(n, seed=7):
    """Random acyclic graphs in which the treatment has many causes and the outcome few."""
    r = random.Random(seed)
    for i in range(n):
        names = [f"n{k:02d}" for k in range(r.randrange(7, 11))]
        x, y = names[-3], names[-1]
        es = [(a, b, "causes", "") for a, b in combinations(names, 2) if r.random() < (0.6 if b == x else 0.25 if b == y else 0.35) and (a, b) != (x, y)]
        r.shuffle(names)
        yield f"g{i}", [*es, (x, y, "causes", "")], {v: r.choice([0.0, 0.1, 0.5, 0.9]) for v in names if r.random() < 0.8}, x, y


@pytest.mark.parametrize("pool", [None, 5])
def test_least_sets_equal_brute_force(spark, pool):
    held = list(dense(60 if pool is None else 25))
    edges, nodes = frames(spark, [h[:3] for h in held])
    pairs = spark.createDataFrame([(g, x, y) for g, _, _, x, y in held], PAIR)
    got = {r.graph_id: r for r in C.identification(edges, nodes, pairs, None, pool).collect()}
    sizes, reasons = set(), set()
    for g, es, scores, x, y in held:
        want = B.identify(es, scores, x, y, 99, pool or 99)
        assert {k: got[g][k] for k in want if k != "truncated"} == {k: v for k, v in want.items() if k != "truncated"}, g
        sizes.add(len(want["adjustment_set"]))
        reasons.add(want["reason"])
    assert max(sizes) > 3
    assert ("no_valid_adjustment_set" in reasons) == (pool is not None)


def test_sets_of_many_and_ways_turned_back(spark):
    shared = [(f"u{i}", e, "causes", "") for i in range(5) for e in "xy"]
    # Trails of three members that share none: a set has one of each, the best of it.
    trails = [e for i in range(4) for e in ((f"b{i}", f"a{i}", "causes", ""), (f"a{i}", "x", "causes", ""), (f"b{i}", f"c{i}", "causes", ""), (f"c{i}", "y", "causes", ""))]
    best = {f"{'abc'[i % 3]}{i}": 0.9 - i / 10 for i in range(4)}
    # The shortest way, by p and q, crosses both others: a second way turns it back.
    turned = [("p", "x", "causes", ""), ("q", "p", "causes", ""), ("q", "y", "causes", ""), ("r", "x", "causes", ""), ("s", "r", "causes", ""), ("q", "s", "causes", ""), ("t", "p", "causes", ""), ("t", "w", "causes", ""), ("w", "y", "causes", "")]
    # Twenty better nodes that close nothing.
    far = [(f"z{i:02d}", "v", "causes", "") for i in range(22)] + [("v", "y", "causes", ""), ("u", "x", "causes", ""), ("u", "y", "causes", "")]
    direct = [("x", "y", "causes", "")]
    held = [("shared", shared + direct, {}), ("trails", trails + direct, best), ("turned", turned + direct, {}), ("far", far + direct, {f"z{i:02d}": 0.9 for i in range(22)})]
    edges, nodes = frames(spark, held)
    pairs = spark.createDataFrame([(g, "x", "y") for g, _, _ in held], PAIR)
    got = {r.graph_id: r for r in C.identification(edges, nodes, pairs, None, None).collect()}
    assert got["shared"].adjustment_set == [f"u{i}" for i in range(5)]
    assert got["trails"].adjustment_set == list(best)
    assert got["turned"].adjustment_set == B.identify(turned + direct, {}, "x", "y", 99, 99)["adjustment_set"]
    assert got["far"].adjustment_set == ["u"]
    assert all(r.reason == "identifiable_by_adjustment" and not r.truncated for r in got.values())


def test_ranked_targets_adjust_for_all(spark):
    """A target with five regulators that all lead to the disease, and one whose only regulator is the 25th by score."""
    assoc = [("t%02d" % i, "G%02d" % i, "d", "genetic_association", 0.99 - i / 100) for i in range(25)]
    acts = [(f"G{i:02d}", "G00") for i in range(1, 6)] + [("G24", "G01")]
    a = spark.createDataFrame(assoc, "target_id string, target_symbol string, disease_id string, datatype string, score double")
    i = spark.createDataFrame([(x, y, True, True, True, False, "S1;S2", "PM:1", f"{k}") for k, (x, y) in enumerate(acts)], "source_symbol string, target_symbol string, is_directed boolean, consensus_direction boolean, is_stimulation boolean, is_inhibition boolean, primary_sources string, references string, ord string")
    got = {r["name"]: r for r in discovery.ranked_targets(*discovery.disease_graphs(a, i), n=25).collect()}
    assert got["G00"].reason == got["G01"].reason == "identifiable_by_adjustment"
    assert len(got["G00"].adjustment_set) == 5 and len(got["G01"].adjustment_set) == 1
