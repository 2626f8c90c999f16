"""Set-wise identification, components and betweenness against brute force on many small graphs at once."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import pytest

from causalake.operators import causal as C
from causalake.operators import components as CO
from causalake.operators import graph as G
from tests import graph_brute as B

EDGE = "graph_id string, source_id string, target_id string, edge_type string, evidence_class string"
KINDS = [("activates", ""), ("causes", ""), ("associated_with", "genetic_association"), ("associated_with", "literature"), ("interacts_with", None)]


def graphs(n, seed=1):
    """Random graphs, most of them acyclic but for one or two edges back."""
    r = random.Random(seed)
    for i in range(n):
        names = [f"n{k:02d}" for k in range(r.randrange(3, 13))]
        edges = []
        for a, b in combinations(names, 2):
            if r.random() < 0.3:
                edges.append((a, b, *r.choice(KINDS)))
        for _ in range(r.choice([0, 0, 1, 2])):
            a, b = r.choice(names), r.choice(names)
            edges.append((a, b, "activates", ""))
        if edges:
            yield f"g{i}", edges, {x: r.choice([0.0, 0.1, 0.5, 0.9]) for x in names if r.random() < 0.8}


def frames(spark, held):
    edges = spark.createDataFrame([(g, *e) for g, es, _ in held for e in es], EDGE).repartition(5)
    nodes = spark.createDataFrame([(g, n, s) for g, _, scores in held for n, s in scores.items()], "graph_id string, node_id string, score double")
    return edges, nodes


@pytest.mark.parametrize(("most", "pool"), [(3, 20), (2, 4)])
def test_identification_equals_brute_force(spark, most, pool):
    held = list(graphs(40 if most == 3 else 15))
    edges, nodes = frames(spark, held)
    asked = []
    for g, es, scores in held:
        on = sorted({x for e in es for x in e[:2]} | set(scores)) + ["gone"]
        asked += [(g, x, y) for x in on for y in on]
    pairs = spark.createDataFrame(asked + asked[:5], "graph_id string, treatment string, outcome string")
    got = {(r.graph_id, r.treatment, r.outcome): r for r in C.identification(edges, nodes, pairs, most, pool).collect()}
    assert len(got) == len(asked)
    reasons = set()
    for g, es, scores in held:
        for x, y in [(x, y) for h, x, y in asked if h == g]:
            want = B.identify(es, scores, x, y, most, pool)
            r = got[g, x, y]
            assert {k: r[k] for k in want} == want, (g, x, y)
            reasons.add((want["reason"], len(want["adjustment_set"])))
    assert {"identifiable_by_adjustment", "identifiable_trivially", "no_causal_path", "cyclic_component", "treatment_absent", "outcome_absent"} <= {x for x, _ in reasons}


def test_sets_of_two_and_three(spark):
    held = []
    for k in range(5):
        es = [("x", "y", "causes", "")] + [e for i in range(k) for e in ((f"u{i}", "x", "causes", ""), (f"u{i}", "m", "causes", ""))] + [("m", "y", "causes", "")]
        held.append((f"k{k}", es, {f"u{i}": i / 10 for i in range(k)} | {"m": 0.0}))
    hidden = [(g + "h", [(a, "y" if b == "m" else b, *t) for a, b, *t in es if a != "m"], s) for g, es, s in held]
    edges, nodes = frames(spark, held + hidden)
    pairs = spark.createDataFrame([(g, "x", "y") for g, _, _ in held + hidden], "graph_id string, treatment string, outcome string")
    got = {r.graph_id: r for r in C.identification(edges, nodes, pairs).collect()}
    assert got["k4"].adjustment_set == ["m"]
    assert got["k3h"].adjustment_set == ["u2", "u1", "u0"] and got["k4h"].reason == "no_valid_adjustment_set" and got["k4h"].truncated


def test_wide_families_stay_hubs(spark):
    """A node with 3,000 parents would have 4.5 million married pairs."""
    es = [(f"p{i}", "y", "causes", "") for i in range(3000)] + [("p0", "x", "causes", ""), ("x", "y", "causes", "")]
    edges, nodes = frames(spark, [("g", es, {"p0": 1.0})])
    r = C.identification(edges, nodes, spark.createDataFrame([("g", "x", "y"), ("g", "p7", "y")], "graph_id string, treatment string, outcome string"))
    assert {x.treatment: (x.reason, x.adjustment_set) for x in r.collect()} == {"x": ("identifiable_by_adjustment", ["p0"]), "p7": ("identifiable_trivially", [])}


def test_components_equal_brute_force(spark):
    held = list(graphs(60, seed=2))
    ring = [(f"r{i}", f"r{(i + 1) % 30}", "activates", "") for i in range(30)] + [("r3", "r3", "activates", ""), ("r9", "z", "activates", ""), ("z", "z", "activates", "")]
    held.append(("ring", ring, {}))
    edges, _ = frames(spark, [(g, es, {"x": 0.0}) for g, es, _ in held])
    want = set()
    for g, es, _ in held:
        for i, part in enumerate(B.Digraph((a, b) for a, b, t, c in es if B.is_admissible(t, c)).cyclic()):
            want |= {(g, i, n) for n in part}
    got = CO.cyclic_components(edges.where(G.admissible())).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert CO.cyclic_components(edges.limit(0)).collect() == []


def ways(pairs, s):
    """Distances and numbers of shortest paths from s."""
    children = defaultdict(set)
    for a, b in pairs:
        children[a].add(b)
    far, n, level = {s: 0}, {s: 1}, [s]
    while level:
        new = defaultdict(int)
        for v in level:
            for w in children[v]:
                if w not in far:
                    new[w] += n[v]
        far |= dict.fromkeys(new, far[level[0]] + 1)
        n |= new
        level = list(new)
    return far, n


def test_betweenness_equals_pair_sums(spark):
    held = list(graphs(25, seed=3))
    edges, _ = frames(spark, [(g, es, {"x": 0.0}) for g, es, _ in held])
    got = {(r.graph_id, r.node_id): r.betweenness for r in CO.betweenness(edges).collect()}
    total = 0
    for g, es, _ in held:
        on = {x for e in es for x in e[:2]}
        far = {s: ways([e[:2] for e in es], s) for s in on}
        for v in on:
            share = 0.0
            for s in on - {v}:
                for t in on - {v, s}:
                    (d, n), (dv, nv) = far[s], far[v]
                    if t in d and v in d and t in dv and d[v] + dv[t] == d[t]:
                        share += n[v] * nv[t] / n[t]
            k = len(on)
            assert got[g, v] == pytest.approx(share / ((k - 1) * (k - 2)) if k > 2 else share)
            total += share
    assert total > 10 and len(got) == sum(len({x for e in es for x in e[:2]}) for _, es, _ in held)
