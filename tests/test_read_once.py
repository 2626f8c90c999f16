"""Whole queries read a release once, and keep first arrivals."""

from __future__ import annotations

from causalake.operators import frames as A
from causalake.plans import discovery as D
from causalake.plans import projections as P
from causalake.runtime import cut
from tests.conftest import rows

ASSOC = "target_id string, target_symbol string, disease_id string, datatype string, score double"
INTERACTIONS = "source_symbol string, target_symbol string, is_directed boolean, consensus_direction boolean, is_stimulation boolean, is_inhibition boolean, primary_sources string, references string, ord string"


def read(spark, data, schema):
    """A table of `data`, and the number of rows that tasks have read of it."""
    seen = spark.sparkContext.accumulator(0)

    def told(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    return spark.createDataFrame(data, schema).mapInPandas(told, schema), seen


def test_first_arrivals_read_once(spark):
    genes = [("1", g, d, "genetic_association", s) for d in ("X", "Y") for g, s in (("A", 0.9), ("B", 0.8), ("C", 0.7))]
    said = lambda a, b, sources, i, up=True: (a, b, True, True, up, not up, sources, f"PM:{i}", f"{i:02}")
    met = [said("A", "B", "S1;S2;S3", 3), said("A", "B", "S1", 1), said("a ", "B", "S1;S2", 2), said("B", "A", "S4", 5), said("B", "A", "S5;S6", 4, False), said("A", "Z", "S1", 0), said("C", "A", "S7", 6)]
    assoc, n_assoc = read(spark, [*genes, ("1", "A", "X", "literature", 0.1), ("1", "B", "Y", "known_drug", None)], ASSOC)
    interactions, n_met = read(spark, met, INTERACTIONS)
    nodes, edges = D.disease_graphs(assoc, interactions)
    assert {(r.graph_id, r.name, r.score) for r in nodes.where("node_type = 'gene'").collect()} == {(d, g, s) for d in ("X", "Y") for g, s in (("A", 0.9), ("B", 0.8), ("C", 0.7))}
    got = {(r.graph_id, r.source_id, r.target_id): (r.edge_type, round(r.weight, 4), tuple(r.primary_sources), tuple(r.pmids)) for r in edges.where("evidence_class = 'regulatory'").collect()}
    one = {("gene:A", "gene:B"): ("activates", 0.55, ("S1",), ("1",)), ("gene:a", "gene:B"): ("activates", 0.6, ("S1", "S2"), ("2",)), ("gene:B", "gene:A"): ("inhibits", 0.6, ("S4", "S5", "S6"), ("4",)), ("gene:C", "gene:A"): ("activates", 0.55, ("S7",), ("6",))}
    assert got == {(d, *k): v for d in ("X", "Y") for k, v in one.items()}
    assert n_assoc.value == len(genes) + 2 and n_met.value == len(met)


def test_facts_of_best_scores(spark, sf):
    best = cut(A.best_scores(P.assoc(spark, sf)), "best-scores")
    held = P.facts(spark, sf, best)
    assert rows(held) == rows(P.facts(spark, sf))
    # Line items are read for flags and for tissues alone.
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 2
