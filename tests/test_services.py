"""Tissues, landed entries and pathways, mirror forms, dated graphs and graded validation on small cases."""

from __future__ import annotations

import json
import re

import pytest

from causalake.functions import proteins as FP
from causalake.functions import scores as S
from causalake.operators import dated as D
from causalake.operators import mirror as MI
from causalake.operators import tissues as TI
from causalake.operators import validation as V
from causalake.sources import landed as LA


def test_tissues_told(spark):
    targets = spark.createDataFrame([("A1", "HIV"), ("a2", "HIV"), ("A3", "HIV"), ("A1", None), (None, "gout")], "gene string, disease string")
    seen = spark.createDataFrame([("a1", "Tonsil"), ("A1", "lymphoid tissue"), ("A1", "retina"), ("A2", "retina"), ("A2", " "), ("A3", "")], "gene string, tissue string")
    got = {(r.gene, r.disease): r for r in TI.annotated_targets(targets, seen).collect()}
    assert len(got) == 5
    r = got["A1", "HIV"]
    assert (r.tissue_relevant, r.tissue_coverage) == (True, 0.5)
    assert r.tissue_explanation == "A1 expressed in lymph node, retina; 1/2 overlap with HIV-relevant tissues (lymph node). Gate: PASS (coverage 50%)."
    r = got["a2", "HIV"]
    assert (r.tissue_relevant, r.tissue_coverage) == (False, 0.0)
    assert r.tissue_explanation.startswith("a2 expressed in retina, none overlap with HIV-relevant tissues (blood, bone marrow, brain,")
    assert got["A3", "HIV"].tissue_relevant and got["A3", "HIV"].tissue_explanation.startswith("Tissue expression unknown for A3")
    assert got["A1", None].tissue_relevant and got[None, "gout"].tissue_relevant


def test_disease_names(spark):
    d = spark.createDataFrame([("Type 2 Diabetes ",), ("type 2 diabetes mellitus",), ("gout",), ("ovarian carcinoma",), ("",), (None,)], "disease string")
    got = {r.disease: (r.basis, r.disease_class, r.tissues[0]) for r in TI.disease_tissues(d).collect()}
    assert got["Type 2 Diabetes "] == ("listed", "metabolic", "pancreas") and got["type 2 diabetes mellitus"][0] == "similar"
    assert got["gout"] == ("class", "other", "blood") and got["ovarian carcinoma"][:2] == ("class", "cancer")
    assert got[""][0] == got[None][0] == "similar"


def entry(**more):
    return json.dumps({"results": [more, {"primaryAccession": "second"}]})


def test_entries(spark):
    refs = [{"database": "PDB", "id": f"{i}ABC"} for i in range(12)] + [{"database": "GO", "id": "GO:1", "properties": [{"key": "GoTerm", "value": f"C:{i}"}, {"key": "GoEvidenceType", "value": "IDA"}]} for i in range(25)]
    pages = [
        ("A", entry(primaryAccession="P1", uniProtKBCrossReferences=refs)),
        ("B", entry(proteinDescription={"recommendedName": {"fullName": {"value": "Big Kinase"}}}, comments=[{"commentType": "FUNCTION", "texts": []}])),
        ("C", entry(comments=[{"commentType": "FUNCTION", "texts": [{"value": "one"}, {"value": "x"}]}, {"commentType": "SUBCELLULAR LOCATION", "subcellularLocations": [{"location": {"value": "Nucleus"}}, {"location": {}}, {"location": {"value": "Golgi"}}]}])),
        ("D", '{"results": []}'), ("E", "no json"), ("F", None), ("G", "{}"),
    ]
    got = {r.gene: r for r in LA.protein_entries(spark.createDataFrame(pages, "gene string, body string")).collect()}
    assert set(got) == {"A", "B", "C"}
    a = got["A"]
    assert (a.uniprot_id, a.protein_name, a.function, a.subcellular_location, a.is_druggable) == ("P1", "A", "", "", True)
    assert a.pdb_ids == [f"{i}ABC" for i in range(10)] and a.go_terms == [f"C:{i}" for i in range(20)]
    assert (got["B"].protein_name, got["B"].is_druggable, got["B"].pdb_ids, got["B"].go_terms) == ("Big Kinase", True, [], [])
    assert (got["C"].function, got["C"].subcellular_location, got["C"].is_druggable) == ("one", "Nucleus; Golgi", False)


def test_pathways_by_exact_symbol(spark):
    hits = spark.createDataFrame([("ccr5", "hsa:9\tCCR2, CCR5; receptor\nbad line\nmmu:1\tCCR5\nhsa:1234\tCCR5, CD195; receptor\nhsa:5\tCCR5"), ("X", "hsa:1\tY; binds X"), ("Z", None), ("CD4", "hsa:920\tCD4; molecule"), ("T", "hsa:7\tT")], "symbol string, body string")
    assert {(r.symbol, r.gene_id) for r in LA.exact_symbols(hits).collect()} == {("ccr5", "hsa:1234"), ("CD4", "hsa:920"), ("T", "hsa:7")}
    links = spark.createDataFrame([("hsa:1234", "hsa:1234\tpath:hsa1\nhsa:1234\tpath:hsa2\nhsa:1234\tpath:map3"), ("hsa:920", "hsa:920\tpath:hsa2\nhsa:920\tpath:hsa4"), ("hsa:7", "hsa:7\tpath:hsa1")], "gene_id string, body string")
    names = spark.createDataFrame([("path:hsa1", "ENTRY       hsa1\nNAME        Signalling - Homo sapiens (human)\nCLASS       x"), ("path:hsa2", "ENTRY")], "pathway string, body string")
    asked = spark.createDataFrame([("g", 1, "ccr5"), ("g", 2, "CD4"), ("g", 3, "T"), ("h", 1, "T")], "graph_id string, ord int, symbol string")
    for most, genes in ((2, {"ccr5"}), (3, {"ccr5", "CD4"}), (4, {"ccr5", "CD4", "T"})):
        nodes, edges = LA.symbol_pathways(asked, hits, links, names, most)
        assert {r.source_id[5:] for r in edges.where("graph_id = 'g'").collect()} == genes, most
    assert {(r.node_id, r.name) for r in nodes.where("graph_id = 'g'").collect()} == {("pathway:path:hsa1", "Signalling"), ("pathway:path:hsa2", "path:hsa2"), ("pathway:path:hsa4", "path:hsa4")}
    assert edges.count() == 6


def test_residue_masses(spark):
    """The natural forms' atoms weigh what the residues do, with water."""
    weight = {"C": 12.011, "N": 14.007, "O": 15.999, "S": 32.06}
    bonds = {"C": 4, "N": 3, "O": 2, "S": 2}
    for letter, smiles in MI.RESIDUES.items():
        text = re.sub(r"\[nH\]", "n", re.sub(r"\[C@@H\]", "C", smiles))
        atoms = [c.upper() for c in text if c.isalpha()]
        rings, double, aromatic = len(re.findall(r"\d", text)) // 2, text.count("="), sum(c.islower() for c in text)
        free = sum(bonds[a] for a in atoms) - 2 * (len(atoms) - 1 + rings + double)
        # An aromatic ring of n atoms has as many double bonds as its carbons, and nitrogens without hydrogen, give in pairs.
        pairs = {"F": 3, "Y": 3, "W": 4, "H": 2}.get(letter, 0)
        assert bool(pairs) == bool(aromatic)
        mass = sum(weight[a] for a in atoms) + 1.008 * (free - 2 * pairs)
        assert abs(mass - FP.MASS[letter] - FP.WATER) < 0.02, letter


def test_mirror_forms(spark):
    df = spark.createDataFrame([(1, "gTX"), (2, ""), (3, None)], "id int, sequence string")
    got = [(r.position, r.residue, r.chirality, r.smiles, r.valid) for r in MI.residues(df, mirror=True).orderBy("position").collect()]
    assert got == [(1, "G", "D", "NCC(=O)O", True), (2, "T", "D", "N[C@H]([C@H](O)C)C(=O)O", True), (3, "X", "D", "", False)]
    pairs = spark.createDataFrame([("N[C@@H](C)C", "N[C@H](C)C", True), ("NC", "NC", True), ("N[C@@H]([C@@H])", "N[C@H]([C@@H])", False), (None, "N", False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in pairs.withColumn("got", MI.is_mirror_pair("a", "b")).collect())
    a = spark.createDataFrame([("s", i, x) for i, x in enumerate("HHEC")], "structure_id string, position int, label string")
    b = spark.createDataFrame([("s", i, x) for i, x in enumerate("HEE")], "structure_id string, position int, label string")
    assert MI.same_secondary(a, b).first().match == 0.666667
    p = MI.profiles(spark.createDataFrame([("ACDK", 91.0), ("", None)], "sequence string, mean_plddt double")).collect()
    assert [r.stability for r in p] == ["very high", "very low"]


def test_graded(spark):
    found = spark.createDataFrame([("d", "dhfr-TS", True), ("d", "BAD", True), ("d", "BAD/X", True), ("d", "T2", False), ("d", None, True), ("e", "Q", True)], "disease_id string, name string, is_causal boolean")
    truth = spark.createDataFrame([("d", "DHFR", "m"), ("d", "t2", ""), ("d", "T3", "drugA"), ("d", "T4", None), ("z", "Q", "")], "disease_id string, gene string, drug string")
    wrong = spark.createDataFrame([("d", "bad", "a marker")], "disease_id string, gene string, reason string")
    got = {r.disease_id: r for r in V.graded(found, truth, wrong).collect()}
    assert set(got) == {"d", "e"} and not got["e"].validated and got["e"].grade is None
    d = got["d"]
    assert (d.n_identified, d.precision, d.recall, d.f1, d.grade) == (3, 0.333, 0.25, 0.286, "C")
    assert (d.true_positives, d.false_positives_known, d.missed_targets) == (["DHFR-TS"], ["BAD", "BAD/X"], ["T3", "T4"])
    assert d.warnings == [
        "FALSE POSITIVE: BAD is a known non-target (a marker)", "FALSE POSITIVE: BAD/X is a known non-target (known non-target)",
        "MISSED: T3 (targeted by drugA) is an established target not identified", "MISSED: T4 is an established target not identified",
        "LOW PRECISION: Only 33% of identified causal targets are validated",
    ]


def test_dated(spark):
    nodes = spark.createDataFrame([("g", "Open Targets", "gene:A", "A", "gene"), ("g", "KEGG", "gene:A", "A", "gene"), ("g", "KEGG", "gene:B", "B", "gene"), ("g", "KEGG", "pathway:1", "P", "pathway"), ("g", "KEGG", "x", "X", "pathogen_gene"), ("g", None, "gene:B", "B", "gene")], "graph_id string, source string, node_id string, name string, node_type string")
    edges = spark.createDataFrame([("g", "Open Targets", "gene:A", "d"), ("g", "KEGG", "gene:A", "pathway:1"), ("g", "KEGG", "gene:B", "pathway:1"), ("g", None, "gene:B", "q"), ("g", None, "gene:A", "q")], "graph_id string, source_db string, source_id string, target_id string")
    n, e, told = D.dated_graph(nodes, edges, spark.createDataFrame([("g", "GENE:a ")], "graph_id string, node_id string"))
    assert [r.source for r in n.collect()] == ["Open Targets"] == [r.source_db for r in e.collect()]
    assert {tuple(r)[1:] for r in told.collect()} == {("KEGG", "off_frame", "B", None, None), ("KEGG", "excluded_by_type", "x", None, None), ("KEGG", "withheld", None, 2, 1), (None, "off_frame", "B", None, None), (None, "withheld", None, 0, 1)}
    asked = spark.createDataFrame([("g", "OpenTargets"), ("g", "KEGG")], "graph_id string, source string")
    assert [r.source for r in D.contributors(asked, True).collect()] == ["OpenTargets"] and D.contributors(asked, False).count() == 2
    with pytest.raises(KeyError, match="no snapshot reader"):
        D.snapshot_reader("kegg", None, "1")


def test_scores(spark):
    rows = spark.createDataFrame([(True, None, None), (True, 4.0, 0.3), (True, 4.1, 0.9), (True, 1.0, 0.29), (None, 1.0, 0.9)], "v boolean, sa double, q double")
    assert [r[0] for r in rows.select(S.passes_screen("v", "sa", "q")).collect()] == [True, True, False, False, False]
    assert tuple(rows.where("false").agg(*S.report_cards("sa", "q")).first()) == (0.0, 0.0, 0.0)
    assert [r[0] for r in rows.limit(1).select(S.unscaled(S.F.lit(0.25), S.F.lit(2.0), S.F.lit(6.0))).collect()] == [3.0]
