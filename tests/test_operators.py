"""Golden values, order and partition invariance, verdict graphs, readers and streams."""

from __future__ import annotations

import gzip
import json
import lzma

import pytest
from pyspark.sql import functions as F

from causalake.functions import molecules as FM
from causalake.functions import proteins as FP
from causalake.functions import scores as S
from causalake.functions import text as T
from causalake.operators import causal as C
from causalake.operators import components as CO
from causalake.operators import frames as A
from causalake.operators import graph as G
from causalake.operators import molecules as M
from causalake.operators import paths as PA
from causalake.operators import ranking as R
from causalake.operators import records as RE
from causalake.schemas import REASONS
from causalake.sources import releases, sinks, snapshots
from causalake.sources.versions import VersionedTable
from tests import graph_brute as B

ASSOC = "target_id string, target_symbol string, disease_id string, datatype string, score double"


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_keys_and_flags(spark):
    r = one(spark, a=T.match_key(F.lit("\t C9orf72 \n")), b=T.flag(F.lit("TRUE")), c=T.flag(F.lit("maybe")), d=T.flag(F.lit(None)), e=T.split_list(F.lit("a;;b; "), ";"), f=T.pubmed_ids(F.lit("X:12;Y:7;12;z")), g=T.strip_tags(F.lit("a<b>c</b>")), h=T.name_tokens(F.lit("HLA-A/B")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == ("c9orf72", True, False, False, ["a", "b"], ["12", "7"], "ac")
    assert set(r.h) == {"hla-a/b", "hla", "a", "b"}


def test_golden_scores(spark):
    r = one(
        spark,
        best=S.affinity_score(F.lit(-12.0)), half=S.affinity_score(F.lit(-6.0)), clamp=S.affinity_score(F.lit(-20.0)), sa1=S.ease_score(F.lit(1.0)), sa5=S.ease_score(F.lit(5.5)), sa10=S.ease_score(F.lit(10.0)),
        mid=S.affinity_sigmoid(F.lit(-7.0)), spec=S.specificity(F.lit(2)), neutral=S.specificity(F.lit(0)), drug=S.drug_evidence(F.lit(4), F.lit(10), F.lit(4)), lit=S.literature_score(F.lit(9)), off=S.organism_relevance(F.lit("E. coli"), F.lit("Malaria")), on=S.organism_relevance(F.lit("Plasmodium vivax"), F.lit("malaria")),
        none=S.organism_relevance(F.lit("E. coli"), F.lit("Breast cancer")),
    ).asDict()
    assert r == {"best": 1.0, "half": 0.5, "clamp": 1.0, "sa1": 1.0, "sa5": 0.5, "sa10": 0.0, "mid": 0.5, "spec": 0.5, "neutral": 0.5, "drug": 1.0, "lit": 0.6, "off": 0.3, "on": 1.0, "none": 0.0}


@pytest.mark.parametrize(("phase", "drug", "confidence", "label"), [(None, None, 0.59, "inconclusive"), (4, 1.0, 0.84, "causal")])
def test_pathogen(spark, phase, drug, confidence, label):
    v = S.pathogen_scores(F.lit(drug).cast("double"), F.lit(phase).cast("int"), F.lit(0), F.lit(1.0), F.lit(False))
    r = one(spark, **v)
    assert (r.confidence, r.label) == (confidence, label)


def test_weights(monkeypatch):
    assert S.candidate_weights() == S.CANDIDATE_WEIGHTS
    assert sum(S.candidate_weights({"qed": 1.0}).values()) == pytest.approx(1)
    monkeypatch.setenv("CAUSALAKE_WEIGHTS", "not json")
    assert S.candidate_weights() == S.CANDIDATE_WEIGHTS


def test_census_fixtures(spark):
    rows = [("A", "A", "1", "genetic_association", 0.5), ("B", "B", "1", "somatic_mutation", 0.5), ("C", "C", "2", "genetic_association", 0.5), ("D", "D", "3", "literature", 0.9), ("A", "A", "1", "somatic_mutation", 0.1)]
    r = A.census(spark.createDataFrame(rows, ASSOC)).first()
    assert (r.n_diseases, r.n_genetic_diseases, r.median_frame, r.n_pairs) == (3, 2, 1.5, 3)
    assert tuple(A.census(spark.createDataFrame([], ASSOC)).first()) == (0, 0, 0.0, 0)


EDGE = "graph_id string, source_id string, target_id string, edge_type string, weight double, source_db string, evidence_class string, primary_sources array<string>, ord int"


def test_collisions_in_any_order(spark):
    edges = [("g", "a", "b", "interacts_with", 0.9, "X", "ppi", ["p"], 0), ("g", "a", "b", "activates", 0.1, "Y", "regulatory", ["q"], 1), ("g", "a", "b", "activates", 0.1, "Z", "regulatory", ["p"], 2)]
    for order in (edges, edges[::-1]):
        for n in (1, 4):
            r = G.resolve_collisions(spark.createDataFrame(order, EDGE).repartition(n)).collect()
            assert [(x.edge_type, x.source_db, x.primary_sources) for x in r] == [("activates", "Y", ["p", "q"])]


NODE = "graph_id string, node_id string, name string, node_type string, source string, score double, uniprot_id string, pdb_ids array<string>, description string, metadata map<string,string>, pinned boolean, ord int"


def test_merge_pins(spark):
    rows = [("g", "n", "live", "gene", "Live", 0.9, "", ["1"], "d", {"clinical_phase": "4", "go": "x"}, False, 0), ("g", "n", "Pin", "gene", "Rel", 0.4, "U", ["2", "1"], "e", {"k": "v"}, True, 1)]
    for order in (rows, rows[::-1]):
        r = G.merge_nodes(spark.createDataFrame(order, NODE)).first()
        assert (r["name"], r.score, r.source, r.uniprot_id, r.pdb_ids, r.metadata) == ("live", 0.4, "Rel", "U", ["1", "2"], {"go": "x", "k": "v"})


def verdict(edges, x="CCR5", y="HIV"):
    return B.identify([(a, b, t, c) for a, b, t, c in edges], {}, x, y)


GEN, LIT = ("associated_with", "genetic_association"), ("associated_with", "literature")


@pytest.mark.parametrize(
    ("edges", "x", "y", "reason"),
    [
        ([("CCL5", "CCR5", "regulates", ""), ("CCL5", "HIV", *GEN), ("CCR5", "HIV", *GEN)], "CCR5", "HIV", "identifiable_by_adjustment"),
        ([("CCL5", "CCR5", "regulates", ""), ("CCR5", "HIV", *GEN), ("CCL5", "HIV", *LIT)], "CCR5", "HIV", "identifiable_trivially"),
        ([("TNF", "HIV", *LIT)], "TNF", "HIV", "no_causal_path"),
        ([("A", "B", "activates", ""), ("B", "A", "inhibits", ""), ("A", "D", *GEN)], "A", "D", "cyclic_component"),
        ([("A", "B", "activates", "")], "Z", "B", "treatment_absent"),
        ([("A", "B", "activates", "")], "A", "Z", "outcome_absent"),
        ([("X", "Y", "causes", "")] + [e for i in range(4) for e in ((f"U{i}", "X", "causes", ""), (f"U{i}", "Y", "causes", ""))], "X", "Y", "no_valid_adjustment_set"),
    ],
)
def test_verdicts(edges, x, y, reason):
    v = verdict(edges, x, y)
    assert v["reason"] == reason and reason in REASONS
    if reason == "identifiable_by_adjustment":
        assert v["adjustment_set"] == ["CCL5"]
    if reason == "identifiable_trivially":
        assert v["n_near_miss"] == 1
    if reason == "no_valid_adjustment_set":
        assert v["truncated"]


def test_backdoor():
    d = B.Digraph([("U", "X"), ("U", "Y"), ("X", "Y")])
    assert [B.satisfies_backdoor(d, "X", "Y", frozenset(z)) for z in ((), ("U",), ("Y",))] == [False, True, False]
    collider = B.Digraph([("A", "M"), ("B", "M"), ("A", "X"), ("B", "Y"), ("X", "Y")])
    assert B.satisfies_backdoor(collider, "X", "Y", frozenset()) and not B.satisfies_backdoor(collider, "X", "Y", frozenset("M"))


def test_identification_in_groups(spark):
    e = [(g, a, b, t, 1.0, "S", c, [], 0) for g in ("g1", "g2") for a, b, t, c in [("CCL5", "CCR5", "regulates", ""), ("CCL5", "HIV", *GEN), ("CCR5", "HIV", *GEN)]]
    edges = spark.createDataFrame(e, EDGE)
    pairs = spark.createDataFrame([("g1", "CCR5", "HIV"), ("g2", "CCL5", "HIV")], "graph_id string, treatment string, outcome string")
    nodes = spark.createDataFrame([("g1", "CCL5", 0.5)], "graph_id string, node_id string, score double")
    r = {x.graph_id: x for x in C.identification(edges, nodes, pairs).collect()}
    assert r["g1"].adjustment_set == ["CCL5"] and r["g2"].reason == "identifiable_trivially"
    assert CO.cyclic_components(edges).count() == 0
    b = {(x.graph_id, x.node_id): x.betweenness for x in CO.betweenness(edges).collect()}
    assert set(b.values()) == {0.0}


def test_paths(spark):
    e = spark.createDataFrame([("g", "a", "b", "causes", 0.5, "S", "", [], 0), ("g", "b", "c", "causes", 0.4, "T", "", [], 0), ("g", "a", "d", "causes", 0.9, "S", "", [], 0), ("g", "d", "c", "causes", 0.9, "S", "", [], 0)], EDGE)
    pairs = spark.createDataFrame([("g", "a", "c", None), ("g", "a", "c", "S"), ("g", "c", "a", None), ("g", "a", "a", None), ("g", "a", "z", None)], "graph_id string, treatment string, outcome string, excluded string")
    got = {(r.treatment, r.outcome, r.excluded): r.path_strength for r in PA.path_strength(e, pairs).collect()}
    assert got[("a", "c", None)] == pytest.approx(0.81 / 3) and got[("a", "c", "S")] == 0.1
    assert got[("c", "a", None)] == pytest.approx(0.5 / 3) and got[("a", "a", None)] == 0.0 and got[("a", "z", None)] == 0.1


def test_quota_falls_back(spark):
    r = spark.createDataFrame([("g", i, "host", 0.1) for i in range(5)], "graph_id string, ord int, target_type string, causal_confidence double")
    assert [x.ord for x in R.quota_ranking(r, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_molecules(spark):
    r = one(spark, t=FM.smiles_tokens(F.lit("CC(Cl)Br[C@@H]%12")), s=FM.tanimoto(F.array(F.lit(6).cast("long")), F.array(F.lit(2).cast("long"))), z=FM.tanimoto(F.array(F.lit(0).cast("long")), F.array(F.lit(0).cast("long"))), f=FM.largest_fragment(F.lit("CCO.C[C@H]N")))
    assert r.t == ["C", "C", "(", "Cl", ")", "Br", "[", "C", "@@", "H", "]", "%12"] and (r.s, r.z, r.f) == (0.5, 0.0, "C[CH]N")
    gen = spark.createDataFrame([("CCO", "CCO"), ("OCC", "CCO"), ("C", "C"), ("bad", None)], "smiles string, canonical string")
    m = M.generation_metrics(gen, gen.where("canonical = 'C'").select("canonical")).first()
    assert tuple(m) == (4, 0.75, 0.666667, 0.5)
    assert tuple(M.generation_metrics(gen.limit(0), gen.select("canonical")).first()) == (0, 0.0, 0.0, 0.0)


def test_proteins(spark):
    r = one(spark, w=FP.molecular_weight(F.lit("GA")), c=FP.net_charge(F.lit("KKDD")), p=FP.isoelectric_point(F.lit("GGG")), h=FP.hydrophobic_fraction(F.lit("IVKR")), v=FP.is_sequence(F.lit("AXB")), e=FP.hydrophobic_fraction(F.lit("")))
    assert r.w == 146.15 and abs(r.c) < 0.1 and r.p == 7.0 and (r.h, r.v, r.e) == (0.5, False, 0.0)


def test_readers(spark, tmp_path):
    doc = {"target": {"id": "E1", "gene_info": {"symbol": "TP53"}}, "disease": {"id": "D"}, "association_score": {"datatypes": {"genetic_association": 0.5, "literature": 0.0}}}
    (tmp_path / "r.json.gz").write_bytes(gzip.compress((json.dumps(doc) + "\n").encode()))
    assert [tuple(r) for r in releases.read_json_release(spark, str(tmp_path / "r.json.gz")).collect()] == [("E1", "TP53", "D", "genetic_association", 0.5)]
    a = spark.createDataFrame([("E1", "D", "x", 0.5), ("E2", "D", "x", 0.0)], "targetId string, diseaseId string, datatypeId string, score double")
    t = spark.createDataFrame([("E1", "TP53")], "id string, approvedSymbol string")
    assert releases.join_targets(a, t, check=False).count() == 1
    with pytest.raises(Exception, match="target without a symbol: E2"):
        releases.join_targets(a.withColumn("score", F.lit(1.0)), t).collect()
    (tmp_path / "t.xz").write_bytes(lzma.compress(b"abc"))
    assert releases.read_compressed_text(spark, str(tmp_path / "t.xz")).first().text == "abc"
    with pytest.raises(ValueError, match="pinned"):
        releases.release_for("omnipath", "2018-07")


def test_archive(spark):
    cols = "source_genesymbol string, target_genesymbol string, is_directed string, is_stimulation string, is_inhibition string, sources string, references string, ncbi_tax_id_source string, ncbi_tax_id_target string"
    raw = spark.createDataFrame([("A", "B", "True", "1", "", "X;Y", "PM:1", "9606", " 9606 "), ("A", "C", "1", "1", "0", "X", "", "9606", "10090"), ("A", "D", "1", "1", "0", "X", "", None, "9606")], cols)
    rows, notes = releases.archive_interactions(raw)
    r, n = rows.collect(), notes.first()
    assert len(r) == 1 and (r[0].is_directed, r[0].consensus_direction, r[0].is_inhibition) == (True, True, False)
    assert tuple(n) == (3, 2, True)
    with pytest.raises(ValueError, match="organism"):
        releases.archive_interactions(raw.drop("ncbi_tax_id_source"))


def test_snapshots(spark, tmp_path):
    reads = []
    store = snapshots.SnapshotStore(spark, str(tmp_path / "s"), lambda *x: reads.append(x[:2]))
    with pytest.raises(snapshots.MissingSnapshot):
        store.associations("21.11")
    rows = spark.createDataFrame([("A", "A", "1", "literature", 0.5)], ASSOC)
    store.write("opentargets", "21.11", rows, "disease_id")
    store.write("opentargets", "21.11", rows)
    assert store.associations("21.11").count() == 1 and reads == [("opentargets", "21.11")] and store.manifest().count() == 1
    resolver = snapshots.SourceResolver(store, releases.release_for)
    assert resolver.resolve("opentargets", None)[0] == "live" and resolver.resolve("opentargets", "2021-11") == ("snapshot", "21.11")
    with pytest.raises(snapshots.MissingSnapshot):
        resolver.resolve("omnipath", "2025-06")


def test_digest_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert RE.digest(df).first() == RE.digest(df.repartition(7).orderBy(F.desc("id"))).first()
    assert RE.digest(df).first() != RE.digest(df.limit(99)).first()


def test_graph_documents_round_trip(spark):
    n = spark.createDataFrame([("g", "a", 0.5), ("g", "b", None)], "graph_id string, node_id string, score double")
    e = spark.createDataFrame([("g", "a", "b", 0.1)], "graph_id string, source_id string, target_id string, weight double")
    docs = sinks.graph_documents(n, e)
    back = sinks.graph_rows(docs, "struct<node_id:string,score:double>", "struct<source_id:string,target_id:string,weight:double>")
    assert sorted(map(tuple, back[0].collect()), key=str) == sorted(map(tuple, n.collect()), key=str)
    assert list(map(tuple, back[1].collect())) == list(map(tuple, e.collect()))
    assert "<edge source" in sinks.graphml(n, e).first().document


def test_upsert(spark, tmp_path):
    p = str(tmp_path / "t")
    for v in (1, 2):
        sinks.upsert(p, spark.createDataFrame([("k", v)], "k string, v int"), ["k"], ["v"])
    assert [tuple(r) for r in VersionedTable(spark, p).read().collect()] == [("k", 2)]


def test_streams(spark, sf, tmp_path):
    from causalake.streaming import runs

    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(src)
    rows = runs.stream(spark, src, events.schema)
    q = runs.arm_updates(rows).writeStream.outputMode("complete").format("memory").queryName("arms").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("arms").collect())) == sorted(map(tuple, runs.arm_updates(events).collect()))
    out, work = str(tmp_path / "out"), lambda d: d.select("event_id")
    for _ in range(2):
        runs.resumable(rows, work, out, str(tmp_path / "cp"), "event_id").awaitTermination(120)
    assert spark.read.parquet(out).count() == events.count()
    ring = runs.ring_buffer(rows, "user_id", "event_id", "value", 3).writeStream.outputMode("update").format("memory").queryName("ring").trigger(availableNow=True).start()
    ring.awaitTermination(120)
    last = spark.table("ring").groupBy("user_id" if "user_id" in spark.table("ring").columns else "key").agg(F.max("n_seen").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == events.count()
    batch = runs.tumbling(events, "ts", ["event_type"], "1 day", "1 day")
    assert batch.agg(F.sum("n")).first()[0] == events.count()
