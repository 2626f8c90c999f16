"""Queries over associations, interactions and graph assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import frames as A
from ..operators import graph as G
from . import projections as P

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("candidate_frame", f"WITH {P.GENETIC_SQL} SELECT DISTINCT disease_id, target_symbol FROM genetic")
def _(spark, sf):
    return A.candidate_frame(P.assoc(spark, sf))


@query("genetic_diseases", f"WITH {P.GENETIC_SQL} SELECT DISTINCT disease_id FROM genetic")
def _(spark, sf):
    return A.genetic_diseases(P.assoc(spark, sf))


CENSUS = """SELECT (SELECT count(DISTINCT disease_id) FROM assoc) AS n_diseases, count(*) AS n_genetic_diseases, coalesce(median(n), 0.0)::DOUBLE AS median_frame, coalesce(sum(n), 0)::BIGINT AS n_pairs
FROM (SELECT disease_id, count(DISTINCT target_symbol) AS n FROM genetic GROUP BY 1)"""


@query("census", f"WITH {P.GENETIC_SQL} {CENSUS}")
def _(spark, sf):
    return A.census(P.assoc(spark, sf))


@query("census_rollup", f"WITH {P.ASSOC_SQL} SELECT datatype, disease_id, count(*) AS n, round(avg(score), 4) AS mean_score FROM assoc GROUP BY ROLLUP (datatype, disease_id)")
def _(spark, sf):
    return A.census_rollup(P.assoc(spark, sf))


@query("diseases_per_symbol", f"WITH {P.ASSOC_SQL} SELECT trim(target_symbol) AS symbol, count(DISTINCT disease_id) AS n_associated_diseases FROM assoc GROUP BY 1")
def _(spark, sf):
    return A.diseases_per_symbol(P.assoc(spark, sf)).withColumnRenamed("_symbol", "symbol")


@query(
    "top_genetic_targets",
    f"""WITH {P.GENETIC_SQL}, best AS (SELECT disease_id, target_symbol, least(1.0::DOUBLE, max(score)) AS score FROM genetic GROUP BY 1, 2),
reach AS (SELECT target_symbol, count(DISTINCT disease_id) AS n FROM assoc GROUP BY 1),
top AS (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY score DESC, target_symbol) AS rank FROM best)
SELECT disease_id, target_symbol, score, rank::INT AS rank, n AS n_associated_diseases, round(1 / log2(n + 2), 4) AS specificity FROM top JOIN reach USING (target_symbol) WHERE rank <= 20""",
)
def _(spark, sf):
    return A.top_genetic_targets(P.assoc(spark, sf), 20)


@query("datatype_scores", f"WITH {P.ASSOC_SQL} SELECT disease_id, target_symbol, datatype, max(score) AS score, (SELECT min(target_id) FROM assoc b WHERE b.disease_id = a.disease_id AND b.target_symbol = a.target_symbol AND b.score > 0) AS target_id FROM assoc a WHERE score > 0 GROUP BY 1, 2, 3")
def _(spark, sf):
    held = A.datatype_scores(P.assoc(spark, sf))
    return held.select("disease_id", "target_symbol", "target_id", F.explode("datatype_scores").alias("datatype", "score"))


@query("evidence_class", f"WITH {P.ASSOC_SQL} SELECT disease_id, target_symbol, CASE WHEN bool_or(datatype = 'genetic_association') THEN 'genetic_association' WHEN bool_or(datatype = 'somatic_mutation') THEN 'somatic_mutation' ELSE 'literature' END AS evidence_class FROM assoc WHERE score > 0 GROUP BY 1, 2")
def _(spark, sf):
    held = A.datatype_scores(P.assoc(spark, sf))
    return held.select("disease_id", "target_symbol", A.evidence_class("datatype_scores").alias("evidence_class"))


@query("corpus_diseases", f"WITH {P.GENETIC_SQL} SELECT DISTINCT disease_id FROM genetic WHERE disease_id IN (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000)")
def _(spark, sf):
    c, n = P.table(spark, sf, "customer").where("c_acctbal > 9000"), P.table(spark, sf, "nation")
    trials = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("disease_id")).agg(F.collect_set(F.col("c_custkey").cast("string")).alias("targets"))
    return A.corpus_diseases(P.assoc(spark, sf), trials)


@query("unmapped_targets", "SELECT l_partkey AS target_id, count(*) AS n FROM lineitem ANTI JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY 1")
def _(spark, sf):
    from ..sources.releases import unmapped

    rows = P.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("target_id"))
    return unmapped(rows, P.table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")))


@query(
    "interaction_edges",
    f"""WITH {P.INTERACTIONS_SQL}, known AS (SELECT 'g' AS graph_id, 'g' || (p_partkey % 500)::VARCHAR AS k FROM part WHERE p_size < 40 GROUP BY ALL)
SELECT 'g' AS graph_id, 'gene:' || source_symbol AS source_id, 'gene:' || target_symbol AS target_id,
 CASE WHEN is_stimulation AND NOT is_inhibition THEN 'activates' WHEN is_inhibition AND NOT is_stimulation THEN 'inhibits' ELSE 'regulates' END AS edge_type,
 round(least(1.0::DOUBLE, 0.5 + 0.05 * n_sources), 4) AS weight,
 CASE WHEN is_stimulation AND NOT is_inhibition THEN 1 WHEN is_inhibition AND NOT is_stimulation THEN -1 ELSE 0 END AS sign, n_sources, pmid
FROM interactions WHERE source_symbol <> target_symbol AND is_directed AND consensus_direction AND lower(source_symbol) IN (SELECT k FROM known) AND lower(target_symbol) IN (SELECT k FROM known)""",
)
def _(spark, sf):
    known = P.table(spark, sf, "part").where("p_size < 40").select(F.lit("g").alias("graph_id"), F.lower(P.symbol("p_partkey")).alias("symbol")).distinct()
    e = G.interaction_edges(P.interactions(spark, sf), known)
    return e.select("graph_id", "source_id", "target_id", "edge_type", F.round("weight", 4).alias("weight"), "sign", F.size("primary_sources").alias("n_sources"), F.element_at("pmids", 1).alias("pmid"))


@query("respelled_interactions", f"WITH {P.INTERACTIONS_SQL}, s AS (SELECT DISTINCT lower('G' || (p_partkey % 500)::VARCHAR) AS s FROM part WHERE p_size < 10) SELECT a.s AS source_symbol, b.s AS target_symbol, count(*) AS n FROM interactions JOIN s a ON lower(source_symbol) = a.s JOIN s b ON lower(target_symbol) = b.s GROUP BY 1, 2")
def _(spark, sf):
    s = P.table(spark, sf, "part").where("p_size < 10").select(F.lower(P.symbol("p_partkey")).alias("symbol")).distinct()
    return G.respelled(P.interactions(spark, sf), s).groupBy("source_symbol", "target_symbol").agg(F.count("*").alias("n"))


@query("edge_dedup", f"WITH {P.EDGES_SQL} SELECT graph_id, source_id, target_id, edge_type, arg_min(weight, ord) AS weight, min(ord) AS ord FROM edges GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return G.dedup_edges(P.edges(spark, sf)).select("graph_id", "source_id", "target_id", "edge_type", "weight", "ord")


COLLISIONS_SQL = f"""{P.EDGES_SQL}, pick AS (SELECT *, row_number() OVER (PARTITION BY graph_id, source_id, target_id ORDER BY {P.ADMISSIBLE_SQL} DESC, weight DESC, ord) AS n FROM edges),
resolved AS (SELECT * FROM pick WHERE n = 1)"""


@query("edge_collisions", f"WITH {COLLISIONS_SQL}, src AS (SELECT graph_id, source_id, target_id, count(DISTINCT primary_source) AS n_primary FROM edges GROUP BY 1, 2, 3) SELECT graph_id, source_id, target_id, edge_type, weight, n_primary FROM resolved JOIN src USING (graph_id, source_id, target_id)")
def _(spark, sf):
    e = G.resolve_collisions(P.edges(spark, sf))
    return e.select("graph_id", "source_id", "target_id", "edge_type", "weight", F.size("primary_sources").cast("long").alias("n_primary"))


@query(
    "node_merge",
    f"""WITH {P.NODES_SQL}, s1 AS (SELECT graph_id, node_id, source, min(ord) AS o FROM nodes GROUP BY 1, 2, 3), p1 AS (SELECT graph_id, node_id, pdb, min(ord) AS o FROM nodes GROUP BY 1, 2, 3),
s AS (SELECT graph_id, node_id, string_agg(source, ', ' ORDER BY o) AS source FROM s1 GROUP BY 1, 2), p AS (SELECT graph_id, node_id, string_agg(pdb, ';' ORDER BY o) AS pdb_ids FROM p1 GROUP BY 1, 2)
SELECT graph_id, node_id, arg_min(name, ord) AS name, arg_min(node_type, ord) AS node_type, max(score) AS score, arg_min(uniprot_id, ord) FILTER (WHERE uniprot_id IS NOT NULL) AS uniprot_id,
 arg_max(mv, ord) FILTER (WHERE mk = 'F') AS meta_f, any_value(s.source) AS source, any_value(p.pdb_ids) AS pdb_ids FROM nodes JOIN s USING (graph_id, node_id) JOIN p USING (graph_id, node_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    m = G.merge_nodes(P.nodes(spark, sf))
    return m.select("graph_id", "node_id", "name", "node_type", "score", "uniprot_id", F.try_element_at("metadata", F.lit("F")).alias("meta_f"), "source", F.array_join("pdb_ids", ";").alias("pdb_ids"))


@query(
    "default_edges",
    f"""WITH {P.NODES_SQL}, m AS (SELECT graph_id, node_id, max(score) AS score FROM nodes GROUP BY 1, 2)
SELECT graph_id, node_id AS source_id, 'disease:' || lower(graph_id) AS target_id, score AS weight FROM m WHERE NOT EXISTS (SELECT 1 FROM {P.LINES_SQL} WHERE n_name = graph_id AND 'G' || (l_partkey % 500)::VARCHAR = node_id AND l_returnflag = 'A')""",
)
def _(spark, sf):
    m = P.nodes(spark, sf).groupBy("graph_id", "node_id").agg(F.max("score").alias("score"))
    disease = m.select("graph_id").distinct().select("graph_id", F.concat(F.lit("disease:"), F.lower("graph_id")).alias("node_id"), F.lit("disease").alias("node_type"), F.lit(None).cast("double").alias("score"))
    nodes = m.select("graph_id", "node_id", F.lit("gene").alias("node_type"), "score").union(disease)
    known = P.lines(spark, sf).where("l_returnflag = 'A'").select(F.col("n_name").alias("graph_id"), P.symbol("l_partkey").alias("source_id"), F.concat(F.lit("disease:"), F.lower("n_name")).alias("target_id")).distinct()
    return G.default_edges(nodes, known).select("graph_id", "source_id", "target_id", "weight")


@query(
    "gene_symbols",
    f"""WITH {P.NODES_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY graph_id, lower(name) ORDER BY score DESC, ord) AS n, min(ord) OVER (PARTITION BY graph_id, lower(name)) AS o FROM nodes)
SELECT graph_id, name, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, o) AS rank FROM one WHERE n = 1) WHERE rank <= 20""",
)
def _(spark, sf):
    return G.gene_symbols(P.nodes(spark, sf), 20)


@query("frame_exclusions", f"WITH {P.NODES_SQL} SELECT graph_id, source, 'off_frame' AS reason, count(*) AS n FROM nodes WHERE node_id NOT IN (SELECT 'G' || (p_partkey % 500)::VARCHAR FROM part WHERE p_size < 30) GROUP BY 1, 2")
def _(spark, sf):
    n = P.nodes(spark, sf)
    frame = P.table(spark, sf, "part").where("p_size < 30").select(P.symbol("p_partkey").alias("node_id")).distinct()
    frame = frame.join(F.broadcast(P.table(spark, sf, "nation").select(F.col("n_name").alias("graph_id")))).withColumn("name", F.col("node_id"))  # 25 nations
    return G.restrict_to_frame(n, P.edges(spark, sf), frame)[2]


@query("node_counts", f"WITH {P.NODES_SQL} SELECT graph_id, count_if(node_type = 'gene')::BIGINT AS n_genes, count_if(node_type = 'protein')::BIGINT AS n_proteins, 0::BIGINT AS n_pathways FROM nodes GROUP BY 1")
def _(spark, sf):
    return G.node_counts(P.nodes(spark, sf))


@query("causal_subgraph", f"WITH {P.EDGES_SQL}, k AS (SELECT * FROM edges WHERE {P.ADMISSIBLE_SQL}), e AS (SELECT graph_id, source_id AS node_id FROM k UNION SELECT graph_id, target_id FROM k) SELECT graph_id, count(*) AS n_nodes, (SELECT count(*) FROM k WHERE k.graph_id = e.graph_id) AS n_edges FROM e GROUP BY 1")
def _(spark, sf):
    e = P.edges(spark, sf)
    ids = e.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    n, k = G.causal_subgraph(ids, e)
    return n.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(k.groupBy("graph_id").agg(F.count("*").alias("n_edges")), "graph_id")


@query("edges_by_provenance", f"WITH {P.EDGES_SQL} SELECT graph_id, source_db, count(*) AS n, round(avg(weight), 4) AS mean_weight FROM edges GROUP BY 1, 2")
def _(spark, sf):
    return G.by_provenance(P.edges(spark, sf))


@query("edge_augmentation", f"WITH {COLLISIONS_SQL}, l AS (SELECT graph_id, source_id, target_id, max(weight) - 0.1 + (min(ord) < '000005')::INT * 0.2 AS c FROM edges WHERE source_db = 'DB1' GROUP BY 1, 2, 3) SELECT graph_id, source_id, target_id, CASE WHEN weight IS NULL OR c > weight THEN 'learned' ELSE edge_type END AS edge_type, round(CASE WHEN weight IS NULL OR c > weight THEN c ELSE weight END, 4) AS weight FROM resolved FULL JOIN l USING (graph_id, source_id, target_id)")
def _(spark, sf):
    e = P.edges(spark, sf)
    learned = e.where("source_db = 'DB1'").groupBy("graph_id", "source_id", "target_id").agg((F.max("weight") - 0.1 + (F.min("ord") < "000005").cast("int") * 0.2).alias("confidence"))
    return G.augment(G.resolve_collisions(e), learned).withColumn("weight", F.round("weight", 4))


@query("source_scores", f"WITH {P.NODES_SQL} SELECT graph_id, lower(name) AS key, source AS src, max(score) AS score FROM nodes GROUP BY 1, 2, 3")
def _(spark, sf):
    return E.source_scores(P.nodes(spark, sf)).select("graph_id", "key", F.explode("source_scores").alias("src", "score"))


@query("active_sources", f"WITH {P.NODES_SQL} SELECT graph_id, count(DISTINCT source) AS n_active_sources FROM nodes GROUP BY 1")
def _(spark, sf):
    return E.active_sources(P.nodes(spark, sf))


ENDS_SQL = "ends AS (SELECT *, source_id AS node_id FROM edges UNION ALL SELECT *, target_id AS node_id FROM edges)"


@query("connections", f"WITH {P.EDGES_SQL}, {ENDS_SQL} SELECT graph_id, node_id, 0::BIGINT AS n_pathways, count_if(edge_type = 'interacts_with')::BIGINT AS n_interactions FROM ends GROUP BY 1, 2")
def _(spark, sf):
    return E.connections(P.edges(spark, sf))


@query("corroboration", f"WITH {P.EDGES_SQL}, {ENDS_SQL} SELECT graph_id, node_id, count(DISTINCT primary_source) AS n_primary, least(1.5::DOUBLE, 1.0 + count(DISTINCT primary_source) * 0.1::DOUBLE) AS corroboration FROM ends GROUP BY 1, 2")
def _(spark, sf):
    return E.corroboration(P.edges(spark, sf))
