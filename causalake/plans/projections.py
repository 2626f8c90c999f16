"""Deterministic projections of the driver's tables onto the canonical schemas, in Spark and as SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def symbol(x):
    return F.concat(F.lit("G"), (F.col(x) % 500).cast("string"))


def order_key():
    """A text that sorts as the unique order of line items."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return F.concat_ws("-", pad("l_orderkey", 9), pad("l_linenumber", 2), pad("l_partkey", 9), pad("l_suppkey", 7), F.date_format("l_shipdate", "yyyyMMdd"))


ORDER_SQL = "concat_ws('-', lpad(l_orderkey::VARCHAR, 9, '0'), lpad(l_linenumber::VARCHAR, 2, '0'), lpad(l_partkey::VARCHAR, 9, '0'), lpad(l_suppkey::VARCHAR, 7, '0'), strftime(l_shipdate, '%Y%m%d'))"

KINDS = [("A", "F", "genetic_association"), ("A", "O", "somatic_mutation"), ("N", "F", "literature"), ("N", "O", "known_drug"), ("R", "F", "rna_expression")]
KINDS_SQL = "CASE " + " ".join(f"WHEN l_returnflag = '{r}' AND l_linestatus = '{s}' THEN '{k}'" for r, s, k in KINDS) + " ELSE 'animal_model' END"


def datatype():
    out = None
    for r, s, k in KINDS:
        test = (F.col("l_returnflag") == r) & (F.col("l_linestatus") == s)
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise("animal_model")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their supplier's nation; the two dimensions are joined as Spark finds them small."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))


LINES_SQL = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def assoc(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(F.col("l_partkey").cast("string").alias("target_id"), symbol("l_partkey").alias("target_symbol"), F.col("n_name").alias("disease_id"), datatype().alias("datatype"), F.round(F.abs("l_discount") * 10, 2).alias("score"))


ASSOC_SQL = f"assoc AS (SELECT l_partkey::VARCHAR AS target_id, 'G' || (l_partkey % 500)::VARCHAR AS target_symbol, n_name AS disease_id, {KINDS_SQL} AS datatype, round(abs(l_discount) * 10, 2) AS score FROM {LINES_SQL})"
GENETIC_SQL = ASSOC_SQL + ", genetic AS (SELECT * FROM assoc WHERE datatype IN ('genetic_association', 'somatic_mutation') AND score > 0)"


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring lines of an order as directed pairs of symbols."""
    w = Window.partitionBy("l_orderkey").orderBy("ord")
    rows = table(spark, sf, "lineitem").withColumn("ord", order_key())
    rows = rows.select("*", F.lead("l_partkey").over(w).alias("_next")).where("_next is not null")
    flags = {"is_directed": F.col("l_linenumber") % 5 != 0, "consensus_direction": F.col("l_linenumber") % 7 != 0, "is_stimulation": F.col("l_returnflag") != "A", "is_inhibition": F.col("l_returnflag") != "R"}
    sources = F.concat_ws(";", F.lit("S1"), F.when(F.col("l_linestatus") == "F", "S2"), F.when(F.col("l_quantity") > 25, "S3"))
    return rows.select(symbol("l_partkey").alias("source_symbol"), symbol("_next").alias("target_symbol"), *(v.alias(k) for k, v in flags.items()), sources.alias("primary_sources"), F.concat(F.lit("PM:"), F.col("l_orderkey").cast("string")).alias("references"), "ord")


INTERACTIONS_SQL = f"""pairs AS (SELECT *, {ORDER_SQL} AS ord, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {ORDER_SQL}) AS nxt FROM lineitem),
interactions AS (SELECT 'G' || (l_partkey % 500)::VARCHAR AS source_symbol, 'G' || (nxt % 500)::VARCHAR AS target_symbol,
 l_linenumber % 5 <> 0 AS is_directed, l_linenumber % 7 <> 0 AS consensus_direction, l_returnflag <> 'A' AS is_stimulation, l_returnflag <> 'R' AS is_inhibition,
 1 + (l_linestatus = 'F')::INT + (l_quantity > 25)::INT AS n_sources, l_orderkey::VARCHAR AS pmid, ord FROM pairs WHERE nxt IS NOT NULL)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A graph for each nation: neighbouring lines of an order by one supplier nation, with types by flag."""
    w = Window.partitionBy("n_name", "l_orderkey").orderBy("ord")
    rows = lines(spark, sf).withColumn("ord", order_key()).select("*", F.lead("l_partkey").over(w).alias("_next")).where("_next is not null")
    kind = F.when(F.col("l_returnflag") == "A", "activates").when(F.col("l_returnflag") == "R", "interacts_with").otherwise("associated_with")
    return rows.select(F.col("n_name").alias("graph_id"), symbol("l_partkey").alias("source_id"), symbol("_next").alias("target_id"), kind.alias("edge_type"), F.round(0.5 + F.abs("l_discount"), 2).alias("weight"), F.concat(F.lit("DB"), (F.col("l_linenumber") % 3).cast("string")).alias("source_db"), F.when(F.col("l_linestatus") == "F", "genetic_association").otherwise("literature").alias("evidence_class"), F.array(F.concat(F.lit("P"), (F.col("l_suppkey") % 4).cast("string"))).alias("primary_sources"), "ord")


EDGES_SQL = f"""eraw AS (SELECT *, {ORDER_SQL} AS ord, lead(l_partkey) OVER (PARTITION BY n_name, l_orderkey ORDER BY {ORDER_SQL}) AS nxt FROM {LINES_SQL}),
edges AS (SELECT n_name AS graph_id, 'G' || (l_partkey % 500)::VARCHAR AS source_id, 'G' || (nxt % 500)::VARCHAR AS target_id,
 CASE l_returnflag WHEN 'A' THEN 'activates' WHEN 'R' THEN 'interacts_with' ELSE 'associated_with' END AS edge_type,
 round(0.5 + abs(l_discount), 2) AS weight, 'DB' || (l_linenumber % 3)::VARCHAR AS source_db,
 CASE WHEN l_linestatus = 'F' THEN 'genetic_association' ELSE 'literature' END AS evidence_class, 'P' || (l_suppkey % 4)::VARCHAR AS primary_source, ord FROM eraw WHERE nxt IS NOT NULL)"""
ADMISSIBLE_SQL = "(edge_type = 'activates' OR (edge_type = 'associated_with' AND evidence_class = 'genetic_association'))"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals of nodes from two sources: line items by nation, then parts; a graph for each nation."""
    a = lines(spark, sf).select(F.col("n_name").alias("graph_id"), symbol("l_partkey").alias("node_id"), F.concat(F.lit("N"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_partkey") % 3 == 0, "protein").otherwise("gene").alias("node_type"), F.concat(F.lit("SRC"), (F.col("l_linenumber") % 3).cast("string")).alias("source"), F.round(F.abs("l_tax") * 10, 2).alias("score"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("U"), F.col("l_partkey").cast("string"))).alias("uniprot_id"), F.array(F.concat(F.lit("X"), (F.col("l_suppkey") % 3).cast("string"))).alias("pdb_ids"), F.lit("d").alias("description"), F.create_map(F.col("l_linestatus"), F.col("l_orderkey").cast("string")).alias("metadata"), order_key().alias("ord"))
    return a


NODES_SQL = f"""nodes AS (SELECT n_name AS graph_id, 'G' || (l_partkey % 500)::VARCHAR AS node_id, 'N' || l_partkey::VARCHAR AS name,
 CASE WHEN l_partkey % 3 = 0 THEN 'protein' ELSE 'gene' END AS node_type, 'SRC' || (l_linenumber % 3)::VARCHAR AS source, round(abs(l_tax) * 10, 2) AS score,
 CASE WHEN l_partkey % 2 = 0 THEN 'U' || l_partkey::VARCHAR END AS uniprot_id, 'X' || (l_suppkey % 3)::VARCHAR AS pdb, l_linestatus AS mk, l_orderkey::VARCHAR AS mv, {ORDER_SQL} AS ord FROM {LINES_SQL})"""


def facts(spark: SparkSession, sf: str, associations: DataFrame | None = None) -> DataFrame:
    """Druggability, target class and tissue of each symbol in each nation, by the columns of the canonical nodes and associations.

    associations: those of assoc, or the best of each target and datatype where they are held already.
    """
    from ..operators.biology import classified_targets, disease_class, tissue_gate

    # By description first: flags alone are summed by hash, where a largest text would have all rows sorted.
    flags = {"has_structure": F.size("pdb_ids") > 0, "has_accession": F.col("uniprot_id").isNotNull()}
    n = nodes(spark, sf).groupBy("graph_id", F.col("node_id").alias("name"), "description").agg(*(F.max(v).alias(k) for k, v in flags.items()))
    n = n.groupBy("graph_id", "name").agg(*(F.max(c).alias(c) for c in (*flags, "description")))
    drugs = (assoc(spark, sf) if associations is None else associations).groupBy(F.col("disease_id").alias("graph_id"), F.col("target_symbol").alias("name")).agg(F.max(F.col("datatype") == "known_drug").alias("tractable"))
    k = F.col("n_nationkey") % 5
    nation = table(spark, sf, "nation")
    classes = nation.select(F.col("n_name").alias("graph_id"), disease_class(F.when(k == 0, "HIV").when(k == 1, "Malaria").when(k == 2, "Lung carcinoma").otherwise("gout")).alias("disease_class"))
    part = table(spark, sf, "part").select(symbol("p_partkey").alias("gene"), F.col("p_brand").alias("family"), "p_size")
    rows = n.join(drugs, ["graph_id", "name"]).join(classes, "graph_id").withColumns({"is_druggable": F.col("has_structure"), "supported": F.lit(True), "gene": F.col("name"), "disease_id": F.col("graph_id")})
    rows = classified_targets(rows, part.where("p_size = 1").select("gene", "family"), part.where("p_size = 2").select("gene"))
    seen = lines(spark, sf).where("l_quantity > 49").select(symbol("l_partkey").alias("gene"), F.col("l_returnflag").alias("tissue"))
    wanted = nation.select(F.col("n_name").alias("disease_id"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("tissue"))
    rows = tissue_gate(rows, seen, wanted, spark.sql("SELECT 'A' AS tissue, 'a' AS canonical"))
    return rows.select("graph_id", "name", "has_structure", "has_accession", "tractable", "is_druggable", "description", "target_type", "tissue_relevant")


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as molecules with descriptor stand-ins."""
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(p.alias("id"), F.col("p_retailprice").alias("price"), (F.col("p_size") * 12.0 + 90).alias("mw"), F.round(p % 90 / 10 - 2, 2).alias("logp"), (p % 8).cast("int").alias("hbd"), (p % 13).cast("int").alias("hba"), (p % 14).cast("int").alias("rotatable"), (p % 170 * 1.0).alias("tpsa"), (p % 150 * 1.0).alias("refractivity"), (p % 90).cast("int").alias("atoms"), (p % 6).cast("int").alias("aromatic"), (p % 11 == 0).alias("basic_nitrogen"), (p % 17 == 0).alias("pains"), (p % 19 == 0).alias("reactive"), F.when(p % 7 != 0, -(p % 130) / 10.0).alias("affinity"), F.when(p % 5 != 0, (p % 100) / 100.0).alias("qed"), F.when(p % 9 != 0, 1 + (p % 90) / 10.0).alias("sa"), ((p % 50) / 50.0).alias("conf"), ((p % 20) / 20.0).alias("novelty"), (p % 5).cast("int").alias("n_filters"), "p_brand", "p_name")


MOLECULES_SQL = """molecules AS (SELECT p_partkey AS id, p_retailprice AS price, p_size * 12.0::DOUBLE + 90 AS mw, round(p_partkey % 90 / 10::DOUBLE - 2, 2) AS logp, (p_partkey % 8)::INT AS hbd, (p_partkey % 13)::INT AS hba,
 (p_partkey % 14)::INT AS rotatable, (p_partkey % 170)::DOUBLE AS tpsa, (p_partkey % 150)::DOUBLE AS refractivity, (p_partkey % 90)::INT AS atoms, (p_partkey % 6)::INT AS aromatic, p_partkey % 11 = 0 AS basic_nitrogen, p_partkey % 17 = 0 AS pains, p_partkey % 19 = 0 AS reactive,
 CASE WHEN p_partkey % 7 <> 0 THEN -(p_partkey % 130) / 10.0::DOUBLE END AS affinity, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 100) / 100.0::DOUBLE END AS qed, CASE WHEN p_partkey % 9 <> 0 THEN 1 + (p_partkey % 90) / 10.0::DOUBLE END AS sa,
 (p_partkey % 50) / 50.0::DOUBLE AS conf, (p_partkey % 20) / 20.0::DOUBLE AS novelty, (p_partkey % 5)::INT AS n_filters, p_brand, p_name FROM part)"""
