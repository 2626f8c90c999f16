"""Landed service responses (JSON text, one row each) as nodes and edges; services themselves are called outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key, strip_tags


def ranked_hits(hits: DataFrame, name: str = "query", label: str = "label", size: str = "n_descendants") -> DataFrame:
    """One hit for each query: an exact name, else the broadest that contains it, else the first."""
    q, x = F.lower(name), F.lower(label)
    w = Window.partitionBy(name).orderBy(F.when(q == x, 0).when(x.contains(q), 1).otherwise(2), F.when(x.contains(q), -F.coalesce(F.col(size), F.lit(0))).otherwise(0), "ord")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def causal_then_correlated(causal: DataFrame, correlated: DataFrame, most: int = 50) -> DataFrame:
    """Associations of two strengths (0.85, 0.60), the stronger first, one for each symbol, capped for each disease."""
    rows = causal.select("disease_id", "symbol", "ord", F.lit(0.85).alias("score")).union(correlated.select("disease_id", "symbol", "ord", F.lit(0.60).alias("score")))
    w = Window.partitionBy("disease_id", match_key("symbol")).orderBy(F.desc("score"), "ord")
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    cap = Window.partitionBy("disease_id").orderBy(F.desc("score"), "ord")
    return rows.withColumn("_n", F.row_number().over(cap)).where(F.col("_n") <= most).drop("_n")


def association_page(pages: DataFrame, body: str = "body") -> DataFrame:
    """disease_id, symbol, target_id, score, datatype_scores from association pages."""
    kind = "struct<data:struct<disease:struct<id:string,associatedTargets:struct<rows:array<struct<score:double,target:struct<id:string,approvedSymbol:string>,datatypeScores:array<struct<id:string,score:double>>>>>>>>"
    d = pages.select(F.from_json(body, kind).alias("j")).select("j.data.disease.*").select("id", F.posexplode("associatedTargets.rows").alias("ord", "r"))
    return d.select(F.col("id").alias("disease_id"), F.col("r.target.approvedSymbol").alias("symbol"), F.col("r.target.id").alias("target_id"), F.col("r.score").alias("score"), F.map_from_entries(F.transform("r.datatypeScores", lambda x: F.struct(x["id"], x["score"]))).alias("datatype_scores"), "ord")


def pathways(links: DataFrame, most: int = 20) -> DataFrame:
    """gene, pathway edges from landed gene-to-pathway rows, at most so many different pathways for each graph."""
    n = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("first", "pathway"))
    first = F.min("ord").over(Window.partitionBy("graph_id", "pathway"))
    return links.withColumn("first", first).withColumn("_n", n).where(F.col("_n") <= most).select("graph_id", F.concat(F.lit("gene:"), F.col("symbol")).alias("source_id"), F.concat(F.lit("pathway:"), F.col("pathway")).alias("target_id"), F.lit("participates_in").alias("edge_type"))


def result_groups(rows: DataFrame, groups: str = "groups", each: int = 3, most: int = 15) -> DataFrame:
    """The first entries of each result group, tags stripped, capped. groups: array<array<struct<id, name>>>."""
    g = rows.select("graph_id", F.posexplode(groups).alias("g", "entries")).select("graph_id", "g", F.posexplode("entries").alias("e", "x")).where(F.col("e") < each)
    w = Window.partitionBy("graph_id").orderBy("g", "e")
    return g.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("graph_id", F.col("x.id").alias("id"), strip_tags("x.name").alias("name"))


def network_edges(rows: DataFrame, known: DataFrame, least: int = 400, most: int = 50) -> DataFrame:
    """Undirected interactions above a score (0..1000) with both ends known, the strongest first."""
    k = known.select("graph_id", match_key("symbol").alias("_a")).distinct()
    held = rows.where(F.col("score") >= least).withColumn("_a", match_key("a")).join(k, "_a").withColumn("_b", match_key("b")).join(k.withColumnRenamed("_a", "_b"), ["graph_id", "_b"], "left_semi")
    w = Window.partitionBy("graph_id").orderBy(F.desc("score"), "_a", "_b")
    held = held.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return held.select("graph_id", F.concat(F.lit("gene:"), F.col("a")).alias("source_id"), F.concat(F.lit("gene:"), F.col("b")).alias("target_id"), F.lit("interacts_with").alias("edge_type"), (F.col("score") / 1000).alias("weight"))


def best_structures(entries: DataFrame, most: int = 3) -> DataFrame:
    """The best-resolved experimental entries of each accession."""
    w = Window.partitionBy("accession").orderBy(F.asc_nulls_last("resolution"), "pdb_id")
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def tissue_levels(parts: list[DataFrame]) -> DataFrame:
    """gene, levels: tissue -> level of several sources, the first source wins, highest level first."""
    rows = parts[0].select("gene", "tissue", "level", F.lit(0).alias("src"))
    for i, p in enumerate(parts[1:], 1):
        rows = rows.union(p.select("gene", "tissue", "level", F.lit(i)))
    one = rows.groupBy("gene", "tissue").agg(F.min_by("level", "src").alias("level"))
    held = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("n"), "tissue"))), lambda x: F.struct(x["tissue"].alias("tissue"), (-x["n"]).alias("level")))
    return one.groupBy("gene").agg(held.alias("levels"))


def unique_molecules(rows: DataFrame, key: str = "canonical") -> DataFrame:
    """The first row of each canonical form."""
    w = Window.partitionBy(key).orderBy("ord")
    return rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# Words of names and functions of druggable proteins.
DRUGGABLE = ("receptor", "kinase", "protease", "enzyme", "channel", "transporter", "gpcr", "nuclear receptor")
ENTRY_SCHEMA = """struct<results:array<struct<primaryAccession:string,
 proteinDescription:struct<recommendedName:struct<fullName:struct<value:string>>>,
 comments:array<struct<commentType:string,texts:array<struct<value:string>>,subcellularLocations:array<struct<location:struct<value:string>>>>>,
 uniProtKBCrossReferences:array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>>>>"""


def protein_entries(pages: DataFrame, body: str = "body", structures: int = 10, terms: int = 20) -> DataFrame:
    """gene, uniprot_id, protein_name, function, pdb_ids, subcellular_location, is_druggable, go_terms of landed protein searches.

    pages: gene, body and, where another source tells it, druggable. The first result counts; a page without one, or that is no JSON, gives no
    row. Of several comments of a kind the last counts. An entry with a structure is druggable, one whose name or function holds one of
    the words, and one that the other source holds for druggable.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    told_so = F.coalesce("druggable", F.lit(False)) if "druggable" in pages.columns else F.lit(False)
    e = pages.select("gene", told_so.alias("_told"), F.get(F.from_json(body, ENTRY_SCHEMA)["results"], F.lit(0)).alias("e")).where("e is not null")
    notes, refs = "array<struct<commentType:string,texts:array<struct<value:string>>,subcellularLocations:array<struct<location:struct<value:string>>>>>", "array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>"
    e = e.withColumns({"_c": some(F.col("e.comments"), notes), "_x": some(F.col("e.uniProtKBCrossReferences"), refs), "protein_name": F.coalesce("e.proteinDescription.recommendedName.fullName.value", "gene")})
    told = F.filter("_c", lambda c: (c["commentType"] == "FUNCTION") & (F.size(c["texts"]) > 0))
    places = F.filter("_c", lambda c: c["commentType"] == "SUBCELLULAR LOCATION")
    where = lambda c: F.array_join(F.filter(F.transform(c["subcellularLocations"], lambda s: s["location"]["value"]), lambda v: v != ""), "; ")
    held = F.transform(F.filter("_x", lambda x: (x["database"] == "PDB") & x["id"].isNotNull()), lambda x: x["id"])
    named = F.flatten(F.transform(F.filter("_x", lambda x: x["database"] == "GO"), lambda x: F.transform(F.filter(some(x["properties"], "array<struct<key:string,value:string>>"), lambda p: p["key"] == "GoTerm"), lambda p: text(p["value"]))))
    e = e.withColumns({"function": text(F.get(F.transform(told, lambda c: c["texts"][0]["value"]), F.size(told) - 1)), "subcellular_location": text(F.get(F.transform(places, where), F.size(places) - 1)), "_pdb": held})
    words = F.lower(F.concat_ws("\n", "protein_name", "function")).rlike("|".join(DRUGGABLE)) | (F.size("_pdb") > 0) | F.col("_told")
    return e.select("gene", text(F.col("e.primaryAccession")).alias("uniprot_id"), "protein_name", "function", F.slice("_pdb", 1, structures).alias("pdb_ids"), "subcellular_location", words.alias("is_druggable"), F.slice(named, 1, terms).alias("go_terms"))


def _fields(pages: DataFrame, *keep: str) -> DataFrame:
    """Lines of two tab-separated fields or more, in order: keep, line, a, b."""
    rows = pages.select(*keep, F.posexplode(F.split(F.trim(F.coalesce("body", F.lit(""))), "\n")).alias("line", "t")).withColumn("p", F.split("t", "\t"))
    return rows.where(F.size("p") > 1).select(*keep, "line", F.trim(F.col("p")[0]).alias("a"), F.col("p")[1].alias("b"))


def exact_symbols(pages: DataFrame) -> DataFrame:
    """gene_id of each symbol: the first human hit whose own symbol is the one asked for, in either case.

    pages: symbol, body, lines `hsa:1234<tab>SYMBOL, OTHER; description`. Hits that hold the symbol among other names or in the
    description don't count; a symbol without an exact hit gives no row.
    """
    first = F.trim(F.regexp_extract("b", "^([^,;]*)", 1))
    rows = _fields(pages.select("symbol", "body").distinct(), "symbol").where(F.col("a").startswith("hsa:") & (F.upper(first) == F.upper("symbol")))
    return rows.groupBy("symbol").agg(F.min_by("a", "line").alias("gene_id"))


def symbol_pathways(asked: DataFrame, hits: DataFrame, links: DataFrame, names: DataFrame | None = None, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Pathway nodes and gene-to-pathway edges of each graph's symbols.

    asked: graph_id, ord, symbol; hits: symbol, body; links: gene_id, body (`hsa:1<tab>path:hsa1`); names: pathway, body with a NAME line. Genes
    are taken by ord until a graph has `most` pathways: a gene begun before is taken whole, so there can be a few more.
    """
    found = _fields(links, "gene_id").select("gene_id", "line", F.trim("b").alias("pathway")).where(F.col("pathway").startswith("path:hsa"))
    rows = asked.join(exact_symbols(hits), "symbol").join(found, "gene_id")
    firsts = rows.groupBy("graph_id", "pathway").agg(F.min("ord").alias("ord")).groupBy("graph_id", "ord").agg(F.count("*").alias("_new"))
    # One row for each gene that brings a pathway: the running sum is over a graph's genes, not its links.
    before = F.coalesce(F.sum("_new").over(Window.partitionBy("graph_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = firsts.withColumn("_b", before).where(F.col("_b") < most).groupBy("graph_id").agg(F.max("ord").alias("_last"), F.max(F.col("_b") + F.col("_new")).alias("_all"))
    rows = rows.join(last, "graph_id").where((F.col("ord") <= F.col("_last")) | (F.col("_all") < most))
    edges = rows.select("graph_id", F.concat(F.lit("gene:"), "symbol").alias("source_id"), F.concat(F.lit("pathway:"), "pathway").alias("target_id"), F.lit("participates_in").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit("KEGG").alias("source_db"))
    nodes = rows.select("graph_id", "pathway").distinct()
    if names is not None:
        line = F.get(F.filter(F.split("body", "\n"), lambda x: x.startswith("NAME")), F.lit(0))
        said = names.select("pathway", F.trim(F.substring_index(F.trim(F.substring(line, 13, 1 << 30)), " - ", 1)).alias("_name"))
        nodes = nodes.join(said, "pathway", "left")
    else:
        nodes = nodes.withColumn("_name", F.lit(None).cast("string"))
    name = F.coalesce(F.nullif("_name", F.lit("")), "pathway")
    return nodes.select("graph_id", F.concat(F.lit("pathway:"), "pathway").alias("node_id"), name.alias("name"), F.lit("pathway").alias("node_type"), F.lit("KEGG").alias("source"), F.lit(0.8).alias("score"), F.create_map(F.lit("kegg_id"), "pathway").alias("metadata")), edges
