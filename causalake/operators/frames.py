"""Associations: genetic filter, candidate frames, top targets, corpus census. All diseases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import specificity
from ..functions.text import match_key
from ..schemas import GENETIC


def genetic(assoc: DataFrame) -> DataFrame:
    """Rows that carry genetic evidence: a genetic datatype and a score above 0."""
    return assoc.where(F.col("datatype").isin(*GENETIC) & (F.col("score") > 0))


def candidate_frame(assoc: DataFrame) -> DataFrame:
    """disease_id, target_symbol: the distinct candidates of each disease."""
    return genetic(assoc).select("disease_id", "target_symbol").distinct()


def genetic_diseases(assoc: DataFrame) -> DataFrame:
    return genetic(assoc).select("disease_id").distinct()


def corpus_diseases(assoc: DataFrame, trials: DataFrame) -> DataFrame:
    """Diseases with genetic evidence and at least one trial target; trials: (disease_id, targets array)."""
    return genetic_diseases(assoc).join(trials.where(F.size("targets") > 0).select("disease_id"), "disease_id", "left_semi")


def resolve_disease_id(assoc: DataFrame, candidates: list[str]) -> str:
    """The one candidate id with genetic evidence; none or several are errors."""
    found = [r[0] for r in genetic_diseases(assoc).where(F.col("disease_id").isin(candidates)).limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} candidate id has genetic evidence: {candidates}")
    return found[0]


def census(assoc: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct diseases, those with genetic evidence, exact median frame size and number of pairs.

    One row (or one for each value of `by`), zeros for an empty release. Two grouped aggregates; no loop over diseases.
    """
    size = candidate_frame(assoc) if not by else genetic(assoc).select(*by, "disease_id", "target_symbol").distinct()
    frames = size.groupBy(*by, "disease_id").agg(F.count("*").alias("n"))
    sums = frames.groupBy(*by).agg(F.count("*").alias("genetic"), F.median("n").alias("median"), F.sum("n").alias("pairs"))
    total = assoc.groupBy(*by).agg(F.count_distinct("disease_id").alias("n_diseases"))
    held = total.join(sums, list(by), "left") if by else total.join(F.broadcast(sums))  # one row each
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return held.select(*by, "n_diseases", zero("genetic", 0).alias("n_genetic_diseases"), zero("median", 0.0).alias("median_frame"), zero("pairs", 0).alias("n_pairs"))


def census_rollup(assoc: DataFrame) -> DataFrame:
    """Rows and mean score by datatype and disease with all subtotals: an extension, the reference has no rollup."""
    return assoc.rollup("datatype", "disease_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def diseases_per_symbol(assoc: DataFrame) -> DataFrame:
    """_symbol, n_associated_diseases over all datatypes; symbols are trimmed."""
    return assoc.groupBy(F.trim("target_symbol").alias("_symbol")).agg(F.count_distinct("disease_id").alias("n_associated_diseases"))


def top_genetic_targets(assoc: DataFrame, n: int = 25) -> DataFrame:
    """The n best targets of every disease by genetic score, then symbol; with the symbol's reach over all diseases.

    score is the largest over genetic datatypes, at most 1. The window ranks within disease_id behind a partial
    aggregate; Spark's window-group limit drops all but n rows of a disease before the shuffle.
    """
    best = genetic(assoc).groupBy("disease_id", F.trim("target_symbol").alias("target_symbol")).agg(F.least(F.lit(1.0), F.max("score")).alias("score"))
    order = Window.partitionBy("disease_id").orderBy(F.desc("score"), "target_symbol")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    reach = diseases_per_symbol(assoc)
    out = best.join(reach, best["target_symbol"] == reach["_symbol"]).drop("_symbol")
    return out.withColumn("specificity", F.round(specificity("n_associated_diseases"), 4))


def datatype_scores(assoc: DataFrame) -> DataFrame:
    """disease_id, target_symbol, first target_id and a map of the largest positive score by datatype."""
    best = assoc.where("score > 0").groupBy("disease_id", "target_symbol", "datatype").agg(F.max("score").alias("score"), F.min("target_id").alias("target_id"))
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("datatype", "score"))))
    return best.groupBy("disease_id", "target_symbol").agg(F.min("target_id").alias("target_id"), held.alias("datatype_scores"))


def best_scores(assoc: DataFrame) -> DataFrame:
    """disease_id, target_symbol, datatype with their largest score: all that snapshot_graph reads of a release."""
    return assoc.groupBy("disease_id", "target_symbol", "datatype").agg(F.max("score").alias("score"))


def score_maps(assoc: DataFrame) -> DataFrame:
    """disease_id, target_symbol and a map of the largest positive score by datatype."""
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("datatype", "score"))))
    return best_scores(assoc.where("score > 0")).groupBy("disease_id", "target_symbol").agg(held.alias("datatype_scores"))


def evidence_class(scores) -> Column:
    """The strongest class of evidence in a map of datatype scores, or an empty string."""
    m = F.col(scores) if isinstance(scores, str) else scores
    has = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)) > 0, F.lit(False))
    return F.when(has(GENETIC[0]), GENETIC[0]).when(has(GENETIC[1]), GENETIC[1]).when(F.exists(F.map_values(m), lambda v: v > 0), "literature").otherwise("")


def snapshot_graph(assoc: DataFrame, n: int = 25) -> tuple[DataFrame, DataFrame]:
    """Nodes and association edges of every disease from a release."""
    top = top_genetic_targets(assoc, n).join(score_maps(assoc), ["disease_id", "target_symbol"])
    node = F.concat(F.lit("gene:"), F.col("target_symbol"))
    nodes = top.select(F.col("disease_id").alias("graph_id"), node.alias("node_id"), F.col("target_symbol").alias("name"), F.lit("gene").alias("node_type"), F.lit("Open Targets").alias("source"), "score", "n_associated_diseases", "datatype_scores", match_key(node).alias("key"))
    edges = top.select(F.col("disease_id").alias("graph_id"), node.alias("source_id"), F.concat(F.lit("disease:"), F.regexp_replace(F.lower("disease_id"), " ", "_")).alias("target_id"), F.lit("associated_with").alias("edge_type"), F.col("score").alias("weight"), F.lit("Open Targets").alias("source_db"), evidence_class("datatype_scores").alias("evidence_class"))
    return nodes, edges
