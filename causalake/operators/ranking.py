"""Ranking: stable order, quotas between pools, candidates, k nearest, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def ranked(rows: DataFrame, score: str, ties: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """rank from 1 by score, highest first, ties in the given order; within `by`, else over all rows by a sort.

    Without `by`, rows are range-sorted and numbered by partition offsets: no task gets all rows.
    """
    if by:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties)))
    spark = rows.sparkSession
    held = rows.orderBy(F.desc(score), *ties).withColumn("_p", F.spark_partition_id())
    del spark
    sizes = held.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc(score), *ties))
    return held.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p").withColumn(name, (inside + F.col("_b")).cast("int")).drop("_p", "_b")


def quota_ranking(results: DataFrame, n: int = 10, least: float = 0.3) -> DataFrame:
    """At most n results of each graph: up to half from each pool (human, pathogen) above the threshold, free places by
    order over both; if none passes, simply the first n. results: graph_id, target_type, causal_confidence, ord.

    All by windows over one partitioning on graph_id.
    """
    order = [F.desc("causal_confidence"), F.asc("ord")]
    graph = Window.partitionBy("graph_id")
    r = results.withColumn("_ok", F.col("causal_confidence") >= least)
    pool = F.lower("target_type") == "pathogen_direct"
    r = r.withColumn("_all", F.row_number().over(graph.orderBy(*order))).withColumn("_in", F.row_number().over(Window.partitionBy("graph_id", pool, "_ok").orderBy(*order)))
    r = r.withColumn("_quota", F.col("_ok") & (F.col("_in") <= n // 2))
    taken = F.sum(F.col("_quota").cast("int")).over(graph)
    r = r.withColumn("_left", F.lit(n) - taken).withColumn("_any", F.max("_ok").over(graph))
    r = r.withColumn("_spare", F.row_number().over(Window.partitionBy("graph_id", F.col("_ok") & ~F.col("_quota")).orderBy(*order)))
    take = F.when(F.col("_any"), F.col("_quota") | (F.col("_ok") & ~F.col("_quota") & (F.col("_spare") <= F.col("_left")))).otherwise(F.col("_all") <= n)
    out = r.where(take).drop("_ok", "_all", "_in", "_quota", "_left", "_any", "_spare")
    return out.withColumn("rank", F.row_number().over(graph.orderBy(*order)))


def scored_candidates(rows: DataFrame, weights: dict | None = None) -> DataFrame:
    """rows with composite_score, score_breakdown, is_drug_like and is_novel."""
    w = S.candidate_weights(weights)
    parts = S.candidate_parts("causal_confidence", "binding_affinity", "qed_score", "sa_score", "admet_score", "novelty_score")
    like = (parts["qed"] >= 0.4) & F.coalesce(F.col("molecular_weight").between(150, 500), F.lit(False)) & (F.col("n_filters_passed") >= 2)
    return rows.select("*", F.round(S.weighted(parts, w), 4).alias("composite_score"), S.breakdown(parts, w).alias("score_breakdown"), like.alias("is_drug_like"), (F.col("novelty_score") >= 0.7).alias("is_novel"))


def sized_split(rows: DataFrame, key: str, train: float = 0.9, validation: float = 0.05, seed: int = 42) -> DataFrame:
    """rows with split: exact sizes int(n * share) in the order of a hash of key and seed."""
    n = rows.count()
    a, b = int(n * train), int(n * train) + int(n * validation)
    h = F.xxhash64(F.col(key), F.lit(seed))
    out = ranked(rows.withColumn("_h", -h.cast("double")).withColumn("_t", h), "_h", ["_t", key], name="_r")
    return out.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "validation").otherwise("test")).drop("_r", "_h", "_t")


def moving_mean(rows: DataFrame, by: list[str], order: str, value: str, width: int = 50) -> DataFrame:
    """The mean of the last `width` values at each row."""
    return rows.withColumn(f"{value}_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)))


def ucb(stats: DataFrame, turn: int, c: float = 1.4) -> DataFrame:
    """arm with the largest upper confidence bound; arms never tried come first. stats: arm, n, total."""
    bound = F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(F.col("total") / F.col("n") + c * F.sqrt(F.log(F.lit(turn + 1.0)) / F.col("n")))
    return stats.select(F.max_by("arm", F.struct(bound.alias("b"), F.expr("-arm_order") if "arm_order" in stats.columns else F.lit(0))).alias("arm"))


def islands(rows: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Runs of neighbouring rows with the same flag: first, last, length."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce(F.col(flag) != F.lag(flag).over(w), F.lit(True)).cast("int")
    held = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return held.groupBy(*by, "_run", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")
