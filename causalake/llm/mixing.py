"""Operator 4, mixing sources to target weights. DataFrame functions only.

Each document gets a hash-random key. Within its source, the keys' range is cut into buckets of a few
thousand documents (the keys are uniform, so the cuts are known without sampling); bucket totals give each
bucket's offset, and a window inside the bucket the rest: a distributed prefix sum in which no task holds a
whole source. Each source is cut at its exact budget of words; a budget above the source's own words takes
whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, code_point, guarded, read, written

#: Weights of the sources by code point, repeating; share of all words that the mix has; epochs at most.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Documents of a bucket, about.
BUCKET = 2048
#: A table of at most so many sources (under 1 MB) is broadcast; a larger one is joined as Spark sees fit.
FEW_SOURCES = 8192


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, 60-bit hash-random key, tie-breaker."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"))


def budgets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, n_docs, rank, target and whole-word budget of each source.

    Targets are in proportion to the weights; a source whose share is above epochs times its own words stops
    there and the excess goes to the others by weight, until none is above. That is a water level: sources
    in order of words per weight fill up one after the other.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(code_point("source")))).withColumn("weight", turn)
    per = per.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    full = per.select(
        "*",
        F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
        (F.sum("source_size").over(every) * share).alias("total"),
    )
    # The level if this source and all after it are open; the true level is the first that this source's cap doesn't undercut.
    level = (F.col("total") - F.coalesce("before", F.lit(0.0))) / F.col("open")
    full = full.withColumn("level", level)
    true = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)
    target = F.when(true.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), true["level"] * F.col("weight")))
    return full.select("source", "source_size", "n_docs", "rank", target.alias("target"), F.floor(target).cast("long").alias("budget"))


def mix_sizes(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, tie, source_size, target, words before it in its source's order, taken.

    Null and empty texts have size 0 and take nothing; a null source is a source of its own, last in
    order. Documents with the same doc_id have the same key and go by size, then text; equal rows are
    interchangeable. An empty table gives an empty result. taken is at most epochs times the size.
    """
    rows = written(sized(docs), "mix-sizes")
    plan = written(budgets(rows, weights, share, epochs), "mix-budgets")
    few = plan.count() <= FEW_SOURCES
    plan = plan.withColumnRenamed("source", "_source")
    rows = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    buckets = F.ceil(F.col("n_docs") / BUCKET)
    rows = rows.withColumn("bucket", F.floor(F.col("key") / F.lit(float(1 << 60)) * buckets).cast("long"))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("_sum"))
    ahead = F.sum("_sum").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("rank", "bucket", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, ["rank", "bucket"]).withColumn("before", F.sum("size").over(inside) - F.col("size") + F.col("_ahead"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "source", "size", "tie", "source_size", "target", "before", whole.alias("epochs"), (whole * F.col("size") + part).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: the columns of docs, `epoch` from 0 and `taken`, a row for each time a document is taken.

    A document on its source's cut is taken in part: the text of its last row ends after the words taken.
    Documents of which no word is taken (empty ones too) are not in the mix.
    """
    return guarded(docs, ("doc_id", "text", "source"), lambda d: _mixed(d, weights, share, epochs), ("epoch", "taken"))


def _mixed(docs: DataFrame, weights: tuple, share: float, epochs: int) -> DataFrame:
    n = mix_sizes(docs, weights, share, epochs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("tie").alias("_tie"), F.col("size").alias("_size"), F.col("taken").alias("_taken")).where("_taken > 0")
    n = n.groupBy("_id", "_source", "_tie", "_size").agg(F.sort_array(F.collect_list("_taken"), asc=False).alias("_all"))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_key") == F.col("_tie"))
    rows = keyed.join(n, same)
    # Rows that agree in id, source and text are interchangeable: each takes one of the amounts.
    nth = F.row_number().over(Window.partitionBy("_id", "_source", "_tie").orderBy("_tie"))
    rows = rows.withColumn("_mine", F.element_at("_all", nth))
    times = F.ceil(F.col("_mine") / F.col("_size")).cast("int")
    rows = rows.select(*docs.columns, "_size", "_mine", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"))
    taken = F.least(F.col("_size"), F.col("_mine") - F.col("epoch") * F.col("_size"))
    rows = rows.withColumn("taken", taken)
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(parts, F.lit(1), F.col("taken").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("taken") < F.col("_size"), first).otherwise(F.col("text")))
    return rows.select(*docs.columns, F.col("epoch"), F.col("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    substr(md5('mix:' || doc_id::VARCHAR), 1, 15) AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM per),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((rank - 1) % 3 + 1)::INT] AS weight, (source_size * 2)::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE * 1.5
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
lvl AS (SELECT level AS l FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
plan AS (
  SELECT source, source_size, least(cap, coalesce((SELECT l FROM lvl) * weight, cap)) AS target FROM levels),
ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, floor(p.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM ordered)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM cut
"""
