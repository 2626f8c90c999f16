"""Operator 2, quality classifier by importance resampling.

Two generative models of hashed one- and two-word n-grams: one of target text (labelled good), one of all raw
text. A document's importance is the ratio of the two models; adding Gumbel noise and taking the top k draws k
documents without replacement in proportion to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import hash_strings, mix, pieces, read, run_starts, split_words, texts_of, word_ids, written

#: Buckets of n-grams; labelled target documents that the target model is fitted on, in hash order, at most.
BUCKETS, TARGETS = 1 << 18, 50_000
#: Pseudo-count of each bucket in both models; it alone draws the ratio of rare buckets toward 1.
PRIOR = 5.0
#: Rows among which the cut of the top k is found by value; bins of each step toward it.
FEW, BINS = 10_000, 4096


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, and how many each text has. Lower-cased words and marks are tokens."""
    apart = pc.replace_substring_regex(pc.utf8_lower(texts), r"([^\p{L}\p{N}\s]+)", r" \1 ")
    words, counts = split_words(apart)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ids, distinct = word_ids(words)
    word = mix(hash_strings(distinct))[ids]
    doc = np.repeat(np.arange(len(counts)), counts)
    pair = mix(word[:-1] + mix(word[1:]))
    start = np.flatnonzero(doc[:-1] == doc[1:])
    bucket = np.concatenate((word, pair[start])) & np.uint64(BUCKETS - 1)
    owner = np.concatenate((doc, doc[start]))
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64), np.bincount(owner, minlength=len(texts))


def model(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all n-grams by bucket; a task sends BUCKETS numbers, and as many come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for piece in pieces(batches, text):
            held += np.bincount(grams(texts_of(piece, text))[0], minlength=BUCKETS)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(held[some], pa.int64())})

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of target over raw probability by bucket; raw counts are scaled to the target's total before the pseudo-count.

    All zeros if either text has no n-gram.
    """
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    return np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))


def weighed(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_grams, log_weight and the same with Gumbel noise of a hash of key and text."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers
    schema = StructType([docs.schema[key], StructField("_noise", DoubleType()), StructField("n_grams", LongType()), StructField("log_weight", DoubleType())])
    uniform = (F.pmod(F.xxhash64(key, text, F.lit(2024)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            bucket, counts = grams(texts_of(piece, text))
            sums = np.concatenate(([0.0], np.cumsum(table.value[bucket])))
            at = run_starts(counts)
            held = {c: piece.column(c) for c in (key, "_noise")}
            yield pa.RecordBatch.from_pydict(held | {"n_grams": pa.array(counts.astype(np.int64)), "log_weight": pa.array(sums[at[1:]] - sums[at[:-1]])})

    rows = docs.select(key, text, uniform.alias("_noise")).mapInArrow(weigh, schema)
    return rows.select(key, "n_grams", F.round("log_weight", 6).alias("log_weight"), (F.round("log_weight", 6) - F.log(-F.log("_noise"))).alias("gumbel_key"))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by counting in ever narrower bins; FEW values come to the driver at the end."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    if k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    while True:
        inside = rows.where(F.col(column).between(low, high))
        if n <= FEW or low == high:
            held = sorted((r[0] for r in inside.orderBy(F.desc(column)).limit(min(n, max(k, 1) if n > FEW else n)).select(column).collect()), reverse=True) if n <= FEW else [low] * k
            return held[k - 1]
        width = (high - low) / BINS
        step = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        bins = {r["step"]: r for r in inside.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for s in sorted(bins, reverse=True):
            if k <= bins[s]["n"]:
                low, high, n = bins[s]["low"], bins[s]["high"], bins[s]["n"]
                break
            k -= bins[s]["n"]


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_grams, log_weight, gumbel_key and kept for every row of docs.

    The target is the labelled rows with quality 1 that are not toxic; the raw model covers all docs. k is the share
    of such rows among all labelled ones (or `share`) times the number of docs; the k largest keys are kept,
    with all that tie with the last. Null and empty texts have weight 0 (log). Without labels every weight is 0 and
    every row is kept. Rows equal in key and text get equal keys. Null labels of quality count as unlabelled.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), ((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    total, good = known.agg(F.count("*"), F.count_if("good")).first()
    part = share if share is not None else good / total if total else 1.0
    ids = known.where("good").select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(TARGETS)
    target = docs.join(F.broadcast(written(ids, "resampling-targets")), F.col(key) == F.col("_id"), "left_semi")  # TARGETS ids at most
    ratio = log_ratio(model(target, text), model(docs, text))
    rows = written(weighed(docs, ratio, key, text), "resampling-weights")
    n = rows.count()
    cut = kth_largest(rows, "gumbel_key", round(part * n)) if n and part < 1 else -math.inf
    return rows.withColumn("kept", F.col("gumbel_key") >= F.lit(cut))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importance of every document and whether it is drawn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, read(spark, sf_dir, "labels")).select("doc_id", "n_grams", "log_weight", "gumbel_key", "kept")
