"""Helpers shared by the corpus operators: Arrow word splitting, hashing, written tables."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts on white space: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handed to the vectorised kernels in pieces of about so many UTF-8 bytes.
CHUNK_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, read by Spark alone: the folder may be in any store Spark knows."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver can but PYTHONPATH doesn't say so."""
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)
    if root not in sys.path:
        sys.path.insert(0, root)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset (tests), a temporary folder."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = found.get() if found.isDefined() else None
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="causalake-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/causalake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece have about `most` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with nulls as empty strings, without an offset into a larger buffer."""
    held = batch.column(column)
    if pa.types.is_large_string(held.type) or not pa.types.is_string(held.type):
        held = held.cast(pa.string())
    return pc.fill_null(held, "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all texts in one array, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(texts)
    words, counts = parts.flatten(), np.diff(parts.offsets.to_numpy())
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():
        kept = full.to_numpy(zero_copy_only=False)
        sums = np.concatenate(([0], np.cumsum(kept)))
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        counts = np.diff(sums[offsets])
        words = words.filter(full)
    return words, counts.astype(np.int64)


def word_ids(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense ids of the words in this piece, and the distinct words."""
    if not len(words):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    held = words.dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(strings: pa.Array) -> np.ndarray:
    """xxh3-64 of each string, as uint64."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` values, one for each start; empty where there are too few."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(k + 1))
    return out


def run_starts(counts: np.ndarray) -> np.ndarray:
    """First index of each run of the given lengths, with the total at the end."""
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def code_point(column: str):
    """A sort key by code point with null last; binary order of UTF-8 is that order."""
    return F.col(column).cast("binary").asc_nulls_last()


def guarded(docs: DataFrame, keep: tuple[str, ...], run, extra: tuple[str, ...] = ()) -> DataFrame:
    """run(docs) with all columns but `keep` under neutral names, so that none clashes with the operator's own.

    Gives the columns of docs back under their names, then `extra`, which replace columns of docs of that name.
    """
    names = [c for c in docs.columns if c not in extra]
    under = {c: c if c in keep else f"column_{i}" for i, c in enumerate(names)}
    out = run(docs.select(*(F.col(f"`{c}`").alias(a) for c, a in under.items())))
    return out.select(*(F.col(a).alias(c) for c, a in under.items()), *extra)
