"""Operator 3, quality rules: an isolation forest on rule statistics.

Each text gets statistics of the kind that quality rules use. A forest of random splits, grown on a
bounded hash-ordered sample, gives each text the mean length of its paths: odd texts are isolated early. The
threshold is calibrated on all labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import pieces, read, run_starts, split_words, texts_of, word_ids, written

#: Trees, rows that each tree is grown on, and rows of the sample they are drawn from.
TREES, ROWS, SAMPLE = 300, 128, 16_384
SEED = 20240229
#: Scores are calibrated on a grid of so many steps.
GRID = 2000
#: Rules that reject by themselves.
FEW_WORDS, REPEATED_PERCENT = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "marks", "upper", "dup_lines", "repeat_words", "no_letter_words")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def repeated_words(ids: np.ndarray, counts: np.ndarray, distinct: int, width: int = 3) -> np.ndarray:
    """For each text, words inside runs of `width` words that occur twice or more in it. Exact."""
    at, n = run_starts(counts), len(ids)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(np.arange(n) + width <= at[1:][doc]) if n else np.zeros(0, np.int64)
    key, base = ids[start], distinct + 1
    for k in range(1, width):
        if base > 1 << 40:
            found, key = np.unique(key, return_inverse=True)
            base = len(found) + 1
        key = key * (distinct + 1) + ids[start + k]
        base *= distinct + 1
    _, key = np.unique(key, return_inverse=True)
    _, key, times = np.unique(key * len(counts) + doc[start], return_inverse=True, return_counts=True)
    twice = start[times[key] > 1]
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + width, -1)
    return _per_text(np.cumsum(cover)[:n] > 0, at)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the contract and the features of the forest, for texts without nulls."""
    words, counts = split_words(texts)
    ids, distinct = word_ids(words)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    of = {k: _per_text(table[raw], at) for k, table in (("symbol", _SYMBOL), ("mark", _MARK), ("upper", _UPPER), ("letter", _LETTER & _HEAD), ("char", _HEAD & ~_SPACE))}
    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
    flat = lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0)
    line_doc, (line, _) = line_doc[full.to_numpy(zero_copy_only=False)], word_ids(flat.filter(full))
    n_lines = np.bincount(line_doc, minlength=len(texts))
    once = np.unique(line_doc * (len(flat) + 1) + line)
    dup = n_lines - np.bincount(once // (len(flat) + 1), minlength=len(texts))
    repeat = repeated_words(ids, counts, len(distinct))
    no_letter = ~pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
    out = dict(zip(COUNTS, (counts, of["char"], of["symbol"], dup, repeat), strict=True))
    n, chars = np.maximum(counts, 1), np.maximum(of["char"], 1)
    features = (of["symbol"] / chars, of["mark"] / chars, of["upper"] / np.maximum(of["letter"], 1), dup / np.maximum(n_lines, 1), repeat / n, _per_text(no_letter[ids], run_starts(counts)) / n)
    return out, np.stack(features, axis=1).astype(np.float64)


class Forest:
    """An isolation forest: arrays of split features, cut points and path lengths of complete binary trees."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = ROWS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(size, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        nodes = (1 << (self.depth + 1)) - 1
        self.feature = np.full((trees, nodes), -1, np.int16)
        self.cut = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        for t in range(trees):
            held = rows[rng.choice(len(rows), self.size, replace=False)] if self.size else rows
            stack = [(0, 0, held)]
            while stack:
                node, depth, part = stack.pop()
                self.length[t, node] = depth + self.average(len(part))
                if depth >= self.depth or len(part) < 2:
                    continue
                low, high = part.min(0), part.max(0)
                wide = np.flatnonzero(high > low)
                if not len(wide):
                    continue
                f = int(rng.choice(wide))
                c = float(rng.uniform(low[f], high[f]))
                left = part[:, f] < c
                self.feature[t, node], self.cut[t, node] = f, c
                stack += [(2 * node + 1, depth + 1, part[left]), (2 * node + 2, depth + 1, part[~left])]

    @staticmethod
    def average(n: int) -> float:
        """The mean path of an unsuccessful search among n keys."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; higher is odder."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[at, f] >= cut[node]))
            total += length[node]
        scale = self.average(self.size)
        return 2 ** -(total / len(self.feature) / scale) if scale else np.full(len(rows), 0.5)


def _with_statistics(docs: DataFrame, text: str, forest=None, keep=()) -> DataFrame:
    """The columns of `keep`, the counts, base_failed, and the features or (with a broadcast forest) the score."""
    last = StructField("score", DoubleType()) if forest is not None else StructField("features", ArrayType(DoubleType()))
    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTS] + [StructField("base_failed", BooleanType()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            counts, features = statistics(texts_of(piece, text))
            failed = (counts["n_words"] < FEW_WORDS) | (100 * counts["n_repeat_words"] > REPEATED_PERCENT * counts["n_words"])
            held = {c: piece.column(c) for c in keep} | {c: pa.array(counts[c].astype(np.int64)) for c in COUNTS} | {"base_failed": pa.array(failed)}
            if forest is not None:
                held["score"] = pa.array(forest.value.score(features))
            else:
                held["features"] = pa.array(features.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(held)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def grow(docs: DataFrame, key: str = "doc_id", text: str = "text"):
    """A forest, as a broadcast of fixed size, grown on the first SAMPLE rows in the order of a hash of the key."""
    n = docs.count()
    rows = docs.select(F.xxhash64(key, F.length(text)).alias("_h"), F.col(text).alias("_t"))
    rows = rows.where(F.pmod("_h", F.lit(1 << 40)) < float(1 << 40) * min(1.0, 2 * SAMPLE / max(n, 1)))
    rows = _with_statistics(rows, "_t", keep=("_h",)).orderBy("_h", *COUNTS, "features").limit(SAMPLE).select("features")
    held = np.array([r[0] for r in rows.collect()]).reshape(-1, len(FEATURES))
    return docs.sparkSession.sparkContext.broadcast(Forest(held))


def calibrated(scored: DataFrame, labels: DataFrame, key: str = "doc_id") -> float | None:
    """The score above which a text is rejected, from all labelled rows that the base rules pass.

    The best sum of the shares of good rows kept and bad rows rejected; of equally good thresholds the middle of
    the highest stretch. None (nothing is rejected) unless there are rows of both labels.
    """
    known = labels.where(F.col("quality").isNotNull()).select(F.col(key).alias("_key"), F.col("quality").cast("int").alias("quality"))
    rows = scored.where(~F.col("base_failed")).join(known, F.col(key) == F.col("_key"))
    step = F.least(F.floor(F.col("score") * GRID), F.lit(GRID - 1)).cast("int")
    table = np.zeros((2, GRID), np.int64)
    for r in rows.groupBy(step.alias("step"), (F.col("quality") > 0).cast("int").alias("good")).count().collect():  # 2 * GRID rows at most
        table[r["good"], r["step"]] += r["count"]
    bad, good = table
    if not bad.sum() or not good.sum():
        return None
    kept = np.cumsum(good) / good.sum()  # threshold at the end of each step
    caught = 1 - np.cumsum(bad) / bad.sum()
    value = np.round(kept + caught, 9)
    last = int(np.flatnonzero(value == value.max())[-1])
    first = last
    while first and value[first - 1] == value[last]:
        first -= 1
    return ((first + last) / 2 + 1) / GRID


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts, base_failed, score and kept for every row of docs.

    Null and empty texts have counts of 0 and fail the base rules. Rows with the same text get the same verdict.
    A forest grown on no rows gives every text the score 0.5. Labels may repeat a key (each row counts), name
    keys that docs lacks (ignored) and hold nulls (ignored); without good and bad labels only the base rules reject.
    The scores are written once to the shared folder, without the texts; the texts are read once for them.
    """
    scored = written(_with_statistics(docs, text, grow(docs, key, text), keep=(key,)), "quality-scores")
    cut = calibrated(scored, labels, key)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.lit(True) if cut is None else F.col("score") <= cut))


def passed(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns: calibrated as judged(), then filtered where they lie."""
    forest = grow(docs, key, text)
    cut = calibrated(written(_with_statistics(docs, text, forest, keep=(key,)), "quality-scores"), labels, key)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            counts, features = statistics(texts_of(piece, text))
            good = (counts["n_words"] >= FEW_WORDS) & (100 * counts["n_repeat_words"] <= REPEATED_PERCENT * counts["n_words"])
            if cut is not None:
                good &= forest.value.score(features) <= cut
            yield piece.select(names).filter(pa.array(good))

    return docs.mapInArrow(run, schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    return judged(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept", "score")
