"""Operator 5, benchmark decontamination by an FM-index per shard of the training texts.

A shard is a piece of a partition: its words are numbered by the benchmark's vocabulary, all other words are
separators, and runs too short for any window are left out; no window could occur there. The index of the shard is
searched backward for all windows at once, occurrences are located by sampled suffix positions, and covered
words are merged into removal spans. A map over the documents: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import guarded, pieces, read, run_starts, split_words, texts_of
from .fm_index import MOST, FMIndex

#: Words of a window; a longer benchmark is searched in blocks of about so many bytes.
WINDOW, BLOCK_BYTES = 13, 16 << 20
#: A document is contaminated if at least one of so many of its words is hit.
ONE_IN = 20

#: A-Z to a-z; digits, a-z and all bytes beyond ASCII stay; the rest separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """Texts (no nulls) with A-Z lower-cased and every separator a space."""
    data = texts.buffers()[2]
    if data is None:
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]).translate(FOLD)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return split_words(folded(texts))


class Windows:
    """The windows of a block of benchmark items, ready for search."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW) -> None:
        words, counts = words_of(pa.array(texts, pa.string()))
        self.vocabulary = pc.unique(words)
        number = pc.index_in(words, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.sigma = len(self.vocabulary) + 1
        rows, owner, at = [], [], run_starts(counts)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            width = min(window, b - a)
            if width:
                held = np.lib.stride_tricks.sliding_window_view(number[a:b], width)
                full = np.zeros((len(held), window), np.int64)
                full[:, window - width :] = held
                rows.append(full)
                owner.append(np.full(len(held), i))
        rows = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(np.stack((which.ravel(), owner)), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
        self.lengths = (self.patterns > 0).sum(1)
        self.items, self.item_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.patterns) + 1))
        self.ids = ids
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def search(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which words are hit, and pairs (text, item) with occurring windows, in arrays."""
        n = len(words)
        hit = np.zeros(n + 1, np.int32)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not n or not len(self.patterns):
            return hit[:n] > 0, [none]
        number = pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        doc = np.repeat(np.arange(len(counts)), counts)
        # Runs of words of the vocabulary inside one text, long enough for the shortest window.
        start = np.ones(n, bool)
        start[1:] = (number[1:] == 0) | (number[:-1] == 0) | (doc[1:] != doc[:-1])
        run = np.cumsum(start) - 1
        size = np.bincount(run)
        at = np.flatnonzero((number > 0) & (size >= self.shortest)[run])
        found = []
        for part in self._parts(at, run):
            text, back = self._text(part, run, number)
            index = FMIndex(text, self.sigma)
            lo, hi = index.ranges(self.patterns, self.lengths)
            which, where = index.occurrences(lo, hi)
            if not len(which):
                continue
            first = back[where]
            np.add.at(hit, first, 1)
            np.add.at(hit, first + self.lengths[which], -1)
            pairs = np.unique(np.stack((doc[first], which)), axis=1)
            many = self.item_at[pairs[1] + 1] - self.item_at[pairs[1]]
            base = np.repeat(self.item_at[pairs[1]] - (np.cumsum(many) - many), many)
            held = np.stack((np.repeat(pairs[0], many), self.items[base + np.arange(many.sum())]))
            found.append(tuple(np.unique(held, axis=1)))
        return np.cumsum(hit)[:n] > 0, found or [none]

    def _parts(self, at: np.ndarray, run: np.ndarray) -> Iterator[np.ndarray]:
        """Cut the kept words for indexes of bounded size; a cut repeats enough words to lose no window."""
        most, lap = MOST // 3, self.patterns.shape[1] - 1
        for a in range(0, len(at), most):
            yield at[max(0, a - lap) : a + most]

    @staticmethod
    def _text(at: np.ndarray, run: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words with a separator behind each run, and the place of each in the piece."""
        held = run[at]
        gap = np.zeros(len(at), np.int64)
        gap[1:] = np.cumsum(held[1:] != held[:-1])
        place = np.arange(len(at)) + gap
        text = np.zeros(int(place[-1]) + 2, np.int64)
        back = np.zeros(len(text), np.int64)
        text[place], back[place] = number[at], at
        return text, back


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def blocks_of(bench: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[Windows]:
    """The benchmark in blocks of about BLOCK_BYTES, cut by a hash of item and text."""
    rows = bench.where(F.length(text) > 0).select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for b in range(n):
        held = sorted(((r["i"] or "", r["t"]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()))
        if held:
            yield Windows([i for i, _ in held], [t for _, t in held], window)


def benchmark_hits(docs: DataFrame, bench: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, hits (covered word ranges, merged), items (ids of the items, sorted), n_hit, contaminated.

    Null texts have no words and are never contaminated; nor are texts without words. An empty benchmark, and
    items with null or wordless texts, hit nothing; a null item id counts as an empty string. Equal items under
    several ids are all reported. Repeated rows and equal texts get equal results; texts of any length are
    searched whole. Columns of docs with one of the new names are replaced. Each block of the benchmark (BLOCK_BYTES
    of text) is a broadcast and a pass over the rows inside the same stage.
    """
    new = ["n_words", "hits", "items", "n_hit", "contaminated"]
    rest = [c for c in docs.columns if c not in new]
    schema = StructType([docs.schema[c] for c in rest] + [StructField("n_words", LongType()), StructField("hits", SPANS), StructField("items", ArrayType(StringType())), StructField("n_hit", LongType()), StructField("contaminated", BooleanType())])
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks_of(bench, item, text, window)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            words, counts = words_of(texts_of(piece, text))
            at = run_starts(counts)
            hit, names = np.zeros(len(words), bool), [set() for _ in range(piece.num_rows)]
            for block in blocks:
                found, pairs = block.value.search(words, counts)
                hit |= found
                for d, i in pairs:
                    for x, y in zip(d.tolist(), i.tolist(), strict=True):
                        names[x].add(block.value.ids[y])
            sums = np.concatenate(([0], np.cumsum(hit)))
            n_hit = sums[at[1:]] - sums[at[:-1]]
            spans = [[] for _ in range(piece.num_rows)]
            for d in np.flatnonzero(n_hit).tolist():
                edge = np.diff(np.concatenate(([0], hit[at[d] : at[d + 1]].astype(np.int8), [0])))
                spans[d] = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
            held = {c: piece.column(c) for c in rest}
            held["n_words"] = pa.array(counts)
            held["hits"] = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            held["items"] = pa.array([sorted(x) for x in names], pa.list_(pa.string()))
            held["n_hit"] = pa.array(n_hit.astype(np.int64))
            held["contaminated"] = pa.array((n_hit > 0) & (ONE_IN * n_hit >= counts))
            yield pa.RecordBatch.from_pydict(held)

    return docs.select(*rest).mapInArrow(find, schema)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word ranges) and what separates words inside a span."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def decontaminated(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """docs without contaminated rows; in the others, what windows cover is cut from the text. Any column names."""
    return guarded(docs, (text,), lambda d: _decontaminated(d, bench, text))


def _decontaminated(docs: DataFrame, bench: DataFrame, text: str) -> DataFrame:
    rows = benchmark_hits(docs, bench, text=text).where(~F.col("contaminated")).select(*docs.columns, "hits")
    rest = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = batch.column("hits").to_pylist()
            texts = [cut_words(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_pydict({c: pa.array(texts, pa.string()) if c == text else batch.column(c) for c in rest})

    return rows.mapInArrow(cut, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs, bench = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    found = benchmark_hits(docs, bench)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
