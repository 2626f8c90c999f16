"""Operator 7, near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Document frequencies of five-word shingles over all documents, in a count-min sketch of fixed size.
2. A signature for each document: for each of K hash functions the shingle that consistent weighted sampling
   picks; two documents agree in a pick with the probability of their weighted Jaccard similarity. Picks are banded.
3. In each bucket of a band the member that meets most others leads, and each other member is compared with it.
4. Buckets whose members then lie in several classes are compared whole, but for pairs inside one class; wide
   signatures of their members leave out pairs whose similarity is below the threshold by four standard deviations.
5. Pairs are verified on whole texts by exact weighted Jaccard similarity, and verified links are closed to classes.

A shingle weighs its count times 1 + log(N / df) / log(N): from 2 for a shingle of one document to 1 for one of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import guarded, hash_strings, mix, pieces, read, run_starts, split_words, texts_of, word_ids, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 18, 4
#: Picks of a wide signature, one byte each; a pair is left out where agreement is so many standard deviations short.
WIDE, SHORT = 512, 4.0
#: The document-frequency sketch has DEPTH rows of SLOTS counts, and travels in PARTS parts.
SLOTS, DEPTH, PARTS = 1 << 17, 3, 16
#: The filter of documents that have a partner: 8 million bits, 1 MB, whatever the input.
FILTER_WORDS = 1 << 17
#: Members of a bucket that are compared with each other in one place; larger buckets are compared block by block.
BLOCK = 2048
#: Bytes of text of which shingles are held at a time.
PIECE_BYTES = 2 << 20

#: Odd multipliers of the words of a shingle.
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LOW48 = np.uint64((1 << 48) - 1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 48-bit shingle hash and count of each different shingle, in order of the texts.

    A text of one to four words has one shingle, all its words. At most 65,536 texts at a time.
    """
    words, counts = split_words(texts)
    ids, distinct = word_ids(words)
    word = hash_strings(distinct)[ids] if len(ids) else np.zeros(0, np.uint64)
    at = run_starts(counts)
    many = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(counts)), many)
    full = np.zeros(len(word), np.uint64)
    for k in range(min(SHINGLE, len(word))):
        full[: len(word) - k] += word[k:] * _TIMES[k]
    for d in np.flatnonzero((counts > 0) & (counts < SHINGLE)).tolist():
        full[at[d]] = np.uint64(counts[d]) + np.sum(word[at[d] : at[d + 1]] * _TIMES[: counts[d]], dtype=np.uint64)
    value = full[np.repeat(at[:-1] - (np.cumsum(many) - many), many) + np.arange(len(owner))]
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (owner.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16))
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    return (key[first] >> np.uint64(48)).astype(np.int64), key[first] & _LOW48, times


def small_pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Pieces of PIECE_BYTES of text and 65,536 rows at most, their different texts, and which of these each row has."""
    for piece in pieces(batches, column, PIECE_BYTES):
        for i in range(0, piece.num_rows, 1 << 16):
            part = piece.slice(i, 1 << 16)
            held = texts_of(part, column).dictionary_encode()
            yield part, held.dictionary, held.indices.to_numpy(zero_copy_only=False)


def slots_of(value: np.ndarray) -> list[np.ndarray]:
    """Where a shingle is counted in each row of the sketch."""
    h = mix(value)
    return [((h >> np.uint64(17 * d)) & np.uint64(SLOTS - 1)).astype(np.int64) + d * SLOTS for d in range(DEPTH)]


class Idf:
    """Weights by document frequency: the least count of the sketch's rows, less the mean load of a slot."""

    def __init__(self, counts: np.ndarray, n: int) -> None:
        load = counts.sum() / counts.size
        df = np.clip(counts - load, 1, max(n, 1))
        self.table = (1 + np.log(max(n, 1) / df) / math.log(max(n, 2))).astype(np.float32)

    def __call__(self, value: np.ndarray) -> np.ndarray:
        a, *more = slots_of(value)
        out = self.table[a]
        for x in more:
            out = np.maximum(out, self.table[x])
        return out


def document_frequencies(docs: DataFrame, text: str = "text") -> Idf:
    """Weights from all documents: each row counts. Tasks' sketches are summed by part; their sum comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(DEPTH * SLOTS, np.int64), 0
        for piece, texts, which in small_pieces(batches, text):
            owner, value, _ = shingles(texts)
            times = np.bincount(which, minlength=len(texts))[owner]
            for at in slots_of(value):
                held += np.bincount(at, times, DEPTH * SLOTS).astype(np.int64)
            n += piece.num_rows
        if n:
            yield _parts(held, n)

    def add(table: pa.Table) -> pa.Table:
        held = sum(np.frombuffer(_inflate(x), np.int64) for x in table.column("counts").to_pylist())
        n = pc.sum(table.column("n")).as_py()
        return pa.table({"part": table.column("part").slice(0, 1), "n": [n], "counts": pa.array([_deflate(held)], pa.binary())})

    kind = "part int, n long, counts binary"
    rows = docs.select(text).mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).collect()
    counts, n = np.zeros((PARTS, DEPTH * SLOTS // PARTS), np.int64), 0
    for r in rows:
        counts[r["part"]], n = np.frombuffer(_inflate(bytes(r["counts"])), np.int64), r["n"]
    return Idf(counts.ravel(), n)


def _deflate(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(x.tobytes())


def _inflate(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _parts(held: np.ndarray, n: int) -> pa.RecordBatch:
    parts = held.reshape(PARTS, -1)
    return pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "n": pa.array([n] * PARTS, pa.int64()), "counts": pa.array([_deflate(x) for x in parts], pa.binary())})


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of n equal parts: 1 - (1 + x) exp(-x), inverted by bisection."""
    q = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < q
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


class Sampler:
    """Consistent weighted sampling with K hash functions; draws come from quantile tables by bits of a hash.

    The pick is the shingle with the least log c - r (level - beta + 1), and that is at least log c - r - log(weight).
    The top bits of a draw's r and c (a cell) bound it from below; the least value of a text of total weight W is
    above 10 / W with probability exp(-10). So only shingles in cells that can get below that are computed in full,
    and texts for which none does are computed whole: the picks are those of the full computation.
    """

    def __init__(self, k: int = BANDS * ROWS) -> None:
        self.k = k
        g = _gamma_quantiles(1 << 16)
        self.r, self.log_c = g.astype(np.float32), np.log(g).astype(np.float32)
        with np.errstate(divide="ignore"):
            bound = (np.log(np.append(0, g[255::256][:-1]))[None, :] - np.append(g[256::256], np.inf)[:, None]).ravel()
        order = np.argsort(bound, kind="stable")
        self.rank = np.empty(1 << 16, np.uint16)
        self.rank[order] = np.arange(1 << 16)
        self.bounds = bound[order]

    def picks(self, owner: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """(texts, K) picks as 32-bit identities of (shingle, level), whatever texts stand beside; 0 for texts without shingles."""
        out = np.zeros((texts, self.k), np.uint32)
        if not len(owner):
            return out
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        size = np.diff(np.append(head, len(owner)))
        log_w = np.log(weight).astype(np.float32)
        most = np.log(10 / np.add.reduceat(weight.astype(np.float64), head)) + np.maximum.reduceat(log_w, head)
        cut = np.repeat(np.searchsorted(self.bounds, most, side="right").clip(0, 65535), size).astype(np.uint16)
        local = np.repeat(np.arange(len(head)), size)
        best, missing = np.zeros((len(head), self.k), np.uint32), np.zeros(len(head), bool)
        for k, draw, cell in self._draws(value):
            some = np.flatnonzero(self.rank[cell] < cut)
            missing |= self._least(k, draw[some], cell[some], log_w[some], local[some], best)
        if missing.any():
            rows = np.flatnonzero(missing[local])
            for k, draw, cell in self._draws(value[rows]):
                self._least(k, draw, cell, log_w[rows], local[rows], best)
        out[owner[head]] = best
        return out

    def _draws(self, value: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for k in range(self.k):
            if k % 4 == 0:
                draw = mix(value + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                cells = draw.view(np.uint16).reshape(-1, 4)
            yield k, draw, np.ascontiguousarray(cells[:, k % 4])

    def _least(self, k: int, draw: np.ndarray, cell: np.ndarray, log_w: np.ndarray, local: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Fill best[:, k] for the texts that appear in local; which texts don't."""
        missing = np.ones(len(best), bool)
        if not len(local):
            return missing
        g = (draw ^ np.uint64(0x632BE59BD9B4E019 * (k % 4 + 1) & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        high = cell.astype(np.int64)
        r = self.r[(high & 0xFF00) | (g >> np.uint64(56)).astype(np.int64)]
        log_c = self.log_c[((high & 0xFF) << 8) | ((g >> np.uint64(48)).astype(np.int64) & 0xFF)]
        beta = ((g >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        level = np.floor(log_w / r + beta)
        bits = (log_c - r * (level - beta + np.float32(1))).view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        who = (g ^ (level.astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xBF58476D1CE4E5B9)
        code = (bits.astype(np.uint64) << np.uint64(32)) | (who >> np.uint64(32))
        head = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        best[local[head], k] = (np.minimum.reduceat(code, head) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        missing[local[head]] = False
        return missing


def banded(picks: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands of (texts, K) picks."""
    bands = np.zeros((len(picks), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(picks), b + 1, np.uint64)
        for x in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h ^ picks[:, x].astype(np.uint64)) + np.uint64(x)
        bands[:, b] = h
    return bands


def packed(picks: np.ndarray) -> pa.Array:
    """The low byte of each pick, a binary for each text."""
    held = np.ascontiguousarray((picks & np.uint32(255)).astype(np.uint8))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(picks.shape[1]), len(picks), [None, pa.py_buffer(held.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def enough(k: int, threshold: float) -> int:
    """Agreeing picks of k that a pair at the threshold has but for SHORT standard deviations."""
    return max(1, math.floor(k * threshold - SHORT * math.sqrt(k * threshold * (1 - threshold))))


def node_of(text: str, key: str):
    """The identity of a text: equal texts are one node; a null text is a node by its key."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.concat(F.lit("\0null:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))))


def signatures(docs: DataFrame, idf: Idf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_key, _node, _bands (empty for texts without words) and _sig of every row."""
    table = docs.sparkSession.sparkContext.broadcast(idf)  # DEPTH * SLOTS floats
    rows = docs.select(F.col(key).cast("long").alias("_key"), node_of(text, key).alias("_node"), F.col(text).alias("_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for piece, texts, which in small_pieces(batches, "_text"):
            owner, value, times = shingles(texts)
            picks = sampler.picks(owner, value, times * table.value(value), len(texts))
            some = np.zeros(len(texts), bool)
            some[owner] = True
            some = some[which]
            at = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(banded(picks)[which][some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_pydict({"_key": piece.column("_key"), "_node": piece.column("_node"), "_bands": lists, "_sig": packed(picks[which])})

    return rows.mapInArrow(sign, "_key long, _node binary, _bands array<long>, _sig binary")


def wide_signatures(texts: DataFrame, idf: Idf) -> DataFrame:
    """_node and a signature of WIDE picks of each of these texts."""
    table = texts.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(WIDE)
        for piece, held, which in small_pieces(batches, "_text"):
            owner, value, times = shingles(held)
            picks = sampler.picks(owner, value, times * table.value(value), len(held))
            yield pa.RecordBatch.from_pydict({"_node": piece.column("_node"), "_wide": packed(picks[which])})

    return texts.mapInArrow(sign, "_node binary, _wide binary")


def similar(pairs: DataFrame, idf: Idf, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts (_ta, _tb) reach the threshold, by exact comparison of all their shingles."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "_tb", PIECE_BYTES // 2), "_ta", PIECE_BYTES // 2):
            for i in range(0, batch.num_rows, 1 << 14):
                yield compared(batch.slice(i, 1 << 14))

    def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        both = pa.concat_arrays([texts_of(batch, "_ta"), texts_of(batch, "_tb")]).dictionary_encode()
        owner, value, times = shingles(both.dictionary)
        held = times * table.value(value).astype(np.float64)
        at = np.searchsorted(owner, np.arange(len(both.dictionary) + 1))
        which = both.indices.to_numpy(zero_copy_only=False)
        size = at[which + 1] - at[which]
        rows = np.repeat(at[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair = np.repeat(np.arange(2 * n) % n, size)
        key = (pair.astype(np.uint64) << np.uint64(48)) | value[rows]
        order = np.argsort(key)
        key, pair, weight = key[order], pair[order], held[rows][order]
        same = np.flatnonzero(key[1:] == key[:-1])
        total = np.bincount(pair, weight, n)
        shared = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), n)
        good = (shared > 0) & (shared >= (threshold - 1e-9) * (total - shared))
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("a", "b")}).filter(pa.array(good))

    return pairs.mapInArrow(compare, "a binary, b binary")


def promising(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose signatures (_sa, _sb) agree often enough."""
    need = enough(BANDS * ROWS, threshold)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = (unpacked(batch.column("_sa")) == unpacked(batch.column("_sb"))).sum(1) >= need
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("a", "b")}).filter(pa.array(good))

    return pairs.mapInArrow(check, "a binary, b binary")


def bucket_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes (_c) in a cell whose wide signatures agree often enough.

    A pair that meets in several bands is told in the first of them alone. rows: _cell, _side (0 with 1 only; -1:
    with each other), _band, _node, _c, _wide, _bands, sorted by _cell in each partition.
    """
    need = enough(WIDE, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("_cell").to_numpy(zero_copy_only=False)
            if last is not None and cell[0] != last:
                yield from cells(pa.Table.from_batches(held))
                held = []
            last = cell[-1]
            cut = int(np.searchsorted(cell[::-1] != last, True)) if cell[0] != last else batch.num_rows
            if cut < batch.num_rows:  # the last cell may go on in the next batch
                yield from cells(pa.Table.from_batches([*held, batch.slice(0, batch.num_rows - cut)]))
                held = []
            held.append(batch.slice(batch.num_rows - cut))
        if held:
            yield from cells(pa.Table.from_batches(held))

    def cells(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        cell, side = (table.column(c).to_numpy() for c in ("_cell", "_side"))
        node = table.column("_node").combine_chunks()
        _, c = np.unique(np.array(table.column("_c").to_pylist(), object), return_inverse=True)
        wide = unpacked(table.column("_wide").combine_chunks())
        band = table.column("_band").to_numpy()
        bands = table.column("_bands").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cell), -1)
        edge = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)).tolist()
        left, right = [], []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            for i in range(x, y - 1):
                j = np.flatnonzero((c[i + 1 : y] != c[i]) & ((side[i + 1 : y] < 0) | (side[i + 1 : y] != side[i]))) + i + 1
                j = j[(wide[j, :64] == wide[i, :64]).sum(1) >= early] if len(j) else j
                j = j[(wide[j] == wide[i]).sum(1) >= need] if len(j) else j
                j = j[(bands[j] == bands[i]).argmax(1) == band[i]] if len(j) else j
                if len(j):
                    left.append(np.full(len(j), i))
                    right.append(j)
        if left:
            yield pa.RecordBatch.from_pydict({"a": node.take(pa.array(np.concatenate(left))), "b": node.take(pa.array(np.concatenate(right)))})

    early = enough(64, threshold)
    return rows.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """_node, _class (the smallest node of its component) of every node that a link touches.

    Each round takes the smallest label among neighbours; labels are written each round, and the rounds end when
    none changes. A hub's neighbours are reduced to one label before the shuffle.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    labels = written(edges.groupBy(F.col("a").alias("_node")).agg(F.min("b").alias("m")).select("_node", F.least("_node", "m").alias("_class")), "near-labels")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels, edges["b"] == labels["_node"]).groupBy("a").agg(F.min("_class").alias("m"))
        step = labels.join(near, labels["_node"] == near["a"]).select("_node", F.least("_class", "m").alias("_class"), F.col("_class").alias("_was"))
        new = written(step, "near-step")
        if turn > 3:  # links are mostly stars; where a chain takes longer, labels also jump to their label's label
            up = new.select(F.col("_node").alias("_at"), F.col("_class").alias("_up"))
            new = written(new.join(up, new["_class"] == up["_at"], "left").select("_node", F.least("_class", F.coalesce("_up", "_class")).alias("_class"), "_was"), "near-labels")
        labels = new.select("_node", "_class")
        if not new.where(F.col("_class") != F.col("_was")).limit(1).count():
            return labels


def texts_of_nodes(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """_node, _text of the nodes in wanted._node, once each. A bit vector of fixed size spares most other rows the shuffle."""
    slot = F.pmod(F.xxhash64("_node"), F.lit(FILTER_WORDS * 64))
    word, bit = F.floor(slot / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    filled = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    rows = docs.select(node_of(text, key).alias("_node"), F.col(text).alias("_text"))
    rows = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(filled), "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    rows = rows.groupBy("_node").agg(F.first("_text").alias("_text"))  # equal texts meet before the shuffle
    return written(rows.join(wanted.select("_node").distinct(), "_node", "left_semi"), "near-texts")


def verified(pairs: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """The similar ones of the pairs; b is the side on which many pairs may meet, and comes last."""
    with_a = pairs.join(texts.select(F.col("_node").alias("a"), F.col("_text").alias("_ta")), "a")
    with_b = with_a.join(texts.select(F.col("_node").alias("b"), F.col("_text").alias("_tb")), "b")
    return written(similar(with_b.select("a", "b", "_ta", "_tb"), idf, threshold), "near-links")


def linked(docs: DataFrame, signed: DataFrame, idf: Idf, key: str, text: str, threshold: float) -> DataFrame | None:
    """_node, _class of all nodes with a verified partner, or None if there is none."""
    nodes = signed.where(F.size("_bands") > 0).groupBy("_node").agg(F.first(F.struct("_bands", "_sig")).alias("_s"))
    nodes = written(nodes.select("_node", "_s._bands", "_s._sig"), "near-nodes")
    member = nodes.select("_node", F.posexplode("_bands").alias("_band", "_hash"))
    size = member.groupBy("_hash").agg(F.count("*").alias("_size")).where("_size > 1")
    member = written(member.join(size, ["_hash"]), "near-met")
    # How many others a node meets in all bands: the original of a group of copies meets most.
    fame = member.groupBy("_node").agg(F.sum("_size").alias("_fame"))
    best = member.join(fame, "_node").groupBy("_hash").agg(F.max(F.struct("_fame", "_node")).alias("_top"))
    led = member.join(best.select("_hash", F.col("_top._node").alias("_lead")), "_hash").where(F.col("_node") != F.col("_lead"))
    pairs = led.select(F.col("_node").alias("a"), F.col("_lead").alias("b")).distinct()
    sigs = nodes.select("_node", "_sig")
    pairs = pairs.join(sigs.select(F.col("_node").alias("a"), F.col("_sig").alias("_sa")), "a").join(sigs.select(F.col("_node").alias("b"), F.col("_sig").alias("_sb")), "b")
    pairs = written(promising(pairs.select("a", "b", "_sa", "_sb"), threshold), "near-pairs")
    texts = texts_of_nodes(docs, pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b").alias("_node"))), key, text)
    links = verified(pairs, texts, idf, threshold)
    classes = components(links) if links.limit(1).count() else None

    named = member if classes is None else member.join(classes, "_node", "left")
    named = named.select("_band", "_hash", "_node", "_size", (F.col("_node") if classes is None else F.coalesce("_class", "_node")).alias("_c"))
    open_ = named.groupBy("_hash").agg(F.min("_c").alias("x"), F.max("_c").alias("y"), F.count("*").alias("_n")).where("x <> y and _n > 2").select("_hash")
    left = written(named.join(open_, "_hash", "left_semi"), "near-left")
    texts = texts_of_nodes(docs, left.select("_node"), key, text)
    wide = wide_signatures(texts, idf)
    # A bucket of several blocks has a cell for each pair of blocks.
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_node"), blocks).cast("int")
    cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.xxhash64("_hash", F.least(i, own), F.greatest(i, own)).alias("_cell"), F.when(i == own, -1).otherwise((i < own).cast("int")).alias("_side")))
    wide = wide.join(nodes.select("_node", "_bands"), "_node")
    rows = left.select("_band", "_node", "_c", F.explode(cells).alias("_in")).select("_in._cell", "_in._side", "_band", "_node", "_c").join(wide, "_node")
    rows = rows.select("_cell", "_side", "_band", "_node", "_c", "_wide", "_bands").repartition("_cell").sortWithinPartitions("_cell")
    found = bucket_pairs(rows, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = written(found.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "near-pairs")
    more = verified(found, texts, idf, threshold)
    if not more.limit(1).count():
        return classes
    return components(links.union(more))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, class_id (the smallest key of its class), class_rows and kept for every row of docs.

    Classes are the closure of: equal texts, and texts with a similarity of at least the threshold. Null texts
    are alone in their class; empty texts, and texts of white space alone, are only like texts equal to them. One
    row of each class is kept, that with the smallest key (then by text); of rows equal in both, one. Null keys
    come last; a class of null keys has a null id. An empty table gives an empty result.
    """
    idf = document_frequencies(docs, text)
    signed = written(signatures(docs, idf, key, text), "near-signed")
    classes = linked(docs, signed, idf, key, text, threshold)
    rows = signed.select("_key", "_node")
    if classes is not None:
        rows = rows.join(classes, "_node", "left")
    rows = rows.select("_key", "_node", (F.col("_node") if classes is None else F.coalesce("_class", "_node")).alias("_class"))
    first = F.min(F.struct(F.col("_key").isNull().alias("n"), "_key", "_node")).alias("_first")
    rows = written(rows, "near-rows")
    top = rows.groupBy("_class").agg(first, F.count("*").alias("class_rows"))
    rows = rows.join(top.withColumnRenamed("_class", "_c"), F.col("_class") == F.col("_c"))
    own = F.col("_key").eqNullSafe(F.col("_first._key")) & (F.col("_node") == F.col("_first._node"))
    rows = rows.select(F.col("_key").alias(key), "_node", F.col("_first._key").alias("class_id"), "class_rows", own.alias("_own"))
    nth = F.row_number().over(Window.partitionBy(key, "_node").orderBy("_own"))
    return rows.withColumn("kept", F.col("_own") & (nth == 1)).drop("_own")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, under any column names."""
    return guarded(docs, (key, text), lambda d: _one_of_each(d, key, text, threshold))


def _one_of_each(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    gone = near_classes(docs, key, text, threshold)
    kept = gone.where("kept").select(F.col(key).cast("long").alias("_k"), F.col("_node").alias("_n"))
    rows = docs.withColumn("_node", node_of(text, key))
    same = F.col(key).cast("long").eqNullSafe(F.col("_k")) & (F.col("_node") == F.col("_n"))
    nth = F.row_number().over(Window.partitionBy("_n", "_k").orderBy(F.lit(0)))
    return rows.join(kept, same).withColumn("_nth", nth).where("_nth = 1").select(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", "class_rows", "kept")
