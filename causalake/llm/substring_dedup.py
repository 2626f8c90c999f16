"""Operator 9, substring deduplication by matching statistics against an FM-index per shard.

Shards are cut by content, so that a repeated passage meets its copies in one shard however many documents
there are. Each window of 13 words belongs to the shard of its smallest hashed word triple (its anchor). Neighbouring
windows with one anchor travel as one segment; equal segments of one piece travel once. A shard indexes those
segments that share an anchor with others, streams their windows through backward search over the wavelet
matrix, and locates each range to find the smallest doc_id with that window. Windows that start in a
smaller doc_id are reported as intervals, merged for each document, and cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import guarded, hash_strings, mix, pieces, read, run_starts, split_words, texts_of, word_ids
from .fm_index import MOST, FMIndex

WINDOW, ANCHOR = 13, 3
#: Bytes of text of a shard, about; segments repeat words about three times.
SHARD_BYTES = 12 << 20
#: Words of one index; a larger shard is indexed in parts that hold whole anchors.
INDEX_WORDS = MOST // 4
#: Bytes of text that one task cuts into segments at a time.
PIECE_BYTES = 4 << 20
#: What documents are told directly goes by this many further groups, or by as many as there are shards.
DIRECT = 4096

SENT = "shard long, docs binary, marks binary, starts binary, sizes binary, tags binary, texts binary"
TOLD = "_doc long, _mark long, starts array<int>, ends array<int>"


def _pack(x: np.ndarray, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def segments(ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and anchor hash of each run of windows with one anchor."""
    n, none = len(ids), (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    if n < WINDOW:
        return none
    at = run_starts(counts)
    end = np.repeat(at[1:], counts)
    word = hashes[ids]
    key = mix(word[:-2] + mix(word[1:-1] + mix(word[2:])))
    # The smallest hash of a window and where it stands, whatever the length: of equal ones the first.
    wide, anchor, width = key, np.arange(len(key)), 1

    def joined(step: int) -> tuple[np.ndarray, np.ndarray]:
        later = wide[step:] < wide[:-step]
        return np.where(later, wide[step:], wide[:-step]), np.where(later, anchor[step:], anchor[:-step])

    need = WINDOW - ANCHOR + 1
    while width * 2 <= need:
        wide, anchor = joined(width)
        width *= 2
    if width < need:
        wide, anchor = joined(need - width)
    start = np.arange(len(anchor))
    start = start[start + WINDOW <= end[start]]
    if not len(start):
        return none
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last] + WINDOW, mix(key[anchor[first]])


def _rows(shard, docs, marks, starts, sizes, tags, texts) -> pa.RecordBatch:
    kinds = {"shard": pa.int64()} | dict.fromkeys(("docs", "marks", "starts", "sizes", "tags", "texts"), pa.binary())
    return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), (shard, docs, marks, starts, sizes, tags, texts), strict=True)})


def sender(shards: int):
    """A map over (_doc, _mark, text): segments for the shards, and what is known to repeat inside a piece."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE_BYTES):
            texts = texts_of(piece, "_text")
            words, counts = split_words(texts)
            ids, distinct = word_ids(words)
            first, end, anchor = segments(ids, counts, hash_strings(distinct))
            if not len(first):
                continue
            docs = piece.column("_doc").to_numpy(zero_copy_only=False)
            marks = piece.column("_mark").to_numpy(zero_copy_only=False)
            at = run_starts(counts)
            row = np.searchsorted(at, first, side="right") - 1
            offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
            offsets = offsets - offsets[0] + np.arange(len(offsets))
            body = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().encode()
            order = np.lexsort((first, docs[row])).tolist()
            a, b, ids_of = offsets[first].tolist(), (offsets[end] - 1).tolist(), docs[row].tolist()
            seen: dict[bytes, int] = {}
            kept, gone, text = [], [], []
            for i in order:
                held = body[a[i] : b[i]]
                k = seen.setdefault(held, i)
                if k == i or ids_of[k] == ids_of[i]:  # what one document repeats goes each time: none of it is told yet
                    kept.append(i)
                    text.append(held)
                else:
                    gone.append(i)
            kept = np.array(kept)
            shard = ((anchor[kept] >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            kept, shard = kept[by], shard[by]
            tag = (anchor[kept] & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() + [len(shard)]
            by = by.tolist()
            out = [[] for _ in range(7)]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                k = kept[x:y]
                doc = docs[row[k]]
                fields = (int(shard[x]), _pack(np.diff(doc, prepend=0)), _pack(marks[row[k]]), _pack((first[k] - at[row[k]]).astype(np.int32)), _pack((end[k] - first[k]).astype(np.uint16)), np.ascontiguousarray(tag[x:y]).tobytes(), _pack(np.frombuffer(b"\n".join(text[z] for z in by[x:y]), np.uint8), 9))
                for o, f in zip(out, fields, strict=True):
                    o.append(f)
            yield _rows(*out)
            if gone:
                k = np.array(gone)
                k = k[np.lexsort((first[k], row[k]))]
                to = -1 - (mix(docs[row[k]].astype(np.uint64)) % np.uint64(max(DIRECT, shards))).astype(np.int64)
                k = k[np.argsort(to, kind="stable")]
                to = np.sort(to)
                edge = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist() + [len(to)]
                out = [[] for _ in range(7)]
                for x, y in zip(edge[:-1], edge[1:], strict=True):
                    i = k[x:y]
                    fields = (int(to[x]), _pack(np.diff(docs[row[i]], prepend=0)), _pack(marks[row[i]]), _pack((first[i] - at[row[i]]).astype(np.int32)), _pack((end[i] - first[i]).astype(np.uint16)), b"", b"")
                    for o, f in zip(out, fields, strict=True):
                        o.append(f)
                yield _rows(*out)

    return send


def told(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Ranges merged for each document, a row for each."""
    kind = pa.schema([("_doc", pa.int64()), ("_mark", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    if not len(doc):
        return kind.empty_table()
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    # Ranges of one document in order of start: the furthest end so far, kept apart for each document by an offset.
    base = np.cumsum(head).astype(np.int64) << 32
    reach = np.maximum.accumulate(base + end)
    new = head.copy()
    new[1:] |= base[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    starts, ends = start[first].astype(np.int32), (reach[last] - base[last]).astype(np.int32)
    at = np.append(np.flatnonzero(head[first]), len(first)).astype(np.int32)
    rows = first[head[first]]
    return pa.table([pa.array(doc[rows]), pa.array(mark[rows]), pa.ListArray.from_arrays(pa.array(at), pa.array(starts)), pa.ListArray.from_arrays(pa.array(at), pa.array(ends))], schema=kind)


def shard_ranges(table: pa.Table) -> pa.Table:
    """The repeated word ranges that one shard finds."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    doc = np.concatenate([np.cumsum(_unpack(x, np.int64)) for x in cols["docs"]])
    mark = np.concatenate([_unpack(x, np.int64) for x in cols["marks"]])
    start = np.concatenate([_unpack(x, np.int32) for x in cols["starts"]]).astype(np.int64)
    size = np.concatenate([_unpack(x, np.uint16) for x in cols["sizes"]]).astype(np.int64)
    if cols["shard"][0] < 0:
        return told(doc, mark, start, start + size)
    tag = np.frombuffer(b"".join(cols["tags"]), np.uint8).reshape(-1, 3).astype(np.int64)
    tag = tag[:, 0] | tag[:, 1] << 8 | tag[:, 2] << 16
    # An anchor met by one document alone can't repeat in another.
    order = np.lexsort((doc, tag))
    t, d = tag[order], doc[order]
    head = np.append(True, t[1:] != t[:-1])
    group = np.cumsum(head) - 1
    differs = np.zeros(len(t), bool)
    differs[1:] = ~head[1:] & (d[1:] != d[:-1])
    shared = np.zeros(len(tag), bool)
    shared[order] = (np.bincount(group, differs) > 0)[group]
    if not shared.any():
        return told(*(np.zeros(0, np.int64),) * 4)
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    texts, at = [], 0
    for x in cols["texts"]:
        held = unpack.decompress(x).split(b"\n")
        texts += [held[i] for i in np.flatnonzero(shared[at : at + len(held)]).tolist()]
        at += len(held)
    keep = np.flatnonzero(shared)
    # Parts of whole anchors, each small enough for one index.
    order = np.argsort(tag[keep], kind="stable")
    sums = np.cumsum(size[keep][order] + 1)
    head = np.append(True, tag[keep][order][1:] != tag[keep][order][:-1])
    part = np.maximum.accumulate(np.where(head, (sums - 1) // INDEX_WORDS, 0))
    found = []
    for p in np.unique(part).tolist():
        k = order[part == p]
        found.append(_search([texts[i] for i in k.tolist()], *(x[keep[k]] for x in (doc, mark, start))))
    return told(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _search(texts: list[bytes], doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> tuple:
    """(doc, mark, start, end) of the windows of these segments that a smaller doc has too."""
    # Equal segments stand once in the index, with their smallest doc.
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc)
    parts = pc.split_pattern(pa.array([t.decode() for t in number], pa.string()), " ")
    words, counts = parts.flatten(), np.diff(parts.offsets.to_numpy()).astype(np.int64)
    ids, distinct = word_ids(words)
    windows = counts - WINDOW + 1
    at = run_starts(counts)
    begin = np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    owner = np.repeat(np.arange(len(counts)), windows)
    smallest = least[owner]
    # Windows whose fingerprint no other window here has need no search; equal windows have equal fingerprints.
    powers = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))
    word = mix(ids.astype(np.uint64) + np.uint64(1))
    print_ = np.zeros(len(begin), np.uint64)
    for k in range(WINDOW):
        print_ += word[begin + k] * powers[k]
    order = np.argsort(print_, kind="stable")
    p = print_[order]
    again = np.zeros(len(p), bool)
    again[1:] = p[1:] == p[:-1]
    again[:-1] |= p[1:] == p[:-1]
    open_ = np.zeros(len(begin), bool)
    open_[order] = again
    most = INDEX_WORDS if len(ids) + len(counts) >= MOST else MOST
    if most < MOST:  # an anchor with more segments than an index holds: its different windows, in parts by fingerprint
        left = np.flatnonzero(open_)
        parts = -(-len(left) * (WINDOW + 1) // most) if len(left) else 0
        group = (mix(print_[left]) % np.uint64(max(parts, 1))).astype(np.int64)
        for g in range(parts):
            rows = left[group == g]
            held, which = np.unique(ids[begin[rows][:, None] + np.arange(WINDOW)], axis=0, return_inverse=True)
            which = which.ravel()
            if not len(held):
                continue
            best = np.full(len(held), np.iinfo(np.int64).max)
            np.minimum.at(best, which, least[owner[rows]])
            for a in range(0, len(held), most // (WINDOW + 1)):
                part = held[a : a + most // (WINDOW + 1)]
                index = FMIndex(np.append(part + 1, np.zeros((len(part), 1), np.int64), axis=1).ravel(), len(distinct) + 1)
                lo, hi = index.ranges(part + 1, np.full(len(part), WINDOW))
                found, where = index.occurrences(lo, hi)
                np.minimum.at(best, a + found, best[a + where // (WINDOW + 1)])
            smallest[rows] = best[which]
    elif open_.any():
        used = np.unique(owner[open_])
        kept = np.isin(np.arange(len(counts)), used)
        place = np.cumsum(np.where(kept, counts + 1, 0)) - np.where(kept, counts + 1, 0)
        text = np.zeros(int((counts + 1)[kept].sum()), np.int64)
        inside = np.repeat(kept, counts)
        shift = np.repeat(place - at[:-1], counts)
        text[(np.arange(len(ids)) + shift)[inside]] = ids[inside] + 1
        spot = begin + (place - at[:-1])[owner]  # where each window stands in the index's text
        window_at = np.full(len(text), -1, np.int64)
        window_at[spot[open_]] = np.flatnonzero(open_)
        index = FMIndex(text, len(distinct) + 1)
        while open_.any():
            left = np.flatnonzero(open_)
            _, one = np.unique(print_[left], return_index=True)
            query = left[one]
            patterns = ids[begin[query][:, None] + np.arange(WINDOW)] + 1
            lo, hi = index.ranges(patterns, np.full(len(query), WINDOW))
            which, where = index.occurrences(lo, hi)
            met = window_at[where]
            best = np.full(len(query), np.iinfo(np.int64).max)
            np.minimum.at(best, which, least[owner[met]])
            smallest[met] = best[which]
            open_[met] = False
    # Back to the segments as they came.
    many = windows[of]
    base = np.repeat((np.cumsum(windows) - windows)[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    entry = np.repeat(np.arange(len(of)), many)
    hit = smallest[base] < doc[entry]
    e, s = entry[hit], (start[entry] + base - (np.cumsum(windows) - windows)[of][entry])[hit]
    return doc[e], mark[e], s, s + WINDOW


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc, _mark (a 64-bit hash of the text), starts, ends: repeated word ranges, in several rows for a document."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_doc"), _mark(text).alias("_mark"), F.col(text).alias("_text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(16, -(-size * 3 // SHARD_BYTES))
    return rows.mapInArrow(sender(shards), SENT).groupBy("shard").applyInArrow(shard_ranges, TOLD)


def _mark(text: str):
    """Tells rows with the same key apart."""
    return F.xxhash64(text)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the words that remain, joined by one space, in place of the text, n_words and n_removed.

    A word goes if a window of 13 words that covers it also starts in a row with a smaller key; all windows
    are judged on the input. Null texts have no words and give an empty text, as do empty ones; texts of fewer
    than 13 words stay. Rows with a null key lose nothing and take nothing from others. Rows with the same key are
    judged apart and never against each other. Columns named n_words or n_removed are replaced; others may have any name.
    """
    return guarded(docs, (key, text), lambda d: _deduplicated(d, key, text), ("n_words", "n_removed"))


def _deduplicated(docs: DataFrame, key: str, text: str) -> DataFrame:
    rest = docs.columns
    found = repeated_ranges(docs, key, text).groupBy("_doc").agg(F.collect_list(F.struct("_mark", "starts", "ends")).alias("_found"))
    # Null keys are spread by their text; they meet no ranges.
    spread = F.coalesce(F.col(key).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1)))
    rows = docs.select(*rest, spread.alias("_key"), F.col(key).isNotNull().alias("_known"), _mark(text).alias("_own"))
    small = StructType([x for x in rows.schema if x.name != text] + [StructField("_packed", BinaryType())])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for piece in pieces(batches, text, PIECE_BYTES):
            packed = [pack.compress(t) for t in texts_of(piece, text).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({c.name: piece.column(c.name) for c in small if c.name != "_packed"} | {"_packed": pa.array(packed, pa.binary())})

    # Texts travel to their ranges compressed.
    rows = rows.mapInArrow(shrink, small)
    rows = rows.join(found, (F.col("_key") == F.col("_doc")) & F.col("_known"), "left").drop("_key", "_known", "_doc")
    schema = StructType([docs.schema[c] for c in rest] + [StructField("n_words", LongType()), StructField("n_removed", LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(cut_piece, parts(batch))

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        held, size, at = [], 0, 0
        for i, t in enumerate(batch.column("_packed").to_pylist()):
            held.append(unpack.decompress(t))
            size += len(held[-1])
            if size > PIECE_BYTES or i == batch.num_rows - 1:
                rows = batch.slice(at, len(held))
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in rows.schema.names if c != "_packed"} | {text: pa.array(held, pa.binary()).cast(pa.string())})
                held, size, at = [], 0, i + 1

    def cut_piece(piece: pa.RecordBatch) -> pa.RecordBatch:
        words, counts = split_words(texts_of(piece, text))
        at = run_starts(counts)
        gone = np.zeros(len(words) + 1, np.int32)
        own = piece.column("_own").to_pylist()
        for i, found in enumerate(piece.column("_found").to_pylist()):
            for r in found or ():
                if r["_mark"] == own[i]:
                    np.add.at(gone, at[i] + np.array(r["starts"]), 1)
                    np.add.at(gone, at[i] + np.array(r["ends"]), -1)
        keep = np.cumsum(gone)[:-1] == 0
        sums = np.concatenate(([0], np.cumsum(keep)))[at]
        lists = pa.ListArray.from_arrays(pa.array(sums.astype(np.int32)), words.filter(pa.array(keep)))
        held = {c: piece.column(c) for c in rest} | {text: pc.binary_join(lists, " ")}
        return pa.RecordBatch.from_pydict(held | {"n_words": pa.array(counts), "n_removed": pa.array(counts - np.diff(sums))})

    return rows.mapInArrow(cut, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that remain of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
