"""Operator 8, token counts: a two-tier map-side lookup without any shuffle of pre-tokens.

Byte-level BPE merges inside pre-tokens only, and its pre-tokens never reach across ASCII white space
except that one space joins the word behind it. So a text's count is the sum over its white-space delimited
words (each with or without that space) and over its other runs of white space. Lengths of frequent words
come from a broadcast table of bounded size; the rest are encoded once by the library and kept in a bounded
cache of the worker. Texts with a special string or with white space beyond ASCII go to the library whole.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read, run_starts, split_words, texts_of, word_ids

#: Words of the broadcast table; words that one task may propose for it; words of a worker's cache.
TABLE, PROPOSED, CACHE = 16_384, 4_096, 300_000
#: Words longer than this aren't cached.
LONG = 64
LIMIT = 512
#: White space of Unicode beyond ASCII, and the information separators.
OTHER_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_state: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, a cache and the special strings, once for each worker."""
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        held.no_padding()
        held.no_truncation()
        _state[path] = (held, {}, [x.content for x in held.get_added_tokens_decoder().values()])
    return _state[path]


def lengths(path: str, strings: list[str]) -> list[int]:
    """Tokens of each string, encoded by the library."""
    tok = tokenizer(path)[0]
    return [len(x) for x in tok.encode_batch_fast(strings, add_special_tokens=False)]


def ranked(path: str):
    """An encoder of the same merges that is several times faster on single words, or None.

    Byte-level BPE merges the pair of the lowest rank first. Where every merge makes the next id, ids are ranks,
    and the public rank-based encoder gives the same tokens. Other files are left to their own library.
    """
    if ("ranked", path) not in _state:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, pre = held["model"], held["pre_tokenizer"] or {}
        vocab, merges = model.get("vocab", {}), [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        own = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not held["normalizer"]
        own = own and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        own = own and [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
        if own:
            special = {x["content"] for x in held["added_tokens"]}
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level files show as themselves
            shown = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
            ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items() if t not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _state["ranked", path] = own or None
    return _state["ranked", path]


def word_lengths(path: str, words: list[str]) -> list[int]:
    """Tokens of each word: by ranks where that is the same, by the library for letters beyond Latin."""
    own = ranked(path)
    if own is None:
        return lengths(path, words)
    encode = own._core_bpe.encode_ordinary if hasattr(own, "_core_bpe") else own.encode_ordinary
    out = [len(encode(w)) if w.isascii() or max(w) < "\u0250" else 0 for w in words]
    rest = [i for i, n in enumerate(out) if not n]
    for i, n in zip(rest, lengths(path, [words[i] for i in rest]) if rest else [], strict=True):
        out[i] = n
    return out


def frequent_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: the commonest words of all documents, TABLE at most.

    Each task counts all its words and proposes PROPOSED of them, so what is shuffled is bounded by the
    number of tasks; the table decides speed only, never a count.
    """

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for piece in pieces(batches, text):
            words, _ = split_words(texts_of(piece, text))
            ids, distinct = word_ids(words)
            n = np.bincount(ids, minlength=len(distinct))
            top = np.argsort(-n, kind="stable")[: 4 * PROPOSED]
            held.update(dict(zip(distinct.take(pa.array(top)).to_pylist(), n[top].tolist(), strict=True)))
            if len(held) > 32 * PROPOSED:
                held = Counter(dict(held.most_common(16 * PROPOSED)))
        best = [x for x in held.most_common(PROPOSED) if len(x[0]) <= LONG]
        yield pa.RecordBatch.from_pydict({"word": pa.array([x for x, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    counts = docs.select(text).mapInArrow(propose, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(TABLE)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit, in place of the text.

    Null texts count as empty: 0 bytes, 0 tokens. Whole texts are counted, however long; repeated rows and
    equal texts get equal counts. Columns of docs that bear one of the three names are replaced. The file at
    `path` must be readable at the same place on every worker.
    """
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    spark = docs.sparkSession
    words = [r["word"] for r in frequent_words(docs, text).collect()]  # TABLE rows at most
    table = {}
    for lead in ("", " "):
        table |= dict(zip([lead + w for w in words], lengths(path, [lead + w for w in words]), strict=True))
    table = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            texts = texts_of(piece, text)
            n = count_texts(texts, path, table.value)
            size = pc.binary_length(texts).cast(pa.int64())
            held = {c: piece.column(c) for c in rest}
            yield pa.RecordBatch.from_pydict(held | {"n_bytes": size, "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    from pyspark.sql.types import BooleanType, LongType, StructType

    schema = StructType([docs.schema[c] for c in rest]).add("n_bytes", LongType()).add("n_tokens", LongType()).add("over_limit", BooleanType())
    return docs.select(*rest, text).mapInArrow(count, schema)


def count_texts(texts: pa.Array, path: str, table: dict[str, int]) -> np.ndarray:
    """Tokens of each text (no nulls)."""
    _, cache, special = tokenizer(path)
    odd = pc.match_substring_regex(texts, OTHER_SPACE)
    for x in special:
        odd = pc.or_(odd, pc.match_substring(texts, x))
    odd = odd.to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int64)
    if odd.any():
        at = np.flatnonzero(odd)
        out[at] = lengths(path, texts.take(pa.array(at)).to_pylist())
        texts = pc.if_else(pa.array(odd), "", texts)
    words, counts = split_words(texts)
    ids, distinct = word_ids(words)
    lead, runs, run_doc = spaces(texts)
    pairs = ids * 2 + lead
    need = np.zeros(2 * len(distinct), bool)
    need[pairs] = True
    need = np.flatnonzero(need)
    strings = distinct.take(pa.array(need >> 1)).to_pylist()
    strings = [" " + s if k & 1 else s for s, k in zip(strings, need.tolist(), strict=True)]
    length = np.zeros(2 * len(distinct), np.int64)
    got = [table.get(s) or cache.get(s, 0) for s in strings]
    missed = [i for i, n in enumerate(got) if not n]
    if missed:
        found = word_lengths(path, [strings[i] for i in missed])
        if len(cache) + len(missed) > CACHE:
            cache.clear()
        for i, n in zip(missed, found, strict=True):
            got[i] = n
            if len(strings[i]) <= LONG:
                cache[strings[i]] = n
    length[need] = got
    sums = np.concatenate(([0], np.cumsum(length[pairs])))
    at = run_starts(counts)
    out += sums[at[1:]] - sums[at[:-1]]
    if runs:
        kinds = sorted(set(runs))
        n = dict(zip(kinds, lengths(path, kinds), strict=True))
        np.add.at(out, run_doc, np.fromiter((n[r] for r in runs), np.int64, len(runs)))
    return out


def spaces(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each word, 1 if one space is joined to it; the pre-tokens of white space alone, and their texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw), bool)
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    prior = np.empty(len(raw), bool)
    prior[0], prior[1:] = False, space[:-1]
    starts = np.flatnonzero(~space & (prior | edge))
    before = np.where(edge[starts], 0, raw[np.maximum(starts - 1, 0)])
    lead = (before == 32).astype(np.int64)
    run = np.flatnonzero(space & (~prior | edge))
    if not len(run):
        return lead, [], np.zeros(0, np.int64)
    stop = np.ones(len(raw) + 1, bool)
    stop[:-1] = ~space
    stop[:-1] |= edge
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, run, side="right")]
    doc = np.searchsorted(offsets, run, side="right") - 1
    last = end == offsets[doc + 1]  # nothing follows in this text
    final = raw[end - 1]
    plain = ~last & (end - run == 1) & (final == 32)
    run, end, doc, last, final = (x[~plain] for x in (run, end, doc, last, final))
    body = raw.tobytes() if len(run) else b""
    out, owner = [], []
    for a, b, d, z, f in zip(run.tolist(), end.tolist(), doc.tolist(), last.tolist(), final.tolist(), strict=True):
        held = body[a:b].decode()
        parts = [held] if z else [held[:-1]] if f == 32 else [held[:-1], held[-1]]
        for p in parts:
            if p:
                out.append(p)
                owner.append(d)
    return lead, out, np.array(owner, np.int64)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level BPE of 50k entries."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
