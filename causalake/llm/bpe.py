"""Operator 11, BPE encoding and decoding by a tokenizer file with word ends.

No pre-token of such a file reaches across ASCII white space, and neither normalisation nor special strings do, so a text's
ids are those of its white-space delimited words, one after another. Words are encoded once by the library and kept in a bounded
cache of the worker. A text with a word of over LEAF characters takes the other way, tree concatenation: its long
pre-tokens are cut into leaves, which are dealt out and encoded in parallel; then neighbours are joined in pairs, pairs of
pairs and so on. At each join a window of ids on both sides is encoded again, and doubled until its first id is the
left side's and its last the right side's. Merges of a lower rank come first and only neighbours merge, so ids of which all neighbours stay as
they are when encoded together are the encoding of the whole: such a join is exact.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from .common import guarded, pieces, read, run_starts, ship, split_words, texts_of, word_ids

#: Characters of a leaf; a longer word sends its text through the tree. Words kept in each of a worker's two caches.
LEAF, CACHE = 4_096, 150_000
#: Words longer than this aren't cached.
LONG = 64

_state: dict = {}


class Encoder:
    """The library's tokenizer of a file, and its merges with and without the mark of a word's end."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ended = self.whole.model
        self.open = models.BPE(vocab=model["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.special = {x.content: i for i, x in self.whole.get_added_tokens_decoder().items()}
        self.tokens = [self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size())]
        self.names = pa.array(self.tokens, pa.string())
        self.new, self.old = {}, {}

    def words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each word, from the caches or the library."""
        out = [self.new.get(w) or self.old.get(w) for w in words]
        missed = [i for i, x in enumerate(out) if x is None]
        if missed:
            found = self.whole.encode_batch_fast([words[i] for i in missed], add_special_tokens=False)
            if len(self.new) > CACHE:
                self.old, self.new = self.new, {}
            for i, e in zip(missed, found, strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
                if len(words[i]) <= LONG:
                    self.new[words[i]] = out[i]
        return out

    def part(self, s: str, ended: bool) -> list[int]:
        """Ids of a stretch of one pre-token, in the file's byte letters; ended: the pre-token ends with it."""
        return [t.id for t in (self.ended if ended else self.open).tokenize(s)] if s else []

    def letters(self, ids: list[int], ended: bool) -> str:
        """The byte letters that ids stand for, without the mark of the word's end."""
        s = "".join(self.tokens[i] for i in ids)
        return s.removesuffix(self.suffix) if ended else s

    def join(self, left: list[int], right: list[int], ended: bool) -> list[int]:
        """Ids of two neighbouring stretches of a pre-token together."""
        if not left or not right:
            return left + right
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            end = ended and k >= len(right)
            got = self.part(self.letters(a, False) + self.letters(b, end), end)
            if (k >= len(left) or got[0] == a[0]) and (k >= len(right) or got[-1] == b[-1]):
                return left[:-k] + got + right[k:]
            k *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Ids of a whole pre-token from those of its leaves: halves, then their join."""

        def over(a: int, b: int) -> list[int]:
            if b - a == 1:
                return leaves[a]
            m = (a + b) // 2
            return self.join(over(a, m), over(m, b), b == len(leaves))

        return over(0, len(leaves))


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def encode_texts(texts: pa.Array, path: str) -> list[bytes]:
    """Little-endian ids of each text (no nulls), by words."""
    words, counts = split_words(texts)
    at, distinct = word_ids(words)
    held = encoder(path).words(distinct.to_pylist())
    size = np.fromiter((len(x) >> 2 for x in held), np.int64, len(held))
    flat = np.frombuffer(b"".join(held), "<u4")
    starts, n = run_starts(size)[:-1][at], size[at]
    first = run_starts(n)
    ids = flat[np.repeat(starts - first[:-1], n) + np.arange(first[-1])] if len(at) else flat[:0]
    ends = first[run_starts(counts)]
    return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def leaves(text: str, path: str) -> Iterator[tuple[str, str]]:
    """(kind, string) in order: "w" words for the library, "i" an id, "t" pre-tokens, "u" a stretch of a pre-token, "e" its last.

    All but "i" in stretches of about LEAF characters; strings within "w" and "t" are parted by spaces.
    """
    enc = encoder(path)
    cut = re.compile("(" + "|".join(map(re.escape, sorted(enc.special, key=len, reverse=True))) + ")") if enc.special else None

    def long_word(word: str) -> Iterator[tuple[str, str]]:
        for i, part in enumerate(cut.split(word) if cut else [word]):
            if i % 2:
                yield "i", str(enc.special[part])
            elif part:
                part = enc.whole.normalizer.normalize_str(part) if enc.whole.normalizer else part
                for token, _ in enc.whole.pre_tokenizer.pre_tokenize_str(part):
                    if len(token) <= LEAF:
                        yield "t", token
                    else:
                        for at in range(0, len(token), LEAF):
                            yield "u" if at + LEAF < len(token) else "e", token[at : at + LEAF]

    def singles() -> Iterator[tuple[str, str]]:
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            yield from (("w", m[0]),) if len(m[0]) <= LEAF else long_word(m[0])

    held, size, kind = [], 0, ""
    for k, s in singles():
        if held and (k != kind or k in "uei" or size > LEAF):
            yield kind, " ".join(held)
            held, size = [], 0
        held.append(s)
        size, kind = size + len(s) + 1, k
    if held:
        yield kind, " ".join(held)


def leaf_ids(kind: str, s: str, path: str) -> list[int]:
    """Ids of one leaf."""
    enc = encoder(path)
    if kind == "i":
        return [int(s)]
    if kind == "w":
        return enc.whole.encode(s, add_special_tokens=False).ids
    if kind == "t":
        return [i for token in s.split(" ") for i in enc.part(token, True)]
    return enc.part(s, kind == "e")


def concatenated(parts: list[tuple[str, list[int]]], path: str) -> list[int]:
    """Ids of a text from its leaves in order."""
    enc, out, run = encoder(path), [], []
    for kind, ids in parts:
        if kind in "ue":
            run.append(ids)
            if kind == "e":
                out.extend(enc.tree(run))
                run = []
        else:
            out.extend(ids)
    return out


def _by_tree(texts: DataFrame, path: str) -> DataFrame:
    """_k, ids, n_tokens of distinct texts (_k, _t): leaves dealt out, encoded, met again by text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_t"):
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                held = list(leaves(text, path))
                yield pa.RecordBatch.from_pydict({"_k": pa.array([key] * len(held), pa.binary()), "_at": pa.array(range(len(held)), pa.int64()), "_kind": pa.array([k for k, _ in held], pa.string()), "_s": pa.array([s for _, s in held], pa.string())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.array(leaf_ids(k, s, path), "<u4").tobytes() for k, s in zip(b.column("_kind").to_pylist(), b.column("_s").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_at"), b.column("_kind"), pa.array(ids, pa.binary())], ["_k", "_at", "_kind", "_ids"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        parts = [(k, np.frombuffer(x, "<u4").tolist()) for k, x in zip(table.column("_kind").to_pylist(), table.column("_ids").to_pylist(), strict=True)]
        ids = np.array(concatenated(parts, path), "<u4")
        return pa.table({"_ok": pa.array([key[0].as_py()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()), "n_tokens": pa.array([len(ids)], pa.int64())})

    cuts = texts.mapInArrow(cut, "_k binary, _at long, _kind string, _s string").repartition("_k", "_at")
    return cuts.mapInArrow(encode, "_k binary, _at long, _kind string, _ids binary").groupBy("_k").applyInArrow(join, "_ok binary, ids binary, n_tokens long")


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit integers in one binary) and n_tokens, as the library encodes without added tokens.

    Null texts count as empty: no ids. Whole texts are encoded; a text without a long word in one task, by words, in pieces of
    2 MB (a longer text is a piece of its own); the others by tree concatenation, each text once however often it repeats, its leaves in
    any tasks and its ids in one, as they are one value. An empty table gives an empty result. Columns of docs named ids or n_tokens are
    replaced; others may have any name. The file must be readable at the same place on every worker.
    """
    ship(docs.sparkSession)

    def run(d: DataFrame) -> DataFrame:
        rest = [c for c in d.columns if c != text]
        schema = StructType([d.schema[c] for c in rest]).add(text, StringType()).add("ids", BinaryType()).add("n_tokens", LongType())

        def by_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, text):
                ids = encode_texts(texts_of(piece, text), path)
                held = [piece.column(c) for c in (*rest, text)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(ids, pa.binary()), pa.array([len(x) >> 2 for x in ids], pa.int64())], [*rest, text, "ids", "n_tokens"])

        long = F.coalesce(F.col(text), F.lit("")).rlike(rf"[^\x20\x09-\x0D]{{{LEAF + 1}}}")
        d = d.select(*rest, text)
        words = d.where(~long).mapInArrow(by_words, schema)
        key = F.unhex(F.sha2(text, 256))
        tree = d.where(long).withColumn("_k", key)
        ids = _by_tree(tree.groupBy("_k").agg(F.first(text).alias("_t")), path)
        return words.unionByName(tree.join(ids, F.col("_k") == F.col("_ok")).select(*rest, text, "ids", "n_tokens"))

    return guarded(docs, (text,), run, ("ids", "n_tokens"))


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with decoded, the library's text of the ids, special tokens included; null ids count as none.

    For files without a decoder: the tokens' own strings, joined by spaces. Ids that the file doesn't know are left out. A column
    of docs named decoded is replaced; others may have any name.
    """
    ship(docs.sparkSession)

    def run(d: DataFrame) -> DataFrame:
        rest = d.columns
        schema = StructType([d.schema[c] for c in rest]).add("decoded", StringType())

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, ids):
                held = pc.fill_null(piece.column(ids), b"")
                yield pa.RecordBatch.from_arrays([*piece.columns, decode_ids(held, path)], [*rest, "decoded"])

        return d.mapInArrow(name, schema)

    return guarded(docs, (ids,), run, ("decoded",))


def decode_ids(held: pa.Array, path: str) -> pa.Array:
    """The text of each list of ids."""
    names = encoder(path).names
    values = [np.frombuffer(x, "<u4") for x in held.to_pylist()]
    values = [v[v < len(names)] for v in values]
    flat = np.concatenate(values) if values else np.zeros(0, "<u4")
    offsets = run_starts(np.array([len(v) for v in values], np.int64))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), names.take(pa.array(flat.astype(np.int64)))), " ").cast(pa.string())


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the BPE with word ends of 49k entries."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return decoded(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
