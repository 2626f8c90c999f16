"""The language fit draws from whole texts and all languages; predictions equal a plain comparison of sizes."""

from __future__ import annotations

import re

import zstandard

from causalake.llm import language

FIELDS = "doc_id long, lang string, text string"


def test_pieces_from_whole_texts(spark):
    late = "1 " * 5_000 + "sonnenblume " * 30  # letters far past the start only
    rows = [(i, "de", late) for i in range(3)] + [(9, "en", "sunflower " * 40), (10, "en", None), (11, None, "x"), (12, "fr", "")]
    held = language.fit(spark.createDataFrame(rows, FIELDS))
    assert set(held) == {"de", "en"} and b"sonnenblume" in held["de"] and b"sunflower" in held["en"]
    # Short texts are taken whole.
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(1_500))
    whole = language.fit(spark.createDataFrame([(1, "x", long)], FIELDS))["x"].decode()
    assert len(long) <= language.PIECES * language.PIECE_CHARS and len(whole) > 0.99 * len(long)


def test_every_language_and_document(spark, monkeypatch):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, f"l{i:03}", f"q{w} " * 4) for i, w in enumerate(words)]
    held = language.fit(spark.createDataFrame(rows, FIELDS))
    assert len(held) == 300  # no label is left out
    monkeypatch.setattr(language, "TOTAL", 300 * 5)
    assert {len(x) for x in language.fit(spark.createDataFrame(rows, FIELDS)).values()} == {5}
    docs = [(i, "en", f"mark{w}z " * 100) for i, w in enumerate(words)]
    monkeypatch.undo()
    plain = language.fit(spark.createDataFrame(docs, FIELDS))["en"]
    assert all(f"mark{w}z".encode() in plain for w in words)  # each sampled document has its part


def test_equals_plain_comparison(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = language.fit(docs.where(~language.held_out()))
    got = {r.doc_id: r.lang_pred for r in language.classify(docs.select("doc_id", "text"), known).collect()}

    def size(name, text):
        d = zstandard.ZstdCompressionDict(known[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + language.BLOCK])) for i in range(0, len(text), language.BLOCK))

    for r in docs.orderBy("doc_id").limit(40).collect():
        plain = b" " + " ".join(re.findall(r"[^\W\d_]+", r.text.lower())).encode() + b" "
        sizes = [size(n, plain) for n in known]
        assert sizes[list(known).index(got[r.doc_id])] <= min(sizes) + 1
