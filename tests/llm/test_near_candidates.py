"""Near-duplicate candidates: pairs at the threshold, and large buckets with one shared band."""

from __future__ import annotations

import random

import numpy as np

from causalake.llm import near_dedup

FLAT = near_dedup.Idf(np.zeros(near_dedup.DEPTH * near_dedup.SLOTS, np.int64), 1)


def test_near_candidates_at_the_threshold(spark):
    # Pairs at exactly 0.8 of shared weight share a band, and their signatures pass.
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    texts = []
    for _ in range(200):
        base = [word() for _ in range(92)]
        texts += [" ".join(base + [word() for _ in range(11)]) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x._key: (set(x._bands), np.frombuffer(bytes(x._sig), np.uint8)) for x in near_dedup.signatures(df, FLAT).collect()}
    need = near_dedup.enough(near_dedup.BANDS * near_dedup.ROWS, 0.8)
    assert all(rows[i][0] & rows[i + 1][0] and (rows[i][1] == rows[i + 1][1]).sum() >= need for i in range(0, len(texts), 2))


def test_near_cells_of_several_blocks(spark, monkeypatch):
    # A bucket over several blocks: each pair of its members meets in one cell.
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(80)] for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join([*b, word()]) for b in base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_dedup.signatures(df, FLAT).select("_key", "_node", "_sig").join(spark.createDataFrame([(i, [1, 1000 + i]) for i in range(60)], "_key long, _bands array<long>"), "_key")
    classes = near_dedup.linked(df, signed, FLAT, "doc_id", "text", 0.8)
    keys = {x._node: x._key for x in signed.collect()}
    held: dict = {}
    for x in classes.collect():
        held.setdefault(bytes(x._class), set()).add(keys[x._node])
    assert sorted(map(sorted, held.values())) == [[i, i + 30] for i in range(30)]


def test_near_large_bucket_with_one_band(spark):
    # 100 texts share one band and nothing else; two of them are similar.
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(99)]
    texts.append(texts[50] + " " + word())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = near_dedup.signatures(df, FLAT).select("_key", "_node", "_sig").join(spark.createDataFrame([(i, [1, 1000 + i]) for i in range(100)], "_key long, _bands array<long>"), "_key")
    classes = near_dedup.linked(df, signed, FLAT, "doc_id", "text", 0.8)
    assert classes is not None
    keys = {x._node: x._key for x in signed.collect()}
    assert {keys[x._node] for x in classes.collect()} == {50, 99}
