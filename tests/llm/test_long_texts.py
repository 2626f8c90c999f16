"""Anchors of texts of any length."""

from __future__ import annotations

import numpy as np

from causalake.llm import substring_dedup as S


def test_anchor_beyond_eight_million_words():
    n = (1 << 23) + 4000
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    ids = rng.integers(0, len(hashes), n)
    first, end, anchor = S.segments(ids, np.array([n]), hashes)
    part = ids[-3000:]  # the same words as a text of their own
    f, e, a = S.segments(part, np.array([len(part)]), hashes)
    late = {(x + n - 3000, z) for x, z in zip(f[1:].tolist(), a[1:].tolist(), strict=True)}
    assert late <= set(zip(first.tolist(), anchor.tolist(), strict=True))


def test_hot_anchor_beyond_one_index(monkeypatch):
    # Segments of one anchor that together have more words than an index holds.
    rng = np.random.default_rng(4)
    words = rng.integers(0, 40, (3000, 23))
    words[:, 10:13] = [1, 2, 3]
    words[1000:2000] = words[:1000]
    words[2000:, :20] = words[:1000, :20]
    texts = [" ".join(f"w{x}" for x in row).encode() for row in words]
    doc, mark, start = np.arange(3000), np.zeros(3000, np.int64), np.zeros(3000, np.int64)
    whole = S._search(texts, doc, mark, start)
    monkeypatch.setattr(S, "MOST", 1 << 14)
    monkeypatch.setattr(S, "INDEX_WORDS", 1 << 12)
    parts = S._search(texts, doc, mark, start)
    assert sorted(zip(*(x.tolist() for x in whole), strict=True)) == sorted(zip(*(x.tolist() for x in parts), strict=True))
    assert len(whole[0]) >= 1000 * 11 + 1000 * 8
