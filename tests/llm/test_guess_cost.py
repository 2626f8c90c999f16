"""Guess cost against all segmentations of short strings; contexts, words of the corpus, and time on long texts."""

from __future__ import annotations

import itertools
import math
import random
import time

from causalake.llm import secrets


def is_date(x):
    """Year, year and month, or a day of the Gregorian calendar's forms, with or without one separator."""
    if x.isdigit():
        forms = {4: [(4,)], 6: [(2, "m", "d"), ("d", "m", 2), ("m", "d", 2)], 8: [(4, "m", "d"), ("d", "m", 4), ("m", "d", 4)]}.get(len(x), [])
        cuts = [(f, [int(w) if isinstance(w, int) else 2 for w in f]) for f in forms]
        parts = [(f, [x[sum(w[:i]) : sum(w[: i + 1])] for i in range(len(w))]) for f, w in cuts]
    else:
        seps = {c for c in x if not c.isdigit()}
        if len(seps) != 1 or not seps <= set("-/."):
            return False
        p = x.split(seps.pop())
        forms = {2: [(4, "m")], 3: [(4, "m", "d"), ("d", "m", 4), ("m", "d", 4), ("d", "m", 2), ("m", "d", 2)]}.get(len(p), [])
        parts = [(f, p) for f in forms]

    def fits(w, s):
        if not s.isdigit():
            return False
        if w == 4:
            return len(s) == 4 and s[:2] in ("19", "20")
        return len(s) == 2 if w == 2 else len(s) <= 2 and 1 <= int(s) <= (12 if w == "m" else 31)

    return any(all(fits(w, s) for w, s in zip(f, p, strict=True)) for f, p in parts)


def segment(value, a, b, ranks):
    """The least cost of value[a:b] as one segment."""
    x, low = value[a:b], value[a:b].lower()
    out = [sum(math.log10(26 if c.isalpha() else 10 if c.isdigit() else 33) for c in x)]
    for word, more in ((low, 1), (low.translate(str.maketrans("@4310$57", "aaeiosst")), 4)):
        if word in ranks:
            out.append(math.log10(ranks[word] * more * (1 if x == low else 2)))
            break
    if is_date(x):
        out.append(math.log10(120 if len(x) == 4 else 365 * 120))
    if len(x) >= 3 and len(set(low)) == 1:
        out.append(math.log10(26 if x[-1].isalpha() else 10 if x[-1].isdigit() else 33) + math.log10(len(x)))
    rows = [r + "\0" for r in secrets.ROWS]
    if len(x) >= 3 and all(any(p + q in r or q + p in r for r in rows) for p, q in itertools.pairwise(low)):
        out.append(math.log10(94 * len(x)))
    if 2 <= len(x) <= 12 and a >= len(x) and value[a - len(x) : a].lower() == low:
        out.append(0.0)
    return min(out)


def exhaustive(value, ranks):
    n, best = len(value), math.inf
    for cuts in itertools.product((0, 1), repeat=n - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), n]
        best = min(best, sum(segment(value, a, b, ranks) for a, b in itertools.pairwise(at)) + (len(at) - 2) * math.log10(2))
    return best


def test_equals_all_segmentations():
    ranks = secrets.RANKS | {"correct": 500, "horse": 900, "ass": 2_000}
    fixed = ["passssss", "horse1999", "311299", "2012-1-12", "P4ss1234", "qwe31.12.99", "abcabcabc", "x7$Kp", "asdfgh!!!", "20121399", "1/2/2003a", "H0rsehorse", "a", "2012-13"]
    r = random.Random(3)
    drawn = ["".join(r.choice(("1", "2", "a", "s", "d", "-", "19", "A", "$", "0")) for _ in range(7))[:9] for _ in range(60)]
    for x in fixed + drawn:
        assert math.isclose(secrets.guess_cost(x, ranks), exhaustive(x, ranks), abs_tol=1e-9), x
        limited = secrets.guess_cost(x, ranks, 3.0)
        assert (limited >= 3.0) == (exhaustive(x, ranks) >= 3.0)
    assert is_date("2012-1-12") and not is_date("20121399")


def test_contexts():
    spans = lambda t, **k: [t[a:b] for a, b, kind in secrets.scan(t, **k) if kind == "guess"]
    assert spans("get https://bob:xK9mQ2vTz7@host/x and https://bob:password@host") == ["xK9mQ2vTz7"]
    assert spans("psk := xK9#mQ2!vT$% , pwd => zT8!kQ1&vv.") == ["xK9#mQ2!vT$%", "zT8!kQ1&vv"]
    assert spans("login: notwithstanding") == ["notwithstanding"]
    assert spans("login: notwithstanding", ranks=secrets.RANKS | {"notwithstanding": 9_000}) == []


def test_word_ranks(spark, monkeypatch):
    rows = [("Zebra zebra ox; the",), (None,), ("",), ("a zebra's quagga, QUAGGA",), ("w" * 30 + " été",)]
    got = secrets.word_ranks(spark.createDataFrame(rows, "text string"))
    n = len(secrets.RANKS)
    assert {w: r - n for w, r in got.items() if r > n} == {"zebra": 1, "quagga": 2}
    assert secrets.word_ranks(spark.createDataFrame([], "text string")) == secrets.RANKS
    monkeypatch.setattr(secrets, "FITTED", 2)  # a bin that doesn't fit whole is left out
    text = "lynx " * 9 + "puma puma ibex ibex"
    assert set(secrets.word_ranks(spark.createDataFrame([(text,)], "text string"))) - set(secrets.RANKS) == {"lynx"}


def test_long_texts_take_linear_time():
    at = time.time()
    text = "password=hunter2hunter2\n" * 45_000
    assert len(secrets.scan(text)) == 45_000
    r = random.Random(1)
    long = "pwd: " + "".join(r.choice("xyzXYZ019$#") for _ in range(1_000_000))
    assert [k for _, _, k in secrets.scan(long)] == ["guess"]
    assert secrets.scan("pwd: " + "z" * 50_000) == []  # one run, cheap at any length
    assert time.time() - at < 20
