"""Operator 13 against a plain rewriting, the SQL, odd tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from causalake.llm import fill_middle as M
from tests.conftest import rows, sql_rows

ODD = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "x <P> y\nz\n", "<S>", "p<M>", "<\nP>\n<", "S>\n<S\n>", "é漢👩‍👧\n🇫🇷\r\n x\n", "line\n" * 30_000, "w" * 200_000, "\n" * 50_000]


def rewritten(doc_id, text, fim=100, spm=50):
    t = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= fim:
        return n, "plain", None, None, t
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, i), (i, j), (j, n)))
    spm = h4 % 100 < spm
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def check(spark, given, **kw):
    df = spark.createDataFrame([(i, d, t, "n") for i, (d, t) in enumerate(given)], "row int, doc_id long, text string, _k string").repartition(3)
    out = M.fill_in_middle(df, **{f"{k}_percent": v for k, v in kw.items()}).withColumn("back", M.original())
    assert out.columns == ["row", "doc_id", "text", "_k", *M.EXTRA, "back"]
    got = {r.row: r for r in out.collect()}
    assert len(got) == len(given)
    for i, (d, t) in enumerate(given):
        assert tuple(got[i][c] for c in M.EXTRA) == rewritten(d, t, **kw), i
        assert got[i].back == (t or "") and got[i].text == t


def test_odd_texts_and_keys(spark):
    check(spark, [(d, t) for d in (None, 1, 2, 3, 10**15) for t in ODD])


def test_shares(spark):
    check(spark, [(d, "a\nb\nc\nd") for d in range(60)], fim=40, spm=0)
    check(spark, [(d, "a\nb\nc\nd") for d in range(60)], fim=90, spm=100)


def test_repeated_rows(spark):
    check(spark, [(5, "a\nbb\nccc\n")] * 300 + [(5, "other\ntext"), (6, "a\nbb\nccc\n")])


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.fill_in_middle(df).collect() == []
    df = spark.createDataFrame([(1, "a\nb\nc", "mine", "own")], "doc_id long, text string, form string, `a.b` string")
    assert M.fill_in_middle(df).columns == ["doc_id", "text", "a.b", *M.EXTRA]


def test_other_units(spark):
    df = spark.createDataFrame([(i, "one two  three four") for i in range(20)], "doc_id long, text string")
    out = M.fill_in_middle(df, unit=r"\s*\S+").withColumn("back", M.original())
    assert out.where("back = text").count() == 20
    assert {r.prefix_chars for r in out.select("prefix_chars").distinct().collect()} <= {0, 3, 7, 14, 19}


def test_query_equals_sql(spark, sf, duck):
    out = M.op13_fill_in_middle(spark, sf)
    assert rows(out) == sql_rows(duck, M.SQL, out.columns)
    assert out.where(F.col("restored_sha256").isNull()).count() == 0
