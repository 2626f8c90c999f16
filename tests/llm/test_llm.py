"""The corpus operators against SQL, brute force, libraries and held-out labels, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causalake.llm import decontaminate, language, mixing, near_dedup, quality_rules, queries, resampling, secrets, substring_dedup, tokens, url_filter
from causalake.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, _key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "The cat sat. " * 10, "en", "a", 5, 0.1, 1, "k"), (1, "The cat sat. " * 10, "en", "a", 5, 0.1, 1, "k"), (2, None, None, None, None, None, None, None), (3, "", "de", "b", 0, 0.2, 2, "k"), (None, "no id here", "en", None, 3, 0.3, 3, "k"), (4, long, "fr", "a", 9, 0.4, 4, "k"), (5, long, "fr", "a", 9, 0.5, 4, None), (6, " \n\t ", None, "b", 4, 0.6, 5, "k"), (3, "another text of 3", "de", "b", 4, 0.7, 6, "k")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (99, 1, None), (None, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, duck, name):
    from tests.conftest import rows, sql_rows

    df = queries.QUERIES[name](spark, sf)
    assert rows(df) == sql_rows(duck, queries.ORACLES[name], df.columns)


def test_fm_index():
    r = np.random.default_rng(0)
    for t in range(60):
        sigma, n = int(r.integers(2, 9)), int(r.integers(1, 120))
        x = np.append(np.tile(r.integers(0, sigma, n), 1 + t % 3), 0)
        f = FMIndex(x, sigma, sample=int(r.integers(1, 9)))
        p, length = r.integers(1, sigma, (10, 5)), r.integers(1, 6, 10)
        lo, hi = f.ranges(p, length)
        which, where = f.occurrences(lo, hi)
        for k in range(10):
            q = p[k, 5 - length[k] :]
            assert sorted(where[which == k].tolist()) == [i for i in range(len(x) - len(q) + 1) if (x[i : i + len(q)] == q).all()]


def test_urls_odd(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?y#z", "x://example.com/en/", "x://www.example.com/en/1", "x://b.net/es/", "x://net/fr/", "x://notexample.com/en/", "x://example.com", "a://b://c.com/"]
    pages = spark.createDataFrame([(i // 2, u, "r") for i, u in enumerate(urls * 2)], "page_id int, url string, rule string")
    out = [tuple(r) for r in url_filter.url_verdicts(pages, url_filter.rules_table(spark)).select("url", "host", "path", "rule", "verdict").collect()]
    assert len(out) == 2 * len(urls)
    by = {r[0]: r[1:] for r in out}
    assert by[None] == ("", "", None, "allow") and by["no scheme"][0] == ""
    assert by["HTTP://A.Example.COM/en/x?y#z"] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert by["x://www.example.com/en/1"][2:] == ("www.example.com/en/", "allow")
    assert by["x://net/fr/"][2:] == ("net/fr/", "block") and by["x://notexample.com/en/"][2] == "com/"
    assert by["x://example.com"][2] is None and by["a://b://c.com/"][0] == "b:"
    assert url_filter.url_verdicts(pages.limit(0), url_filter.rules_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages, url_filter.rules_table(spark).limit(0)).collect()} == {"allow"}


def test_bloom_lets_all_listed_keys_pass(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    held = url_filter.bloom(keys, "key", 16).scalar()
    assert keys.where(url_filter.may_hold(F.col("key"), held, 16)).count() == 500
    others = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert others.where(url_filter.may_hold(F.col("key"), held, 16)).count() < 1500


def test_mixing_odd(spark, odd, none):
    out = mixing.mix_sizes(odd).collect()
    assert len(out) == odd.count() and all(r.taken <= 2 * r["size"] for r in out)
    assert sum(r.taken for r in out) == pytest.approx(1.5 * sum(r["size"] for r in out), abs=3)
    assert mixing.mix_sizes(none).count() == 0 and mixing.mixed(none).count() == 0
    mixed = mixing.mixed(odd).collect()
    assert {r._key for r in mixed} <= {"k", None}
    assert sum(r.taken for r in mixed) == sum(r.taken for r in out)
    assert all(len(WORD.findall(r.text)) == r.taken for r in mixed)


def test_quality_counts(spark):
    r = random.Random(1)
    texts = ["", " \n", "a", "a b c a b c", "x\nx\n\n x", "#$ <b> é%"] + ["".join(r.choice("ab é#\n") for _ in range(r.randint(0, 80))) for _ in range(200)]
    counts, features = quality_rules.statistics(pa.array(texts))
    assert np.isfinite(features).all()
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k for j in range(len(w) - 2) if n[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert [int(counts[c][i]) for c in quality_rules.COUNTS] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)]


def test_quality_rules(spark, sf, odd, none, labels):
    out = queries.QUERIES["op3_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in out]) > 0.9
    got = quality_rules.judged(odd, labels).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.n_words < 50)
    assert quality_rules.judged(none, labels).count() == 0
    assert quality_rules.passed(odd, labels.limit(0)).columns == odd.columns


def test_resampling(spark, sf, odd, none, labels):
    d = f"{sf}/documents.parquet"
    out = queries.QUERIES["op2_importance_resampling"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(out) and spark.read.parquet(d).count() >= len(out)
    good, bad = [r.kept for r in out if r.quality == 1 and not r.toxic], [r.kept for r in out if r.quality == 0]
    assert np.mean(good) > np.mean(bad)
    assert resampling.resampled(odd, labels).count() == odd.count()
    assert resampling.resampled(none, labels).count() == 0
    assert all(r.kept for r in resampling.resampled(odd, labels.limit(0)).collect())


def test_kth_largest(spark):
    df = spark.range(30_000).select((F.xxhash64("id") % 1000).cast("double").alias("v"))
    v = sorted((r.v for r in df.collect()), reverse=True)
    assert [resampling.kth_largest(df, "v", k) for k in (1, 777, 29_999)] == [v[0], v[776], v[29_998]]


FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(docs, items, window=13):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = {}
    for i, t in items:
        w = FOLDED.findall(low(t))
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for t in docs:
        w, hit, names = FOLDED.findall(low(t)), set(), set()
        for k in {len(p) for p in windows}:
            for a in range(len(w) - k + 1):
                if (p := tuple(w[a : a + k])) in windows:
                    hit.update(range(a, a + k))
                    names |= windows[p]
        out.append((len(w), len(hit), sorted(names)))
    return out


def test_decontamination(spark, odd, none):
    r = random.Random(3)
    for _ in range(3):
        words = ["a", "B", "c", "é", "1"][: r.randint(1, 5)]
        text = lambda n: r.choice([" ", ". ", "\n"]).join(r.choice(words) for _ in range(n))  # noqa: B023, E731
        items = [(str(i), text(n)) for i, n in enumerate((0, 1, 3, 13, 20))] + [("x", None)]
        docs = [text(r.randint(0, 60)) for _ in range(12)] + [t for _, t in items] + ["A. " * 50, None]
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        bench = spark.createDataFrame(items, "item_id string, text string")
        got = [(x.n_words, x.n_hit, x["items"]) for x in decontaminate.benchmark_hits(df, bench).orderBy("doc_id").collect()]
        assert got == hits(docs, items)
        assert decontaminate.benchmark_hits(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(none, bench).count() == 0
    assert decontaminate.benchmark_hits(odd, bench).count() == odd.count()
    cut = decontaminate.cut_words("One, two three! Four", [(1, 3)])
    assert cut == "One, ! Four"


def test_secrets(spark, odd, none):
    text = 'my api-key: no\nPassword = "Tr0ub4dor" é token=abc secret: abcdef AKIA' + "A" * 16 + " pwd: xK9#mQ2!vT passphrase: 'password123' " + "0af" * 9
    got = secrets.scan(text)
    base = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    assert [s for s in got if s[2] == "assign"] == base
    assert [text[a:b] for a, b, k in got if k == "access"] == ["AKIA" + "A" * 16]
    assert [text[a:b] for a, b, k in got if k == "hex"] == ["0af" * 9]
    assert [text[a:b] for a, b, k in got if k == "guess"] == ["xK9#mQ2!vT"]
    assert secrets.guess_cost("password") < 1 < secrets.guess_cost("qwertyuiop") < secrets.guess_cost("x7$Kp") < secrets.guess_cost("x7$Kpq2!Zt")
    assert secrets.guess_cost("19991231") < 8 and secrets.guess_cost("aaaaaaaaaaaa") < 4 and secrets.guess_cost("") == 0
    assert "Tr0ub4dor" not in secrets.redact(text, got) and "é" in secrets.redact(text, got)
    out = secrets.secret_spans(odd, redacted="text")
    assert out.count() == odd.count() and out.where("text is null").count() == 1
    assert secrets.secret_spans(none).count() == 0


def test_near_duplicates(spark, odd, none):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(150)] for _ in range(8)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(6):
            c = list(b)
            for _ in range(r.randint(1, 3)):
                c[r.randrange(len(c))] = word()
            texts.append(" ".join(c))
    texts += [texts[0]] * 3 + [" ".join(word() for _ in range(150)) for _ in range(10)] + [None, None, "", "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in near_dedup.near_classes(df).collect()}
    assert len(got) == len(texts)
    # Every pair by brute force, with document frequencies of all rows, closed to classes.
    held = [Counter(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) if t else Counter() for t in texts]
    df, n = Counter(x for c in held for x in c), len(texts)
    weight = [{x: k * (1 + math.log(n / df[x]) / math.log(n)) for x, k in c.items()} for c in held]
    alike = lambda a, b: (m := sum(min(a[x], b[x]) for x in a.keys() & b.keys())) >= 0.8 * (sum(a.values()) + sum(b.values()) - m)
    expected = list(range(n))
    for i in range(n):
        for j in range(i):
            if (texts[i] is not None and texts[i] == texts[j]) or (texts[i] and texts[j] and alike(weight[i], weight[j])):
                a, b = expected[i], expected[j]
                expected = [min(a, b) if x in (a, b) else x for x in expected]
    assert [got[i].class_id for i in range(n)] == expected
    assert len({x.class_id for x in got.values()}) == sum(x.kept for x in got.values())
    assert near_dedup.near_classes(none).count() == 0
    out = near_dedup.near_classes(odd).collect()
    assert len(out) == odd.count() and sum(x.kept for x in out) == near_dedup.one_of_each(odd).count() == 7


def test_weighted_sampling_agrees_with_similarity():
    rng = np.random.default_rng(1)
    value = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    w = rng.uniform(0.5, 3, (2, 400))
    w[1, :250] = w[0, :250]
    expected = np.minimum(*w).sum() / np.maximum(*w).sum()
    picks = near_dedup.Sampler(2000).picks(np.repeat([0, 1], 400), np.tile(value, 2), w.ravel(), 2)
    assert abs((picks[0] == picks[1]).mean() - expected) < 0.05


def test_tokens(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, r = Tokenizer.from_file(path), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "<|endoftext|>", "é", "日本", "1", "23", "!", "\u00a0", "\x1c", "\u2003", "the", " the", "\r\n", "\x0b", "?!"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["", " ", "x" * 5000]
    assert tokens.count_texts(pa.array(texts), path, {}).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    out = tokens.token_counts(odd, path)
    assert out.count() == odd.count() and out.where("n_tokens = 0").count() == 2
    assert tokens.token_counts(none, path).count() == 0


def removed(docs):
    first = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12) if d is not None else ():
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - 12) if d is not None else ():
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 30])
def test_substrings(spark, n):
    r = random.Random(n)
    base = [" ".join(r.choice([f"w{i}" for i in range(n)]) for _ in range(r.randint(0, 60))) for _ in range(15)]
    docs = [(r.choice([i, i, 7, None]), r.choice([f"{r.choice(base)} x {r.choice(base)}", r.choice(base), None, "", r.choice(base).replace(" ", "\n")])) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.text) for x in substring_dedup.deduplicated(df).collect()), key=str) == removed(docs)


def test_substrings_odd(odd, none):
    out = substring_dedup.deduplicated(odd)
    assert out.count() == odd.count() and {r._key for r in out.collect()} == {"k", None}
    assert substring_dedup.deduplicated(none).count() == 0


def test_language(spark, sf, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.classify(docs.where(language.held_out()), language.fit(docs.where(~language.held_out()))).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    held = {r.doc_id for r in docs.where(language.held_out()).collect()}
    assert held == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    known = language.fit(odd)
    got = language.classify(odd.drop("lang"), known).collect()
    assert [r.lang_pred for r in got if r.doc_id in (2, 6)] == ["und", "und"] and all(0 <= r.score <= 1 for r in got)
    assert language.fit(none) == {} and language.classify(none, known).count() == 0
    assert {r.lang_pred for r in language.classify(odd, {}).collect()} == {"und"}


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == docs.columns
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.createDataFrame(new.collect(), new.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before), name
        if name == "decontamination":
            ids = sorted(before)
            bad = {i for i, (n, h, _) in zip(ids, hits([before[i].text for i in ids], bench), strict=True) if h and 20 * h >= n}
            assert set(before) - set(after) == bad
        if name == "secret scans":
            assert set(after) == set(before) and not any(secrets.HEX.search(r.text) for r in after.values())
    out = corpus_pipeline.mixture(spark, docs, sf).collect()
    assert out and all(len(WORD.findall(r.text)) == r.taken for r in out)


def test_digest_of_secrets(spark, sf):
    out = queries.QUERIES["op6_secret_scans"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in out[:200]:
        t, spans = texts[r.doc_id], []
        for m in secrets.ASSIGN.finditer(t):
            if len(m[2]) >= 6:
                spans.append((m.start(), 0, m.end(), "assign"))
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
