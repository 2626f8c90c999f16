"""Hosts of very many labels, and the same verdicts as by each rule tried on each url."""

from __future__ import annotations

import random
import time

from causalake.llm.url_filter import RULES, rules_table, url_verdicts


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:at], rest[at:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_as_each_rule(spark):
    r = random.Random(3)
    rules = [*RULES, ("block", "a.b.c.d", "/"), ("allow", ".b.c.d", ""), ("block", "..", "/x")]
    hosts = ["com", "example.com", "WWW.Example.com", "xexample.com", "a.net", "net", "z.a.b.c.d", "b.c.d", "..b.c.d", "..", "...", "", ".", "com.", "a..com"]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en', '/es/a', '/x', '/fr/?q#f', '?a/', '#'])}" for _ in range(400)] + [None, "", "x", "://com/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_verdicts(pages, rules_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_many_labels(spark):
    url = "https://" + "a." * 200_000 + "example.com/en/x"
    pages = spark.createDataFrame([(1, url), (2, "http://" + "b" * 400_000 + ".net/es/")], "page_id int, url string")
    held = url_verdicts(pages, rules_table(spark)).select("page_id", "rule", "verdict")
    start = time.monotonic()
    assert sorted(map(tuple, held.collect())) == [(1, "example.com/en/", "block"), (2, "net/es/", "block")]
    assert time.monotonic() - start < 20
