"""Operator 12: least costs and audits against all edit sequences, the SQL, odd tables."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re

from causalake.llm import conversations as C
from tests.conftest import rows, sql_rows


def search(symbols):
    """The cheapest edits, ASCII-least of them, by best-first search over (place, role initials so far)."""
    nexts = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    queue, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(symbols) and last in ("", "a"):
            return cost, audit
        for new in nexts[last] - {"s"}:
            heapq.heappush(queue, (cost + 2, audit + "I", i, new))
        if i < len(symbols):
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, last))
            if C.SYMBOLS[symbols[i]]:
                initial, cut = C.SYMBOLS[symbols[i]]
                if initial in nexts[last]:
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, initial))
                for new in nexts[last] - {"s"}:
                    heapq.heappush(queue, (cost + 2 + cut, audit + "R", i + 1, new))


def test_repairs_equal_search():
    r, repairs = random.Random(3), C.Repairs()
    short = [bytes(x) for n in range(4) for x in itertools.product(range(len(C.SYMBOLS)), repeat=n)]
    for symbols in short + [bytes(r.choices(range(len(C.SYMBOLS)), k=r.randrange(4, 40))) for _ in range(800)]:
        assert repairs.repair(symbols) == search(symbols), symbols
    assert len(repairs.vectors) < 100  # states are few, whatever was read


def judged(given):
    """The contract on a list of (turn, role, text), nulls already replaced, in order."""
    seen, symbols, faults, initials = set(), [], [0, 0, 0], []
    for _, role, text in given:
        bare = text.strip(C.SPACE)
        kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            faults[kind] += 1
        initials.append(role[:1])
        symbols.append(0 if kind in (0, 1) else C.SYMBOLS.index((role[:1] if role[:1] in tuple("sua") else "", int(kind == 2))))
    turns = [t for t, _, _ in given if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = search(bytes(symbols))
    out, it = [], iter(given)
    for e in audit:
        after = "a" if out and out[-1][:1] == "u" else "u"
        _, role, text = (None, C.ROLES[after], "") if e == "I" else next(it)
        if e != "D":
            out.append(f"{role if e == 'K' else C.ROLES[after]}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))
    return gaps, *faults, sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def operated(df):
    told = C.audits(df)
    fixed = {r.conv_id: r.repaired_sha256 for r in C.digests(C.repaired(df, told)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (*(r[c] for c in C.COUNTS), r.audit, fixed.get(r.conv_id, none)) for r in told.collect()}


def test_operator_equals_contract(spark):
    r, given = random.Random(9), {}
    texts = ["Yes.", "No!", "cut off", " ", "", "Fine? \t", None, "end.\x0b", "x.　", "漢字。"]
    for conv in [None, *range(60)]:
        turns = sorted(r.sample(range(20), r.randrange(0, 9)))
        given[conv] = [(t if i else r.choice([t, None]), r.choice(["user", "assistant", "system", "tool", "", None, "u", "a2"]), r.choice(texts)) for i, t in enumerate(turns)]
    flat = [(c, *x) for c, xs in given.items() for x in xs]
    r.shuffle(flat)
    df = spark.createDataFrame([(*x, "m") for x in flat], "conv_id long, turn long, role string, text string, digest string").repartition(5)
    space = lambda v: " " if v is None else v
    assert operated(df) == {c: judged([(t, space(ro), space(x)) for t, ro, x in xs]) for c, xs in given.items() if xs}


def test_repeated_rows_and_ties(spark):
    one = [("c", 1, "user", "Hi."), ("c", 1, "user", "Hi."), ("c", 1, "user", "Hi."), ("c", 2, "assistant", "Yes.")]
    got = operated(spark.createDataFrame(one, "conv_id string, turn int, role string, text string"))["c"]
    assert got[:7] == (0, 0, 2, 0, 2, 6, "KDDK")
    tied = [("c", 1, "user", "Hi."), ("c", 1, "assistant", "Yes."), ("c", None, "system", "Be.")]
    a, b = (operated(spark.createDataFrame(x, "conv_id string, turn int, role string, text string").repartition(3)) for x in (tied, tied[::-1]))
    assert a == b


def test_long_conversation(spark):
    n = 60_000
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Text ', id, if(id % 3 = 0, '', '.')) as text")
    told = C.audits(df).collect()
    assert [(r.cost, r.audit, r.truncated) for r in told] == [(n // 3, "K" * n, n // 3)]
    assert C.repaired(df, C.audits(df)).count() == n


def test_long_text_and_empty_table(spark):
    text = "word " * 400_000 + "."
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    want = hashlib.sha256(f"user:{text}\nassistant:{text}".encode()).hexdigest()
    assert operated(df)[1] == (0, 0, 0, 0, 0, 0, "KK", want)
    assert operated(df.limit(0)) == {}


def test_query_equals_sql(spark, sf, duck):
    out = C.op12_conversation_repair(spark, sf)
    assert rows(out) == sql_rows(duck, C.SQL, out.columns)


def test_damage(spark):
    import zlib

    df = spark.createDataFrame([(c, t, "assistant", "A. B! C?") for c in range(40) for t in [None, *range(6)]], "conv_id long, turn long, role string, text string")
    want = []
    for c in range(40):
        for t in [None, *range(6)]:
            kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
            row = (c, t, "user" if kind == 4 else "assistant", {1: "", 2: "A B C"}.get(kind, "A. B! C?"))
            want += [row] * {0: 0, 3: 2}.get(kind, 1)
    assert sorted(map(str, C.damaged(df).collect())) == sorted(f"Row(conv_id={c}, turn={t}, role={r!r}, text={x!r})" for c, t, r, x in want)
