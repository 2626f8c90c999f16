"""Operator 12, repair of a conversation's structure at the least cost.

A conversation is well formed if its roles' initials read `(s?(ua)+)?`. Edits have costs; what the rows from some place
on still cost, for each state of that grammar, is a vector. Less its least value it is a state of a lazily determinised
weighted automaton: states and transitions are made when first met and kept in a table, so the scan of a conversation,
from its last row to its first, is one look-up a row. The trace then runs against the scan along arcs that attain the
cost, the ASCII-least first.

Conversations are streamed: rows are dealt by conversation and sorted, and a task holds a few bytes for each row of the
conversation at hand, never its texts; those follow in a second sorted stream, behind the edits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from .common import CHUNK_BYTES, read, ship, written

#: States of the grammar: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (BEGIN, ASSISTANT)
#: Where an initial leads to, by state, and the one role that an inserted or renamed row can have there.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FRESH = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
ROLE_INITIALS = ("s", "u", "a")
LEGAL = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What the automaton reads: a row that must go, or an initial ("" for all others) and whether the text is cut off.
SYMBOLS = (None, *((i, cut) for i in ("s", "u", "a", "") for cut in (0, 1)))
#: The first fault of a row.
WHOLE, BLANK, DUPLICATE, CUT = range(4)
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repairs:
    """Cost-to-go vectors as numbered states, transitions and steps of the trace, each computed once."""

    def __init__(self) -> None:
        self.ids, self.vectors, self.moves, self.steps = {}, [], {}, {}
        self.last, _ = self._state(self._inserted([0 if q in ENDS else 1 << 40 for q in range(4)]))

    def _state(self, v: list) -> tuple[int, int]:
        """The state of a vector, and the least value that was taken off it."""
        least = min(v)
        key = tuple(x - least for x in v)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self.ids[key], least

    @staticmethod
    def _inserted(v: list) -> list:
        """v with insertions allowed before its place; two in a row reach every state that insertions reach."""
        for _ in range(2):
            v = [min(v[q], INSERT + v[NEXT[q][FRESH[q]]]) for q in range(4)]
        return v

    @staticmethod
    def edits(symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost, next state) of each way to treat a row that comes in state q."""
        out = [("D", DELETE, q)]
        if SYMBOLS[symbol]:
            initial, cut = SYMBOLS[symbol]
            if initial in NEXT[q]:
                out.append(("K", cut * TRUNCATED, NEXT[q][initial]))
            out.append(("R", REROLE + cut * TRUNCATED, NEXT[q][FRESH[q]]))
        return out

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row, from that behind it, and the cost taken off."""
        got = self.moves.get((state, symbol))
        if got is None:
            v = self.vectors[state]
            got = self.moves[state, symbol] = self._state(self._inserted([min(c + v[to] for _, c, to in self.edits(symbol, q)) for q in range(4)]))
        return got

    def step(self, behind: int, symbol: int | None, q: int) -> tuple[str, int]:
        """Edits before a row and on it, or up to the end (no symbol), from grammar state q; and the state reached."""
        key = behind, symbol, q
        if key in self.steps:
            return self.steps[key]
        after, letters = self.vectors[behind], ""
        before, off = (behind, 0) if symbol is None else self.move(behind, symbol)
        here = self.vectors[before]
        while not (symbol is None and q in ENDS and here[q] == 0):
            tight = {} if symbol is None else {x: to for x, c, to in self.edits(symbol, q) if c + after[to] == here[q] + off}
            if here[q] == INSERT + here[NEXT[q][FRESH[q]]]:
                tight["I"] = NEXT[q][FRESH[q]]
            letter = min(tight)
            letters, q = letters + letter, tight[letter]
            if letter != "I":
                break
        self.steps[key] = letters, q
        return letters, q

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost, and the ASCII-least edits that attain it."""
        states, cost = array("i", [self.last]), 0
        for s in reversed(symbols):
            state, off = self.move(states[-1], s)
            states.append(state)
            cost += off
        q, out = BEGIN, []
        for i, s in enumerate(symbols):
            letters, q = self.step(states[len(symbols) - 1 - i], s, q)
            out.append(letters)
        return cost + self.vectors[states[-1]][BEGIN], "".join(out) + self.step(self.last, None, q)[0]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults of the contract, chosen by crc32 of `conv_id:turn`. Nulls count as one space."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn"))) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace(held("text"), "[.!?]", "")).otherwise(held("text"))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("_k")).where("_k <> 0")
    times = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(held("role")).alias("role"), text.alias("text"), F.explode(times).alias("_n")).drop("_n")


def _rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls, and a digest of the text, by which ties are ordered."""
    held = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    return held.withColumn("digest", F.unhex(F.md5("text")))


def _dealt(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Each conversation in one partition, in the order of its rows."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows without conv_id) one conversation after another, read as they come."""
    rows = (r for b in batches for piece in range(0, b.num_rows, 1024) for r in zip(*(c.to_pylist() for c in b.slice(piece, 1024).columns), strict=True))
    return ((k, (r[1:] for r in g)) for k, g in groupby(rows, key=lambda r: r[0]))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size=lambda r: 64) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about 2 MB."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total > CHUNK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row for each conversation.

    rows: conv_id, turn, role, text; other columns are ignored, whatever their names. A conversation's rows are taken by
    turn, nulls first; rows of one turn by role and a digest of the text, so that equal rows stand together. A null role
    or text counts as one space; a null conv_id is a conversation of its own. Of equal rows the first is judged for
    itself, the rest are duplicates. An empty table gives an empty result. A conversation may have any number of rows, a
    third of all too: one task streams it and holds some six bytes a row, as its audit is one string; duplicates are found
    dealt by conversation, role and text. Texts are judged whole, however long, and don't leave their task here.
    """
    ship(rows.sparkSession)
    bare = F.rtrim("text", F.lit(SPACE))
    earlier = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    marked = _rows(rows).select("conv_id", "turn", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    marked = marked.withColumn("again", F.row_number().over(earlier) > 1)
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("cut"), CUT).otherwise(WHOLE)
    sent = _dealt(marked.withColumn("fault", fault), F.col("turn").asc_nulls_first(), "role", "digest", "again")
    schema = StructType([rows.schema["conv_id"]])
    for c in COUNTS:
        schema.add(c, LongType())
    schema.add("audit", StringType())
    arrow = to_arrow_schema(schema)
    code = {s: i for i, s in enumerate(SYMBOLS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = Repairs()

        def one(conv, held: Iterator[tuple]) -> tuple:
            symbols, faults, illegal, before = bytearray(), [0] * 4, 0, None
            low, high, turns = None, None, 0
            for turn, initial, kind in held:
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                illegal += before is not None and before + initial not in LEGAL
                before = initial
                faults[kind] += 1
                symbols.append(code[None] if kind in (BLANK, DUPLICATE) else code[initial if initial in ROLE_INITIALS else "", int(kind == CUT)])
            cost, audit = repairs.repair(symbols)
            gaps = 0 if low is None else int(high) - int(low) + 1 - turns
            return conv, gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, cost, audit

        yield from _batches((one(c, g) for c, g in _streamed(batches)), arrow, lambda r: 128 + len(r[-1]))

    return sent.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault").mapInArrow(run, schema)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text, edit (K, R or I): the rows of each repaired conversation, in order.

    audited: conv_id and audit from audits() on the same rows. Conversations come one after another within a
    partition, in order of position; one that ends up empty has no row. Texts are streamed: a task holds one audit and
    a few rows. Nulls, ties and repeated rows are taken as in audits().
    """
    ship(rows.sparkSession)
    none = F.lit(None)
    heads = audited.select("conv_id", F.lit(0).alias("part"), none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.col("audit").alias("text"))
    told = heads.unionByName(_rows(rows).withColumn("part", F.lit(1)))
    sent = _dealt(told, "part", F.col("turn").asc_nulls_first(), "role", "digest").select("conv_id", "role", "text")
    schema = StructType([rows.schema["conv_id"]]).add("position", LongType()).add("role", StringType()).add("text", StringType()).add("edit", StringType())
    arrow = to_arrow_schema(schema)

    def edited(conv, held: Iterator[tuple]) -> Iterator[tuple]:
        audit = next(held)[1]
        q, n = BEGIN, 0
        for edit in audit:
            role, text = (ROLES[FRESH[q]], "") if edit == "I" else next(held)
            if edit == "D":
                continue
            role = role if edit == "K" else ROLES[FRESH[q]]
            yield conv, n, role, text, edit
            q, n = NEXT[q][role[:1]], n + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for c, g in _streamed(batches) for r in edited(c, g)), arrow, lambda r: 64 + len(r[3]))

    return sent.mapInArrow(run, schema)


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 over newline-joined `role:text` of the rows of repaired(), fed to the hash as they come."""
    schema = StructType([fixed.schema["conv_id"]]).add("repaired_sha256", StringType())
    arrow = to_arrow_schema(schema)

    def one(conv, held: Iterator[tuple]) -> tuple:
        h = hashlib.sha256()
        for i, (role, text) in enumerate(held):
            h.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        return conv, h.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((one(c, g) for c, g in _streamed(batches)), arrow)

    return fixed.select("conv_id", "role", "text").mapInArrow(run, schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as the contract says, with its faults, cheapest repair and a hash of what it gives."""
    given = read(spark, sf_dir, "conversations")
    rows = damaged(given)
    told = written(audits(rows), "audits")
    out = given.select("conv_id").distinct()
    for i, right in enumerate((told, digests(repaired(rows, told)))):
        right = right.withColumnRenamed("conv_id", f"_c{i}")
        out = out.join(right, F.col("conv_id").eqNullSafe(F.col(f"_c{i}")), "left").drop(f"_c{i}")
    zero = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS)
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: crc32 bit by bit; the repair as a recursion from a conversation's last row, with the cost (six digits) before the edits in
#: one string for each grammar state, so that the least string is the cheapest repair and the first of those in ASCII order.
SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
k AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(k)), lambda i: ascii(substr(k, i + 1, 1))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
f AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    lag(substr(role, 1, 1)) OVER w AS was, substr(role, 1, 1) AS ini,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
s AS (
  SELECT *, NOT blank AND NOT again AND cut AS short, NOT blank AND NOT again AS may, CASE WHEN NOT blank AND NOT again AND cut THEN 1 ELSE 0 END AS more FROM f),
r AS (
  SELECT DISTINCT conv_id, of + 1 AS n, '000000' AS b, '000004II' AS y, '000002I' AS u, '000000' AS a FROM s
  UNION ALL
  SELECT conv_id, n, least(b, CASE WHEN u IS NULL THEN b ELSE printf('%06d', u[1:6]::INT + 2) || 'I' || u[7:] END, printf('%06d', a[1:6]::INT + 4) || 'II' || a[7:]) AS b,
    least(y, printf('%06d', u[1:6]::INT + 2) || 'I' || u[7:], printf('%06d', a[1:6]::INT + 4) || 'II' || a[7:]) AS y,
    least(u, printf('%06d', a[1:6]::INT + 2) || 'I' || a[7:]) AS u, least(a, printf('%06d', u[1:6]::INT + 2) || 'I' || u[7:]) AS a
  FROM (
    SELECT s.conv_id, s.n,
      least(printf('%06d', r.b[1:6]::INT + 3) || 'D' || r.b[7:],
        CASE WHEN may AND ini = 's' THEN printf('%06d', r.y[1:6]::INT + more) || 'K' || r.y[7:] WHEN may AND ini = 'u' THEN printf('%06d', r.u[1:6]::INT + more) || 'K' || r.u[7:] ELSE '9' END,
        CASE WHEN may THEN printf('%06d', r.u[1:6]::INT + more + 2) || 'R' || r.u[7:] ELSE '9' END) AS b,
      least(printf('%06d', r.y[1:6]::INT + 3) || 'D' || r.y[7:],
        CASE WHEN may AND ini = 'u' THEN printf('%06d', r.u[1:6]::INT + more) || 'K' || r.u[7:] ELSE '9' END,
        CASE WHEN may THEN printf('%06d', r.u[1:6]::INT + more + 2) || 'R' || r.u[7:] ELSE '9' END) AS y,
      least(printf('%06d', r.u[1:6]::INT + 3) || 'D' || r.u[7:],
        CASE WHEN may AND ini = 'a' THEN printf('%06d', r.a[1:6]::INT + more) || 'K' || r.a[7:] ELSE '9' END,
        CASE WHEN may THEN printf('%06d', r.a[1:6]::INT + more + 2) || 'R' || r.a[7:] ELSE '9' END) AS u,
      least(printf('%06d', r.a[1:6]::INT + 3) || 'D' || r.a[7:],
        CASE WHEN may AND ini = 'u' THEN printf('%06d', r.u[1:6]::INT + more) || 'K' || r.u[7:] ELSE '9' END,
        CASE WHEN may THEN printf('%06d', r.u[1:6]::INT + more + 2) || 'R' || r.u[7:] ELSE '9' END) AS a
    FROM r JOIN s ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.n = r.n - 1)),
best AS (SELECT conv_id, b[1:6]::BIGINT AS cost, b[7:] AS audit FROM r WHERE n = 1),
e AS (
  SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS edit, audit FROM best WHERE audit <> ''),
g AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS row, count(*) FILTER (edit <> 'D') OVER w AS o FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
m AS (
  SELECT g.*, s.role, s.text, first_value(coalesce(s.ini, '')) OVER (PARTITION BY g.conv_id ORDER BY g.edit = 'D', g.p) AS lead, first_value(g.edit) OVER (PARTITION BY g.conv_id ORDER BY g.edit = 'D', g.p) AS led
  FROM g LEFT JOIN s ON g.edit <> 'I' AND s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.n = g.row),
t AS (
  SELECT conv_id, p, CASE WHEN edit = 'K' THEN role WHEN (o - CASE WHEN lead = 's' AND led = 'K' THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM m WHERE edit <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS repaired_sha256 FROM t GROUP BY conv_id),
a AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (short) AS truncated, count(*) FILTER (was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM o LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
