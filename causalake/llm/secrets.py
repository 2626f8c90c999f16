"""Operator 6, secret scans: fixed patterns, and password guess cost for values in a credential context.

Guess cost is the least, over all ways to cut a value into segments, of the product of what an attacker tries
for each segment: words by their place in a list, dates, repeats of what stands before, walks on the keyboard,
and brute force for the rest. The minimum over all cuts is found by dynamic programming in time linear in the
value's length. The list starts with common password words; the corpus's own words follow, by their counts over
all documents, so that plain prose after `secret:` is cheap. A value after a word such as `passphrase` or `pwd`,
or before the @ of a url, that costs many guesses is a secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import pieces, read, split_words, texts_of, written

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Credential contexts of the method: a name, an optional quote, a sign (or `is`), and a value without white space;
#: and a url's user (of any length, or none) and password. Blanks and tabs around a sign may be any number, line breaks a few.
CONTEXT = re.compile(r"""(?<![A-Za-z])(pass(?:word|wd|phrase|code|key)?|pwd|psk|secret|token|credentials?|api[_-]?key|(?:access|private|signing|encryption|ssh)[_-]?key|auth(?:orization)?|bearer|login)(["']?(?:[\x20\t]+|\s{0,4})(?:=>|:=|[:=])(?:[\x20\t]+|\s{0,4})|(?:[\x20\t]+|\s{1,4})is(?:[\x20\t]+|\s{1,4}))(["']?)([^\s"'<>]{6,})""", re.I | re.A)
USERINFO = re.compile(r"://[^\s/:@]*:([^\s/@]{6,})@")
#: A value is a secret from this many guesses, as a power of ten.
GUESSES = 9.0
#: Common words of passwords, commonest first.
WORDS = (
    "password the and for you that with this have from love baby angel money secret admin login welcome master "
    "dragon monkey shadow sunshine princess football baseball superman batman soccer hockey killer hunter ranger "
    "summer winter spring autumn monday friday january february march april june july august september october "
    "november december hello friend family happy lucky star blue green black white silver gold flower butterfly "
    "purple orange cookie cheese pepper ginger computer internet server system network user guest test demo sample "
    "example change token access key value none null true false default root pass word text data file"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn")

#: Words of the corpus in the list, at most; letters of a word, at least and at most.
FITTED, SHORTEST, LONGEST = 20_000, 3, 20
#: Runs and walks are tried from so many places before their end, and from their start; blocks said again up to this width.
BACK, BLOCKS = 24, 12

RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(b, a) for a, b in _NEXT}
_LOW = {c: c + 32 for c in range(65, 91)}
_LEET = str.maketrans("@4310$57", "aaeiosst")
_Y, _M, _D, _MM, _DD = r"(?:19|20)\d\d", r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])", r"(?:1[0-2]|0[1-9])", r"(?:3[01]|[12]\d|0[1-9])"
_DATES = [
    re.compile(x)
    for x in (
        _Y,
        f"{_Y}[-/.]{_M}",
        f"{_Y}([-/.]){_M}\\1{_D}",
        f"{_D}([-/.]){_M}\\1{_Y}",
        f"{_M}([-/.]){_D}\\1{_Y}",
        f"{_D}([-/.]){_M}\\1\\d\\d",
        f"{_M}([-/.]){_D}\\1\\d\\d",
        f"{_Y}{_MM}{_DD}",
        f"{_DD}{_MM}{_Y}",
        f"{_MM}{_DD}{_Y}",
        f"\\d\\d{_MM}{_DD}",
        f"{_DD}{_MM}\\d\\d",
        f"{_MM}{_DD}\\d\\d",
    )
]
#: Guesses for a year, and for a day of any of 120 years.
YEARS, DAYS = math.log10(120), math.log10(365 * 120)


def guess_cost(value: str, ranks: dict[str, int] | None = None, limit: float = math.inf) -> float:
    """log10 of the guesses for a value: the cheapest segmentation, by dynamic programming.

    Each further segment costs a factor of two, for the choice of its kind. Linear in the length. Exact below
    `limit`; from there on the answer may be a lower bound that is not below it.
    """
    ranks = RANKS if ranks is None else ranks
    low = value.translate(_LOW)
    plain = low.translate(_LEET)
    # best: cheapest for value[:j]; brute: cheapest that ends in an open brute-force span.
    best, brute = [0.0], math.inf
    step = math.log10(2)
    walk = run = 1
    dates: dict[int, list[int]] = {}
    for j in range(1, len(value) + 1):
        if value[j - 1].isdigit():
            for m in filter(None, (d.match(value, j - 1) for d in _DATES)):
                dates.setdefault(m.end(), []).append(j - 1)
        more = lambda k: best[k] + (step if k else 0)  # noqa: E731, B023
        c = value[j - 1]
        each = math.log10(26 if c.islower() or c.isupper() else 10 if c.isdigit() else 33)
        found = brute = min(brute, more(j - 1)) + each
        for k in range(max(0, j - LONGEST), j - SHORTEST + 1):
            rank = ranks.get(low[k:j]) or (ranks.get(plain[k:j]) or 0) * 4
            if rank:
                found = min(found, more(k) + math.log10(rank * (1 if value[k:j] == low[k:j] else 2)))
        for k in dates.pop(j, ()):
            found = min(found, more(k) + (YEARS if j - k == 4 else DAYS))
        run = run + 1 if j > 1 and low[j - 1] == low[j - 2] else 1
        walk = walk + 1 if j > 1 and (low[j - 2], low[j - 1]) in _NEXT else 1
        for length in (*range(3, min(run, BACK) + 1), *[run] * (run > BACK)):
            found = min(found, more(j - length) + each + math.log10(length))
        for length in (*range(3, min(walk, BACK) + 1), *[walk] * (walk > BACK)):
            found = min(found, more(j - length) + math.log10(47 * length * 2))
        for width in range(2, min(BLOCKS, j // 2) + 1):
            if low[j - width : j] == low[j - 2 * width : j - width]:
                found = min(found, more(j - width))
        best.append(found)
        # No later segment starts further back, and segments cost nothing less than zero.
        if run <= BACK and walk <= BACK and min(best[-BACK - 1 :]) >= limit:
            return min(best[-BACK - 1 :])
    return best[-1]


def scan(text: str, guesses: float = GUESSES, ranks: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, ordered by start, then kind. Ends are exclusive, in code points."""
    found = []
    lower = text.lower()
    if any(x in text for x in "=:") and any(x in lower for x in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    starts, ends = [a for a, _, _ in found], [b for _, b, _ in found]
    values = []
    if any(x in lower for x in ("pass", "pwd", "psk", "secret", "token", "credential", "key", "auth", "bearer", "login")):
        for m in CONTEXT.finditer(text):
            # Marks that close a sentence or a bracket are not the value's.
            value = m[4].rstrip(".,;:)]}")
            if m[2].strip().lower() != "is" or re.search(r"\d", value) and re.search(r"[A-Za-z]", value):
                values.append((m.start(4), m.start(4) + len(value)))
    if "://" in text:
        held = set(values)
        values += [v for m in USERINFO.finditer(text) if (v := m.span(1)) not in held]
    for a, b in values:
        at = bisect_right(starts, a) - 1  # base spans don't overlap
        if b - a >= 6 and not (at >= 0 and b <= ends[at]) and guess_cost(text[a:b], ranks, guesses) >= guesses:
            found.append((a, b, 3))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def word_ranks(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Ranks of common password words, then of the corpus's FITTED commonest words, counted over all whole texts.

    Words are runs of SHORTEST to LONGEST letters a-z, in either case; equal counts go by the word. Each piece of texts is
    counted before the shuffle. Words are taken in whole bins of counts (a sixteenth of a doubling) while FITTED or fewer are
    in them, so no more than that come to the driver. Null and empty texts have no words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            letters = pc.replace_substring_regex(pc.ascii_lower(texts_of(piece, text)), "[^a-z]+", " ")
            words, _ = split_words(letters)
            size = pc.binary_length(words)
            words = words.filter(pc.and_(pc.greater_equal(size, SHORTEST), pc.less_equal(size, LONGEST)))
            held = pc.value_counts(words)
            yield pa.RecordBatch.from_pydict({"word": held.field("values"), "n": held.field("counts")})

    counts = docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("bin", F.floor(F.log2("n") * 16)), "word-counts")
    cut, taken = 0, 0
    for r in sorted(counts.groupBy("bin").count().collect(), reverse=True):  # 16 * 63 bins at most
        taken += r["count"]
        if taken > FITTED:
            cut = r["bin"] + 1
            break
    ranks = dict(RANKS)
    for r in sorted(counts.where(F.col("bin") >= cut).collect(), key=lambda r: (-r["n"], r["word"])):
        ranks.setdefault(r["word"], len(ranks) + 1)
    return ranks


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a], mark] if a >= at else [mark]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


SPAN = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())]))


def secret_spans(docs: DataFrame, text: str = "text", guesses: float = GUESSES, redacted: str | None = None, ranks: dict[str, int] | None = None) -> DataFrame:
    """docs with `secret_spans`, an array of (start, end, kind); with `redacted`, also the cleaned text under that name.

    Null texts have no spans (and stay null); empty texts none. Texts of any length are scanned whole, in one
    task each. Repeated rows get equal results. Columns of docs with one of the new names are replaced. The word list
    is counted over docs unless `ranks` gives one; then a map over rows: no shuffle, nothing kept, so any lost task is
    simply run again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text) if ranks is None else ranks)  # FITTED words and the typed ones
    new = ["secret_spans"] + [redacted] * bool(redacted and redacted != text)
    rest = [c for c in docs.columns if c not in new]
    fields = [docs.schema[c] for c in rest] + [StructField("secret_spans", SPAN)] + [StructField(c, StringType()) for c in new[1:]]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            spans, clean = [], []
            for t, known in zip(texts_of(piece, text).to_pylist(), piece.column(text).is_valid().to_pylist(), strict=True):
                got = scan(t, guesses, shared.value)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in got])
                if redacted:
                    clean.append(redact(t, got) if known else None)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            held = {c: piece.column(c) for c in rest} | {"secret_spans": pa.array(spans, kind)}
            if redacted:
                held[redacted] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_pydict(held)

    return docs.select(*rest).mapInArrow(find, StructType(fields))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, and digests of the spans of the base patterns."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(s["start"], s["end"], s["kind"]) for s in x] for x in batch.column("secret_spans").to_pylist()]
            base = [[s for s in x if s[2] != "guess"] for x in rows]
            held = {"doc_id": batch.column("doc_id")}
            held |= {f"n_{k}": pa.array([sum(s[2] == k for s in x) for x in rows], pa.int64()) for k in KINDS[:3]}
            held["base_sha256"] = pa.array([hashlib.sha256(shown(x).encode()).hexdigest() for x in base], pa.string())
            held["spans"] = pa.array([shown(x) for x in rows], pa.string())
            yield pa.RecordBatch.from_pydict(held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return secret_spans(docs).select("doc_id", "secret_spans").mapInArrow(digest, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
