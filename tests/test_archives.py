"""Lines of archives cut inside their files, and replayed requests."""

from __future__ import annotations

import gzip
import lzma
import random
import subprocess

import pytest

from causalake.sources import archives as A

TEXTS = ["", "\n", "a", "a\n", "a\nb", "\n\na\n\n", "x" * 5000 + "\ny", "é\r\nß\n" * 40, "\n".join(f"row {i}\tvalue" for i in range(3000))]


def held(df):
    return [r.line for r in df.orderBy("path", "part", "ord").collect()]


def expected(text):
    out = text.split("\n")
    return [x.removesuffix("\r") for x in (out[:-1] if out[-1] == "" else out)]


def cuts(text, n, seed):
    """The text's bytes in n pieces at any places, also inside lines and characters."""
    data, r = text.encode(), random.Random(seed)
    at = sorted(r.randrange(len(data) + 1) for _ in range(n - 1))
    return [data[a:b] for a, b in zip([0, *at], [*at, len(data)], strict=True)]


def reading(path, size):
    """Partition by partition without a session, as Spark would run them."""
    r = A.ArchiveReader({"path": str(path), "partition_bytes": str(size)})
    return [x for p in r.partitions() for b in r.read(p) for x in b.column("line").to_pylist()]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
@pytest.mark.parametrize("size", [1, 7, 100, 5000, 1 << 20])
def test_any_cut(tmp_path, text, size):
    if size == 1 and len(text) > 3000:
        size = 50
    for seed in range(3):
        pieces = cuts(text, 5, seed)
        (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(p) for p in pieces) + b"\0" * seed)
        (tmp_path / "b.xz").write_bytes(b"".join(lzma.compress(p) + b"\0" * 4 * seed for p in pieces))
        (tmp_path / "c").write_bytes(text.encode())
        for name in ("a.gz", "b.xz", "c"):
            assert reading(tmp_path / name, size) == expected(text), (name, seed)


def test_stored_members_and_noise(tmp_path):
    """Incompressible members hold many bytes that look like a member's start."""
    r = random.Random(5)
    lines = ["".join(r.choice("0123456789abcdef") for _ in range(50)) for _ in range(400)]
    data = "\n".join(lines).encode()
    pieces = [data[:9000], data[9000:]]
    raw = gzip.compress(pieces[0], 0) + gzip.compress(pieces[1], 0)
    (tmp_path / "a.gz").write_bytes(raw)
    assert reading(tmp_path / "a.gz", 333) == lines
    f = A._opened(str(tmp_path / "a.gz"))
    assert A.first_member(f, 1, len(raw), len(raw)) == len(gzip.compress(pieces[0], 0))
    (tmp_path / "n.gz").write_bytes(gzip.compress(b"ab\n", 0) + gzip.compress(("k\n" * 500).encode(), 0))
    assert reading(tmp_path / "n.gz", 40) == ["ab"] + ["k"] * 500


def test_blocks_of_one_stream(tmp_path):
    text = "\n".join(f"{i} {i * i}" for i in range(200000))
    (tmp_path / "t").write_text(text)
    try:
        subprocess.run(["xz", "-k", "--block-size=200000", str(tmp_path / "t")], check=True, timeout=60)
    except (FileNotFoundError, subprocess.CalledProcessError):
        pytest.skip("no xz program")
    r = A.ArchiveReader({"path": str(tmp_path / "t.xz"), "partition_bytes": "60000"})
    assert len(r.partitions()) > 5
    assert reading(tmp_path / "t.xz", 60000) == text.split("\n")


def test_in_spark(spark, tmp_path):
    text = "\n".join(["h1\th2", *(f"{i}\t{i % 7 or ''}" for i in range(5000))])
    data = text.encode()
    pieces = [data[:20000], data[20000:]]
    (tmp_path / "two.gz").write_bytes(b"".join(gzip.compress(p) for p in pieces))
    df = A.archive_lines(spark, str(tmp_path / "two.gz"), 4000)
    assert df.select("part").distinct().count() == 2 <= df.rdd.getNumPartitions()
    assert held(df) == text.split("\n")
    assert A.header_of(df) == ["h1", "h2"]
    t = A.table_lines(df, A.header_of(df))
    assert t.count() == 5000 and t.where("h2 is null").count() == sum(i % 7 == 0 for i in range(5000))


@pytest.mark.parametrize("made", [lambda: gzip.compress(b"a\nb\n" * 999)[:-5], lambda: lzma.compress(b"a\n" * 999)[:-5], lambda: gzip.compress(b"a\n") + b"junk"])
def test_broken_files(tmp_path, made):
    (tmp_path / "x").write_bytes(made())
    with pytest.raises((EOFError, ValueError)):
        reading(tmp_path / "x", 1 << 20)


def test_no_files(spark, tmp_path):
    assert A.archive_lines(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        reading(tmp_path / "none", 10)


def test_replay(spark):
    rec = "run string, ord int, method string, url string, body string"
    cassette = spark.createDataFrame([("r", 1, "GET", "https://h.org/a?x=1&y=2", "one"), ("r", 2, "GET", "https://H.org:443/a?y=2&x=1#f", "two"), ("r", 3, "POST", "http://h.org", "p"), ("s", 1, "GET", "https://h.org/a?x=1&y=2", "other")], rec)
    asked = spark.createDataFrame([("r", 5, "get", "https://h.org/a?y=2&x=1"), ("r", 6, "GET", "https://u@h.org/a?x=1&y=2"), ("r", 7, "GET", "https://h.org/a?x=1&y=2"), ("r", 8, "POST", "http://h.org/"), ("r", 9, "GET", None)], "run string, ord int, method string, url string")
    got = {r.ord: (r.response_body, r.finding) for r in A.replayed(asked, cassette).collect()}
    assert got == {5: ("one", "served"), 6: ("two", "served"), 7: (None, "refused"), 8: ("p", "served"), 9: (None, "refused")}
    runs = spark.createDataFrame([("r",), ("t",)], "run string")
    assert [r.run for r in A.empty_recordings(runs, cassette).collect()] == ["t"]
