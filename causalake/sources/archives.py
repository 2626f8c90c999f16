"""Lines of gzip, xz and plain files as a Spark data source whose partitions are planned inside the files.

An xz file is cut between its blocks, which its own index tells; a gzip file between its members; a plain file anywhere. Formats
are told by the first bytes. Every line comes whole and once: a partition leaves its first, begun line to the one before
it, which reads on into the next member or block until that line ends. No partition holds more than one line and one chunk.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't import this package

GZIP, XZ = b"\x1f\x8b", b"\xfd7zXZ\x00"
CHUNK = 1 << 20
BATCH = 10_000
NAME = "archive_lines"


@dataclass
class Span(InputPartition):
    """Units of one file that start in [start, end); of an xz file the header of their stream is at `header`.

    `then` holds the (header, offset) of later xz blocks, for the line that the last own block leaves open.
    """

    path: str
    kind: str
    number: int
    start: int
    end: int
    blocks: tuple = ()
    then: tuple = ()

    def __post_init__(self) -> None:
        self.value = self.number


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.Directory:
        held = [x for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
    else:
        held = [found]
    return sorted((scheme + x.path, x.size) for x in held)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer of an xz index, and the place after it."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def xz_blocks(f, size: int) -> list[tuple[int, int, int]]:
    """(offset of the stream's header, offset, length) of every block, by the indexes alone, which are read from the file's end."""
    out, end = [], size
    while end > 0:
        foot = f.read_at(12, end - 12) if end >= 12 else b""
        if foot[-4:] == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        if foot[-2:] != b"YZ":
            raise ValueError("not a whole xz file")
        length = (int.from_bytes(foot[4:8], "little") + 1) * 4
        index = f.read_at(length, end - 12 - length)
        n, at = _number(index, 1)
        sizes = []
        for _ in range(n):
            unpadded, at = _number(index, at)
            _, at = _number(index, at)
            sizes.append((unpadded + 3) // 4 * 4)
        header = end - 12 - length - sum(sizes) - 12
        if f.read_at(6, header) != XZ:
            raise ValueError("not a whole xz file")
        offset, blocks = header + 12, []
        for s in sizes:
            blocks.append((header, offset, s))
            offset += s
        out, end = blocks + out, header
    return out


def _inflated(f, start: int) -> Iterator[tuple[bytes, int]]:
    """Chunks of one gzip member and, with the last, the offset after it (else 0)."""
    d, at = zlib.decompressobj(31), start
    while not d.eof:
        data = d.unconsumed_tail
        if not data:
            data = f.read_at(CHUNK, at)
            at += len(data)
            if not data:
                raise EOFError(f"the gzip member at {start} is cut off")
        text = d.decompress(data, CHUNK)
        if not d.eof and text:
            yield text, 0
    yield text, at - len(d.unused_data)


def _after(f, at: int, size: int) -> int:
    """The next member's offset: zeros after a member are padding."""
    while at < size:
        data = f.read_at(CHUNK, at)
        rest = data.lstrip(b"\0")
        if rest:
            return at + len(data) - len(rest)
        at += len(data)
    return size


def _is_member(f, at: int, size: int) -> bool:
    """A whole member starts here: it inflates to its end with the right check sum, and a member or the file's end follows."""
    try:
        end = 0
        for _, end in _inflated(f, at):  # noqa: B007
            pass
    except (zlib.error, EOFError):
        return False
    end = _after(f, end, size)
    return end >= size or f.read_at(2, end) == GZIP


def first_member(f, start: int, end: int, size: int) -> int | None:
    """The first gzip member that starts in [start, end)."""
    if start == 0:
        return 0
    at = start
    while at < end:
        data = f.read_at(min(CHUNK, end - at) + 3, at)
        found = data.find(GZIP + b"\x08")
        while found >= 0:
            if at + found < end and data[found + 3 : found + 4] < b"\x20" and _is_member(f, at + found, size):
                return at + found
            found = data.find(GZIP + b"\x08", found + 1)
        at += CHUNK
    return None


def _members(f, span: Span) -> Iterator[tuple[bool, bytes]]:
    size = f.size()
    at = first_member(f, span.start, span.end, size)
    while at is not None and at < size:
        own, end = at < span.end, 0
        for text, end in _inflated(f, at):
            yield own, text
        at = _after(f, end, size)
        if at < size and f.read_at(2, at) != GZIP:
            raise ValueError(f"no gzip member at {at}")


def _blocks(f, span: Span) -> Iterator[tuple[bool, bytes]]:
    """Each block is told to the decoder as the first of a stream of its own, so none before it is read."""
    import lzma

    for own, blocks in ((True, span.blocks), (False, span.then)):
        for header, offset, length in blocks:
            d, at = lzma.LZMADecompressor(lzma.FORMAT_XZ), offset
            d.decompress(f.read_at(12, header))
            while at < offset + length or not d.needs_input:
                data = b""
                if d.needs_input:
                    data = f.read_at(min(CHUNK, offset + length - at), at)
                    at += len(data)
                    if not data:
                        raise EOFError(f"the xz block at {offset} is cut off")
                yield own, d.decompress(data, CHUNK)


def _plain(f, span: Span) -> Iterator[tuple[bool, bytes]]:
    at, size = span.start, f.size()
    while at < size:
        stop = span.end if at < span.end else size
        data = f.read_at(min(CHUNK, stop - at), at)
        yield at < span.end, data
        at += len(data)


def whole_lines(chunks: Iterator[tuple[bool, bytes]], first: bool) -> Iterator[bytes]:
    """The lines of a partition from (own, bytes): after its first line break, or its start, to the first break beyond it."""
    skip, rest = not first, []
    for own, data in chunks:
        if skip:
            if not own:
                return
            cut = data.find(b"\n")
            if cut < 0:
                continue
            data, skip = data[cut + 1 :], False
        if not own:
            cut = data.find(b"\n")
            if cut >= 0:
                yield b"".join([*rest, data[:cut]])
                return
            rest.append(data)
            continue
        pieces = data.split(b"\n")
        if len(pieces) > 1:
            yield b"".join([*rest, pieces[0]])
            yield from pieces[1:-1]
            rest = []
        rest.append(pieces[-1])
    last = b"".join(rest)
    if last and not skip:
        yield last


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("partition_bytes", 64 << 20))
        if self.bytes < 1:
            raise ValueError("partition_bytes must be positive")

    def partitions(self) -> list[Span]:
        """Only file sizes, first bytes and xz indexes are read here."""
        out = []
        for path, size in _files(self.path):
            if not size:
                continue
            with _opened(path) as f:
                start = f.read_at(6, 0)
                if start == XZ:
                    blocks, groups, held = xz_blocks(f, size), [], 0
                    for b in blocks:
                        if not groups or held + b[2] > self.bytes:
                            groups.append([])
                            held = 0
                        groups[-1].append(b)
                        held += b[2]
                    done = 0
                    for i, g in enumerate(groups):
                        done += len(g)
                        out.append(Span(path, "xz", i, 0, 0, tuple(g), tuple(blocks[done:])))
                    continue
            kind = "gzip" if start[:2] == GZIP else "plain"
            out += [Span(path, kind, i, a, min(a + self.bytes, size)) for i, a in enumerate(range(0, size, self.bytes))]
        return out or [Span("", "none", 0, 0, 0)]

    def read(self, partition: Span) -> Iterator:
        """Arrow batches of some thousands of lines, or of one chunk's bytes."""
        import pyarrow as pa

        def batch(first: int, held: list[bytes]) -> pa.RecordBatch:
            n = len(held)
            columns = [pa.array([partition.path] * n), pa.array([partition.number] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array([x.removesuffix(b"\r").decode() for x in held], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "part", "ord", "line"])

        if partition.kind == "none":
            return
        chunks = {"xz": _blocks, "gzip": _members, "plain": _plain}[partition.kind]
        with _opened(partition.path) as f:
            first, held, size = 0, [], 0
            for line in whole_lines(chunks(f, partition), partition.number == 0):
                held.append(line)
                size += len(line)
                if len(held) >= BATCH or size >= CHUNK:
                    yield batch(first, held)
                    first, held, size = first + len(held), [], 0
            if held:
                yield batch(first, held)


class ArchiveSource(DataSource):
    """Options: path (a file or folder, of any file system that pyarrow opens), partition_bytes (compressed bytes, 64 MB)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, part int, ord long, line string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_lines(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """path, part, ord, line of every line, in file order by (path, part, ord). Line ends are `\\n` or `\\r\\n`; text is UTF-8.

    A gzip file of one member is one partition's work, as its format has no other way; empty files have no lines. A
    partition trusts a member's start that it finds inside its bytes when the whole member inflates with the right check sum and another
    or the file's end follows: gzip files stored unpacked inside a member would pass too.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(NAME).option("path", path).option("partition_bytes", str(partition_bytes)).load()


def table_lines(lines: DataFrame, columns: list[str], sep: str = "\t", header: bool = True) -> DataFrame:
    """Lines as columns of text, by place; missing ones are null, empty ones too. The first line of each file is left out as its header."""
    rows = lines.where((F.col("part") != 0) | (F.col("ord") != 0)) if header else lines
    cells = F.split("line", f"\\Q{sep}\\E", -1)
    return rows.select("path", *(F.nullif(F.get(cells, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))


def header_of(lines: DataFrame, sep: str = "\t") -> list[str]:
    """Column names: the first line of the first file; files with another one are refused."""
    heads = [x.line for x in lines.where("part = 0 and ord = 0").select("line").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError("the files have no header, or different ones")
    return heads[0].split(sep)


def request_key(method, url) -> Column:
    """What a recorded request is found by: method, scheme, host, port, path and the sorted query; 64 hex digits of SHA-256.

    Scheme and host fold case, a missing port is the scheme's own, a missing path is `/`; a fragment, user or null doesn't count.
    """
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), "^.*@", "")
    host = F.lower(F.regexp_replace(authority, ":[0-9]*$", ""))
    port = F.regexp_extract(authority, ":([0-9]+)$", 1)
    port = F.when(port != "", port).when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")
    path = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, "^[^?#]*\\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    m = F.upper(F.coalesce(F.col(method) if isinstance(method, str) else method, F.lit("")))
    return F.sha2(F.concat_ws("\n", m, scheme, host, port, F.when(path == "", "/").otherwise(path), query), 256)


def replayed(requests: DataFrame, cassette: DataFrame) -> DataFrame:
    """requests (run, ord, method, url and others) with response columns of the cassette and `finding`: served or refused.

    cassette: run, ord, method, url, and any columns of the response. Equal requests of a run are served in the order they were
    recorded, each response once; a request beyond them is refused (nothing is fetched). A run's recordings and requests meet by key and turn.
    """
    turn = F.row_number().over(Window.partitionBy("run", "_key").orderBy("ord"))
    held = [c for c in cassette.columns if c not in ("run", "ord", "method", "url")]
    kept = cassette.withColumn("_key", request_key("method", "url")).withColumn("_turn", turn)
    kept = kept.select("run", "_key", "_turn", *(F.col(c).alias(f"response_{c}") for c in held), F.lit("served").alias("finding"))
    asked = requests.withColumn("_key", request_key("method", "url")).withColumn("_turn", turn)
    out = asked.join(kept, ["run", "_key", "_turn"], "left").withColumn("finding", F.coalesce("finding", F.lit("refused")))
    return out.select(*requests.columns, F.col("_key").alias("request_key"), *(f"response_{c}" for c in held), "finding")


def empty_recordings(runs: DataFrame, cassette: DataFrame) -> DataFrame:
    """run of runs that recorded nothing: their traffic didn't pass the recorder."""
    return runs.select("run").distinct().join(cassette.select("run").distinct(), "run", "left_anti")
