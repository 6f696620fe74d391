"""FASTA as a data source: files cut into byte ranges, read in parallel, as a table or as a stream.

A record belongs to the range in which its header line starts; its task reads on into the next range as far as the
record goes. A range's first line is the affair of the range before it, which also takes a line that starts where the
next range does. Block-compressed gzip files (those whose members state their size) are cut as plain files are: a task
looks for the first member that starts in its range. Other gzip files are one range each.

    spark.dataSource.register(FastaSource)
    spark.read.format("fasta_ranges").load(path)
    spark.readStream.format("fasta_ranges").load(folder)

Files are opened through Arrow's file systems, on the executors; ``path`` is a file, a folder or a pattern of names."""

from __future__ import annotations

import fnmatch
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, id string, seq string"
_MEMBER = b"\x1f\x8b\x08\x04"
_CHUNK = 1 << 22
_ROWS = 1000
_VALUES = 1 << 24
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space, as Spark's patterns have it
_STRIP = re.compile(f"^[{_WHITE}]+|[{_WHITE}]+$")
_NAME = re.compile(f"^>[{_WHITE}]*([^{_WHITE}]+)")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    kind: str


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> dict[str, int]:
    """The sizes of the files that ``path`` names, by path; names that start with '_' or '.' are left out."""
    parts = path.split("/")
    fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    head, patterns = "/".join(parts[:fixed]), parts[fixed:]
    system, inner = open_path(head)
    found = system.get_file_info(inner)
    if not patterns and found.type == fs.FileType.File:
        return {path: found.size}
    if not patterns and found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=len(patterns) > 1))
    names = [i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    if patterns:
        below = {i.path: PurePosixPath(i.path).relative_to(inner).parts for i in names}
        names = [i for i in names if len(below[i.path]) == len(patterns) and all(map(fnmatch.fnmatchcase, below[i.path], patterns))]
    if "://" not in head:
        return {i.path: i.size for i in names}
    before = head.rstrip("/").removesuffix(quote(inner.rstrip("/"))).removesuffix(inner.rstrip("/"))
    return {before + quote(i.path): i.size for i in names}


def _member_size(head: bytes) -> int | None:
    """The size of the gzip member that starts with ``head``, if it states it."""
    if not head.startswith(_MEMBER) or len(head) < 18:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def kind_of(path: str) -> str:
    """'plain', 'gzip', or 'blocks' for a gzip file whose members state their size."""
    system, inner = open_path(path)
    with system.open_input_file(inner) as f:
        head = f.read(512)
    return "plain" if not head.startswith(b"\x1f\x8b") else "gzip" if _member_size(head) is None else "blocks"


def plan_ranges(files: dict[str, int], range_bytes: int) -> list[ByteRange]:
    out = []
    for path, size in sorted(files.items()):
        kind = kind_of(path) if size else "plain"
        step = max(size, 1) if kind == "gzip" else range_bytes
        out += [ByteRange(path, a, min(a + step, size), kind) for a in range(0, size, step)]
    return out


def _first_member(f, start: int) -> int | None:
    """Where the first member from ``start`` on begins: one that inflates to what its checksum says."""
    f.seek(start)
    window, base = f.read(1 << 18), start
    while window:
        at = window.find(_MEMBER)
        while at >= 0:
            if len(window) - at < 1 << 17:  # a member has 65,536 bytes at most
                window, base, at = window[at:] + f.read(1 << 18), base + at, 0
            size = _member_size(window[at : at + 512])
            if size is not None:
                try:
                    zlib.decompress(window[at : at + size], 31)
                    return base + at
                except zlib.error:
                    pass
            at = window.find(_MEMBER, at + 1)
        keep = min(3, len(window))
        more = f.read(1 << 18)
        if not more:
            return None
        base, window = base + len(window) - keep, window[len(window) - keep :] + more
    return None


def _chunks(f, part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) from the range's start to the end of the file. In block-compressed files an offset is the member's,
    times 65,536, plus the place in it."""
    if part.kind == "blocks":
        at = _first_member(f, part.start)
        while at is not None:
            f.seek(at)
            head = f.read(1 << 16)
            size = _member_size(head[:512])
            if size is None:
                if head:
                    raise ValueError(f"a member of {part.path} does not state its size, at byte {at}")
                return
            data = zlib.decompress(head[:size], 31)
            if data:
                yield at << 16, data
            at += size
    elif part.kind == "gzip":
        at, inflate = 0, zlib.decompressobj(31)
        while True:
            raw = inflate.unused_data or f.read(1 << 20)
            if not raw:
                if not inflate.eof:
                    raise ValueError(f"{part.path} ends within its compressed data")
                return
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            data = inflate.decompress(raw)
            if data:
                yield at, data
            at += len(data)
    else:
        f.seek(part.start)
        at = part.start
        while data := f.read(_CHUNK):
            yield at, data
            at += len(data)


def _lines(chunks: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(offset of its first byte, line); lines end as in Spark's text reader."""
    start, held = 0, []
    for base, data in chunks:
        if held and held[-1].endswith(b"\r") and not data.startswith(b"\n"):
            yield start, b"".join(held)
            held = []
        at = 0
        for line in data.splitlines(keepends=True):
            if not held:
                start = base + at
            at += len(line)
            held.append(line)
            if line.endswith(b"\n") or (line.endswith(b"\r") and at < len(data)):
                yield start, b"".join(held)
                held = []
    if held:
        yield start, b"".join(held)


def _plain(line: bytes) -> str:
    """Stripped text."""
    if line.isascii():
        return line.strip(b"\t\n\x0b\x0c\r ").decode()
    return _STRIP.sub("", line.decode("utf-8", "replace"))


def read_range(part: ByteRange, strict: bool = True) -> Iterator[tuple[int, str | None, str]]:
    """(offset, id, seq) of the records that start in ``part``, by the rules of ``fasta.read_fasta``. One record at a time is
    in memory."""
    system, inner = open_path(part.path)
    with system.open_input_file(inner) as f:
        limit = None if part.kind != "plain" else part.end

        def chunks() -> Iterator[tuple[int, bytes]]:
            nonlocal limit
            for base, data in _chunks(f, part):
                if limit is None and part.kind == "blocks" and base >> 16 >= part.end:
                    limit = base  # where the next range starts, if it has any bytes
                yield base, data

        lines = _lines(chunks())
        if part.start:
            next(lines, None)
        offset, name, body = None, None, []
        for start, raw in lines:
            if start == 0 and raw.startswith(b"\xef\xbb\xbf"):
                raw = raw[3:]
            inside = limit is None or start <= limit
            line = _plain(raw)
            if line.startswith(">"):
                if offset is not None:
                    yield offset, name, "".join(body)
                    offset = None
                if not inside:
                    return
                found = _NAME.match(line)
                if found is None and strict:
                    raise ValueError(f"a header without an id in {part.path}")
                offset, name, body = start, found and found[1], []
            elif offset is None:
                if not inside:
                    return
            elif line:
                body.append(line.upper())
        if offset is not None:
            yield offset, name, "".join(body)


def _batches(part: ByteRange, strict: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("id", pa.string()), ("seq", pa.string())])

    def batch() -> pa.RecordBatch:
        offsets, names, seqs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), pa.array(offsets, pa.int64()), pa.array(names, pa.string()), pa.array(seqs, pa.string())], schema=schema)

    for row in read_range(part, strict):
        rows.append(row)
        held += len(row[2])
        if len(rows) >= _ROWS or held >= _VALUES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


class FastaSource(DataSource):
    """(path, offset, id, seq), ordered in each file by offset. Options: ``range_bytes`` (default 64 MB), ``mode`` as in
    ``fasta.read_fasta``."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Options:
    def __init__(self, options) -> None:
        mode = options.get("mode", "FAILFAST")
        if mode not in ("FAILFAST", "PERMISSIVE"):
            raise ValueError(f"unknown mode {mode!r}")
        self.path, self.strict = options["path"], mode == "FAILFAST"
        self.range_bytes = int(options.get("range_bytes", 1 << 26))


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> list[ByteRange]:
        # no file, no range: one empty range, since a source without partitions would be read as one
        return plan_ranges(list_files(self.path), self.range_bytes) or [ByteRange("", 0, 0, "none")]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.kind == "none" else _batches(partition, self.strict)


class _Stream(_Options, DataSourceStreamReader):
    """An offset names the files read so far and their sizes. A file is read once, whole, when it is first seen; one that has
    changed its size since is an error, as its records would be read twice or not at all."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return list_files(self.path)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        for path in start.keys() & end.keys():
            if start[path] != end[path]:
                raise ValueError(f"{path} has changed since it was read")
        return plan_ranges({p: n for p, n in end.items() if p not in start}, self.range_bytes)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.strict)


def read_ranges(spark, path: str, mode: str = "FAILFAST", range_bytes: int = 1 << 26):
    """(path, offset, id, seq) of all records, as a table."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta_ranges").option("mode", mode).option("range_bytes", range_bytes).load(path)


def stream_ranges(spark, path: str, mode: str = "FAILFAST", range_bytes: int = 1 << 26):
    """The same as a stream: the records of each new file, once."""
    spark.dataSource.register(FastaSource)
    return spark.readStream.format("fasta_ranges").option("mode", mode).option("range_bytes", range_bytes).load(path)
