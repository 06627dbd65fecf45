"""Lines of text files with their places, read by byte ranges: plain text, BGZF, and one-stream gzip.

A partition is a range of a file's bytes. Of plain text it reads the lines that begin in its range; of BGZF those that
begin in the blocks that do. Block starts are not listed anywhere, so a partition looks for the first one from its start on, and
takes it only if it has a block's header, inflates to its length and check sum, and another block or the file's end follows.
A partition gives the lines that begin after its first byte and up to the first byte of the next one's, and reads on to where the
last of these ends; so a line across any number of boundaries is read once. Gzip without blocks is one partition
a file, inflated as a stream.

``at`` orders a file's lines: the byte at which a line begins, for BGZF the block's start times 65536 and the byte inside the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, number int, at long, value string"
#: Bytes of a partition, of a read, and rows of a batch.
SPLIT, READ, BATCH = 32 << 20, 1 << 20, 4096
GZIP, MORE = b"\x1f\x8b\x08", 4  # a member's first bytes, and the flag of extra fields
LONGEST = 1 << 16  # of a BGZF block


def opened(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        files, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return files.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files that a path or pattern names, in order of names."""
    found = []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(at) or ():
        for own in files.listStatus(status.getPath()) if status.isDirectory() else (status,):
            name = own.getPath().getName()
            if own.isFile() and not name.startswith(("_", ".")):
                found.append((own.getPath().toString(), own.getLen()))
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def block_size(head: bytes) -> int | None:
    """Bytes of the BGZF block that begins with ``head`` (18 bytes or more), None if none does."""
    if len(head) < 18 or head[:3] != GZIP or not head[3] & MORE:
        return None
    extra, at = int.from_bytes(head[10:12], "little"), 12
    while at + 4 <= min(12 + extra, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def inflated(block: bytes) -> bytes | None:
    """The text of a BGZF block, None if it is not a whole and sound one."""
    try:
        text = zlib.decompress(block[12 + int.from_bytes(block[10:12], "little") : -8], -15)
    except zlib.error:
        return None
    return text if zlib.crc32(text) == int.from_bytes(block[-8:-4], "little") and len(text) == int.from_bytes(block[-4:], "little") else None


class _Window:
    """Bytes of a file by absolute place, a piece of it in memory."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place < self.start or place + n > self.start + len(self.data):
            self.file.seek(place)
            self.start, self.data = place, self.file.read(max(n, READ))
        return self.data[place - self.start : place - self.start + n]


def first_block(w: _Window, start: int) -> int:
    """Where the first BGZF block from ``start`` on begins; the file's size if none does."""
    place = start
    while place < w.size:
        piece = w.at(place, min(LONGEST, w.size - place))
        found = piece.find(GZIP)
        if found < 0:
            place += max(1, len(piece) - len(GZIP) + 1)
            continue
        place += found
        size = block_size(w.at(place, min(64, w.size - place)))
        if size and place + size <= w.size and inflated(w.at(place, size)) is not None:
            after = place + size
            if after == w.size or block_size(w.at(after, min(64, w.size - after))):
                return place
        place += 1
    return w.size


def _pieces_bgzf(w: _Window, place: int) -> Iterator[tuple[int, bytes]]:
    while place < w.size:
        size = block_size(w.at(place, min(64, w.size - place)))
        text = inflated(w.at(place, size)) if size and place + size <= w.size else None
        if text is None:
            raise ValueError(f"bad block at byte {place}")
        yield place << 16, text
        place += size


def _pieces_plain(w: _Window, place: int) -> Iterator[tuple[int, bytes]]:
    while place < w.size:
        text = w.at(place, min(READ, w.size - place))
        yield place, text
        place += len(text)


def _pieces_gzip(w: _Window, place: int) -> Iterator[tuple[int, bytes]]:
    """One or more gzip members as a stream, in bounded pieces."""
    out, state = 0, zlib.decompressobj(31)
    while place < w.size:
        rest = w.at(place, min(READ, w.size - place))
        place += len(rest)
        while rest:
            text = state.decompress(rest, READ)
            if text:
                yield out, text
                out += len(text)
            rest = state.unconsumed_tail
            if state.eof:
                rest, state = state.unused_data, zlib.decompressobj(31)
    if state.unconsumed_tail or not state.eof and out == 0 and w.size:
        raise ValueError("gzip stream ends early")


def lines_between(pieces: Iterator[tuple[int, bytes]], first: bool, end: int) -> Iterator[tuple[int, bytes]]:
    """(at, line) of the lines that begin after the first byte of ``pieces`` (at it too if ``first``), up to ``end``."""
    begin: int | None = None  # where the open line began; None: its beginning is not ours
    held: list[bytes] = []
    fresh = first  # the next byte begins a line
    for place, text in pieces:
        at = 0
        while at < len(text):
            if fresh:
                begin, fresh = place + at, False
                if begin > end:
                    return
            stop = text.find(b"\n", at)
            if begin is not None:
                held.append(text[at:] if stop < 0 else text[at:stop])
            elif place > end:  # nothing but the middle of a line that is not ours
                return
            if stop < 0:
                break
            if begin is not None:
                yield begin, b"".join(held)
                held = []
            begin, fresh, at = None, True, stop + 1
    if begin is not None:
        yield begin, b"".join(held)


@dataclass
class Range(InputPartition):
    path: str
    number: int
    size: int
    kind: str
    start: int
    end: int


class LocatedLines(DataSource):
    """``spark.read.format("kinweave-lines")`` with the options ``files`` (uri and size, a line each) and ``split``."""

    @classmethod
    def name(cls) -> str:
        return "kinweave-lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.files = [(p, int(n)) for p, n in (x.rsplit("\t", 1) for x in options["files"].splitlines())]
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        out = []
        for number, (path, size) in enumerate(self.files):
            with opened(path) as file:
                head = file.read(64)
            kind = "plain" if head[:3] != GZIP else "bgzf" if block_size(head) else "gzip"
            split = max(size, 1) if kind == "gzip" else self.split
            out += [Range(path, number, size, kind, a, min(a + split, size)) for a in range(0, size, split)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as file:
            w = _Window(file, part.size)
            if part.kind == "bgzf":
                start, end = first_block(w, part.start) if part.start else 0, first_block(w, part.end) if part.end < part.size else part.size
                if start >= part.end:
                    return  # no block begins here
                found = lines_between(_pieces_bgzf(w, start), not part.start, end << 16)
            elif part.kind == "gzip":
                found = lines_between(_pieces_gzip(w, 0), True, 1 << 62)
            else:
                found = lines_between(_pieces_plain(w, part.start), not part.start, part.end if part.end < part.size else 1 << 62)
            at, value, size = [], [], 0
            for place, line in found:
                at.append(place)
                value.append(line[:-1] if line.endswith(b"\r") else line)
                size += len(line)
                if len(at) >= BATCH or size >= READ:
                    yield self._batch(part, at, value)
                    at, value, size = [], [], 0
            if at:
                yield self._batch(part, at, value)

    @staticmethod
    def _batch(part: Range, at: list[int], value: list[bytes]) -> pa.RecordBatch:
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([part.number] * n, pa.int32()), pa.array(at, pa.int64()), pa.array([x.decode() for x in value], pa.string())], ["file", "number", "at", "value"])


def reachable(path: str) -> bool:
    """Whether tasks can open this file without Spark's own readers."""
    try:
        opened(path).close()
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False
    return True


def located_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame | None:
    """(file, number, at, value) of the lines of all files under ``path``, or None where only Spark's readers reach them."""
    files = files_of(spark, path)
    if not reachable(files[0][0]):
        return None
    spark.dataSource.register(LocatedLines)
    return spark.read.format("kinweave-lines").option("files", "\n".join(f"{p}\t{n}" for p, n in files)).option("split", str(split)).load()
