"""Binary reference panels (bref, version 3): a reader of the blocks that a file's index names, and a writer of one file per chromosome."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.config import Interval
from kinweave.sources.located import files_of, opened, reachable

# fixed values of the format
MAGIC = 2055763188
END = -999999999999999
PERMUTATIONS = list(itertools.permutations("ACGT"))
SCHEMA = "chrom string, pos int, id string, ref string, alt string, n_alleles int, alleles array<int>"


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str) -> tuple:
        values = struct.unpack_from(">" + kind, self.data, self.at)
        self.at += struct.calcsize(">" + kind)
        return values

    def one(self, kind: str) -> int:
        return self.take(kind)[0]

    def utf(self) -> str:
        size = self.one("H")
        self.at += size
        return self.data[self.at - size : self.at].decode()

    def strings(self) -> list[str]:
        return [self.utf() for _ in range(self.one("i"))]


def sample_ids(data: bytes) -> list[str]:
    """Sample ids of a file's header."""
    b = _Bytes(data)
    if b.one("i") != MAGIC:
        raise ValueError("not a bref file of version 3")
    b.utf()
    return b.strings()


def _kept(names: list[str], exclude: frozenset[str]) -> list[int]:
    kept = [h for i, name in enumerate(names) if name not in exclude for h in (2 * i, 2 * i + 1)]
    if not kept:
        raise ValueError("all samples are excluded")
    return kept


def decode(data: bytes, exclude: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """(chrom, pos, id, ref, alt, n_alleles, alleles) of every record, without both haplotypes of excluded samples."""
    kept = _kept(sample_ids(data), exclude)
    b = _Bytes(data)
    b.one("i")
    b.utf()
    yield from _records(b, 2 * len(b.strings()), kept)


def decode_block(data: bytes, haps: int, kept: list[int]) -> Iterator[tuple]:
    """The records of one block's bytes."""
    yield from _records(_Bytes(data + bytes(4)), haps, kept)


def _records(b: _Bytes, haps: int, kept: list[int]) -> Iterator[tuple]:
    while n := b.one("i"):
        chrom = b.utf()
        n_seq = b.one("H")
        seq = b.take(f"{haps}H")
        for _ in range(n):
            pos = b.one("i")
            ids = [b.utf() for _ in range(b.one("B"))]
            code = b.one("b")
            if code == -1:
                alleles = b.strings()
                b.one("i")
            else:
                alleles = list(PERMUTATIONS[code >> 2][: 1 + (code & 3)])
            if b.one("b") == 0:
                of = b.take(f"{n_seq}B")
                row = [of[s] for s in seq]
            else:
                carried = [b.take(f"{size}i") if (size := b.one("i")) >= 0 else None for _ in alleles]
                row = [next(k for k, c in enumerate(carried) if c is None)] * haps
                for k, c in enumerate(carried):
                    for h in c or ():
                        row[h] = k
            yield chrom, pos, ";".join(ids) or ".", alleles[0], ",".join(alleles[1:]) or ".", len(alleles), row if len(kept) == haps else [row[h] for h in kept]


def encode(chrom: str, samples: list[str], records: list[tuple], per_block: int = 1 << 30) -> bytes:
    """One chromosome, allele-coded blocks of at most ``per_block`` (pos, id, ref, alt, alleles) records in order, and their index."""

    def utf(x: str) -> bytes:
        raw = x.encode()
        return struct.pack(">H", len(raw)) + raw

    def strings(xs: list[str]) -> bytes:
        return struct.pack(">i", len(xs)) + b"".join(map(utf, xs))

    out = [struct.pack(">i", MAGIC), utf("kinweave"), strings(samples)]
    size, blocks = sum(map(len, out)), []
    for k, (pos, name, ref, alt, row) in enumerate(records):
        if k % per_block == 0:
            size += sum(map(len, out[blocks[-1][2] :])) if blocks else 0
            blocks.append((size if blocks else -size, pos, len(out)))  # the first of a chromosome is marked by its sign
            out += [struct.pack(">i", min(per_block, len(records) - k)), utf(chrom), struct.pack(">H", 1), bytes(4 * len(samples))]
        ids = [] if name == "." else name.split(";")[:255]
        out.append(struct.pack(">iB", pos, len(ids)) + b"".join(map(utf, ids)))
        alleles = [ref, *([] if alt == "." else alt.split(","))]
        out.append(struct.pack(">b", -1) + strings(alleles) + struct.pack(">ib", -1, 1))
        major = max(range(len(alleles)), key=lambda k: (row.count(k), -k))
        for k in range(len(alleles)):
            haps = [h for h, a in enumerate(row) if a == k]
            out.append(struct.pack(">i", -1) if k == major else struct.pack(f">i{len(haps)}i", len(haps), *haps))
    index = sum(map(len, out)) + 4
    out += [struct.pack(">i", 0), strings([chrom]), struct.pack(">i", records[0][0]), *(struct.pack(">qi", offset, pos) for offset, pos, _ in blocks), struct.pack(">qq", END, index)]
    return b"".join(out)


def bref_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample ids of the files under ``path``, which must agree."""
    files = files_of(spark, path)
    if not reachable(files[0][0]):

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"names": pa.array([sample_ids(x) for x in batch.column("content").to_pylist()], pa.list_(pa.string()))})

        found = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 26).alias("content")).mapInArrow(read, "names array<string>")
        heads = {tuple(r["names"]) for r in found.distinct().take(2)}
    else:
        heads = {tuple(_header(name)[0]) for name, _ in files}
    if len(heads) != 1:
        raise ValueError(f"{path}: no files, or files of different samples")
    return list(heads.pop())


def _header(path: str) -> tuple[list[str], int]:
    """(sample ids, bytes of the header) of a file, of which no more is read than that, doubling."""
    size = 1 << 20
    with opened(path) as file:
        while True:
            file.seek(0)
            b = _Bytes(file.read(size))
            try:
                return sample_ids(b.data), _after_header(b)
            except (struct.error, IndexError):
                if len(b.data) < size:
                    raise ValueError(f"{path}: the header ends early") from None
                size *= 2


def _after_header(b: _Bytes) -> int:
    b.at = 0
    b.one("i")
    b.utf()
    b.strings()
    if b.at > len(b.data):
        raise IndexError
    return b.at


def index_of(path: str, size: int) -> list[tuple[str, int, int, int, int]]:
    """(chrom, first position, first position of the chromosome's next block or the largest number, first byte, last byte) of each block, from
    the index at the end of a file."""
    with opened(path) as file:
        file.seek(size - 16)
        end, at = struct.unpack(">qq", file.read(16))
        if end != END:
            raise ValueError(f"{path}: no index of blocks")
        file.seek(at)
        b = _Bytes(file.read(size - at))
    chroms = b.strings()
    b.take(f"{len(chroms)}i")
    blocks, chrom = [], -1
    while (offset := b.one("q")) != END:
        chrom += offset < 0
        blocks.append((chroms[chrom], b.one("i"), abs(offset)))
    ends = [*(x[2] for x in blocks[1:]), at - 4]
    after = [y[1] if y and y[0] == x[0] else 1 << 62 for x, y in zip(blocks, [*blocks[1:], None], strict=True)]
    return [(chrom, pos, later, a, e) for (chrom, pos, a), later, e in zip(blocks, after, ends, strict=True)]


def blocks_of(spark: SparkSession, path: str, interval: Interval | None = None) -> list[tuple]:
    """(path, first byte, last byte, haplotypes) of the blocks of all files that may hold records of the interval."""
    out = []
    for name, size in files_of(spark, path):
        haps = 2 * len(_header(name)[0])
        for chrom, pos, later, a, e in index_of(name, size):
            if interval is None or (chrom == interval.chrom and pos <= interval.end and later >= interval.start):
                out.append((name, a, e, haps))
    return out


def read_bref(spark: SparkSession, path: str, exclude_samples: set[str] | None = None, interval: Interval | None = None) -> DataFrame:
    """One row per marker of all files under ``path`` (of ``interval``, if given); QUAL, FILTER and INFO are not in the format.

    Blocks are read one by one where the index of their file says, by as many tasks as there are; with an interval only the blocks that may
    hold some of it. Where tasks can't reach the files themselves, Spark's reader takes them whole.
    """
    exclude = frozenset(exclude_samples or ())
    names = bref_samples(spark, path)
    if reachable(files_of(spark, path)[0][0]):
        blocks, kept = blocks_of(spark, path, interval), _kept(names, exclude)

        def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns = [x.split()[0] for x in SCHEMA.split(", ")]
            for frame in frames:
                for name, a, e, haps in frame.itertuples(index=False):
                    with opened(name) as file:
                        file.seek(a)
                        records = decode_block(file.read(e - a), haps, kept)
                    while part := list(itertools.islice(records, 1000)):
                        yield pd.DataFrame(part, columns=columns)

        table = spark.createDataFrame(blocks, "path string, first long, last long, haps int").repartition(max(1, min(len(blocks), 4096)))
        rows = table.mapInPandas(some, SCHEMA)
        return rows if interval is None else rows.where((F.col("chrom") == interval.chrom) & F.col("pos").between(interval.start, interval.end))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                records = decode(content, exclude)
                while part := list(itertools.islice(records, 1000)):
                    yield pd.DataFrame(part, columns=names)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)
    return rows if interval is None else rows.where((F.col("chrom") == interval.chrom) & F.col("pos").between(interval.start, interval.end))


def encoded_bref(markers: DataFrame, samples: list[str], per_file: int = 50_000, per_block: int = 2000) -> DataFrame:
    """(chrom, part, content): files of at most ``per_file`` markers each, made where their markers are."""
    rows = markers.select("chrom", "pos", "id", "ref", "alt", "alleles", F.floor(F.col("m") / per_file).cast("int").alias("part"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pos", "ref", "alt"])
        records = [(int(r.pos), r.id, r.ref, r.alt, list(map(int, r.alleles))) for r in frame.itertuples(index=False)]
        first = frame.iloc[0]
        return pd.DataFrame({"chrom": [first.chrom], "part": [int(first.part)], "content": [encode(first.chrom, samples, records, per_block)]})

    return rows.groupBy("chrom", "part").applyInPandas(run, "chrom string, part int, content binary")


def decoded_bref(files: DataFrame) -> DataFrame:
    """Markers of a table of file contents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(list(decode(content)), columns=names)

    return files.select("content").mapInPandas(run, SCHEMA)
