"""Genotypes in blocks of markers, and pairs of haplotypes that are compared where they meet a block.

A block is a window of consecutive markers, one packed row of alleles each. What asks for a comparison (a
segment, a drawn pair) is a narrow row that names a block. Rows of a block are dealt to slices of bounded number, and each slice
is grouped with the block's genotypes, so neither a busy block nor a whole chromosome is ever held by a task:
its memory is one block and one slice. What runs past a block asks for the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.storage import Scratch

#: Bytes of a block's genotypes; rows of a slice, and their markers if each has a value for every marker of the block.
BLOCK_BYTES, SLICE, CELLS = 16 << 20, 1 << 16, 1 << 23


def width_for(n_haps: int) -> int:
    """Markers of a block: 64 at least, and no more than ``BLOCK_BYTES`` beyond that."""
    return max(64, min(4096, BLOCK_BYTES // max(n_haps, 1) // 64 * 64))


def packed_alleles(lists: pa.Array) -> pa.Array:
    """Alleles of each row as bytes: one byte an allele, or two where a row has numbers beyond 255 (an odd length tells)."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        row = values[a:b]
        out.append(b"\x01" + row.astype(np.uint8).tobytes() if row.max(initial=0) < 256 else b"\x02" + row.astype("<u2").tobytes())
    return pa.array(out, pa.binary())


def alleles_of(row: bytes) -> np.ndarray:
    """The alleles that ``packed_alleles`` has packed."""
    return np.frombuffer(row, np.uint8 if row[0] == 1 else np.dtype("<u2"), offset=1)


def packed(markers: DataFrame, alleles: str = "alleles") -> DataFrame:
    """``markers`` with the array ``alleles`` packed as ``row``."""
    kept = [c for c in markers.columns if c != alleles]
    kinds = ", ".join(f"`{c}` {markers.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), packed_alleles(some.column(alleles))], [*kept, "row"])

    return markers.select(*kept, alleles).mapInArrow(run, f"{kinds}, row binary")


def blocks(markers: DataFrame, width: int) -> DataFrame:
    """Packed rows with ``w``, the number of their block, by ``m``."""
    return packed(markers).withColumn("w", F.floor(F.col("m") / width).cast("long"))


def extents(rows: DataFrame) -> DataFrame:
    """(chrom, w, low): the first position of each block."""
    return rows.groupBy("chrom", "w").agg(F.min("pos").alias("low"))


def block_of(rows: DataFrame, at: str, low: DataFrame, out: str = "w") -> DataFrame:
    """Adds the block in which each position ``at`` lies: the last one that begins at or before it, else the first.

    Blocks are laid out over bins of positions, as wide as a block is on average, so this is an equi-join.
    """
    ends = low.groupBy("chrom").agg(F.min("low").alias("_first"), F.max("low").alias("_last"), F.greatest((F.max("low") - F.min("low")) / F.count("*"), F.lit(1.0)).alias("_bin"))
    ahead = F.lead("low").over(Window.partitionBy("chrom").orderBy("w"))
    spans = low.withColumn("_next", F.coalesce(ahead, F.col("low") + 1)).join(F.broadcast(ends), "chrom")
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("low") / F.col("_bin")), F.floor((F.col("_next") - 1) / F.col("_bin")))))
    spans = spans.select("chrom", "_b", "low", "_next", F.col("w").alias(out))
    placed = rows.join(F.broadcast(ends), "chrom").withColumn("_at", F.least(F.greatest(at, "_first"), "_last")).withColumn("_b", F.floor(F.col("_at") / F.col("_bin")))
    found = placed.join(spans, ["chrom", "_b"]).where((F.col("low") <= F.col("_at")) & (F.col("_at") < F.col("_next")))
    return found.select(*rows.columns, out)


def over_blocks(rows: DataFrame, asked: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, scratch: Scratch, slice_rows: int = SLICE) -> DataFrame:
    """``run(rows of a block in order of m, asked rows)`` for each slice of ``asked`` (chrom, w, ...) and its block of ``rows``
    (chrom, w, m, row, ...). Rows that ask for a block that there is not are left out."""
    asked = scratch.keep(asked, "asked")
    slices = scratch.keep(asked.groupBy("chrom", "w").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("_n")), "slices")
    left = rows.join(slices, ["chrom", "w"]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    right = asked.join(slices, ["chrom", "w"]).withColumn("_slice", F.pmod(F.xxhash64(*asked.columns), F.col("_n")).cast("int"))
    key = ["chrom", "w", "_slice"]
    none = _nothing(schema)

    def meet(own: pa.Table, wants: pa.Table) -> pa.Table:
        if not own.num_rows or not wants.num_rows:
            return none
        return run(own.sort_by("m"), wants)

    return left.drop("_n").groupBy(*key).cogroup(right.drop("_n").groupBy(*key)).applyInArrow(meet, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _nothing(schema: str) -> pa.Table:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in schema.split(", "))]).empty_table()


def genotypes(own: pa.Table) -> list[np.ndarray]:
    """The alleles of each row of a block."""
    return [alleles_of(x) for x in own["row"].to_pylist()]


def differing(own: pa.Table, hap1: np.ndarray, hap2: np.ndarray) -> np.ndarray:
    """Whether each pair of haplotypes differs at each marker of a block: pairs by markers."""
    out = np.empty((len(hap1), own.num_rows), bool)
    for k, row in enumerate(genotypes(own)):
        np.not_equal(row[hap1], row[hap2], out=out[:, k])
    return out


def pair_bits(rows: DataFrame, asked: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """``asked`` (chrom, w, hap1, hap2, ...) with ``bits``: at which markers of block ``w`` the pair differs, a bit each."""
    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString().replace('bigint', 'long')}" for c in asked.columns)

    def run(own: pa.Table, wants: pa.Table) -> pa.Table:
        apart = np.packbits(differing(own, wants["hap1"].to_numpy(), wants["hap2"].to_numpy()), axis=1)
        return wants.select(asked_columns).append_column("bits", pa.array([x.tobytes() for x in apart], pa.binary()))

    asked_columns = asked.columns
    return over_blocks(rows, asked, run, f"{kinds}, bits binary", scratch, max(64, CELLS // width))


def discord_counts(rows: DataFrame, segments: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(discord, checked) for each slice of segments (chrom, hap1, hap2, start_pos, end_pos; haplotypes by place in the rows)
    that meet a block: markers inside the segments at which the two haplotypes differ, and all of them."""

    def run(own: pa.Table, wants: pa.Table) -> pa.Table:
        pos = own["pos"].to_numpy()
        low, high = np.searchsorted(pos, wants["start_pos"].to_numpy()), np.searchsorted(pos, wants["end_pos"].to_numpy(), side="right")
        apart = np.zeros((wants.num_rows, own.num_rows + 1), np.int32)
        np.cumsum(differing(own, wants["hap1"].to_numpy(), wants["hap2"].to_numpy()), axis=1, out=apart[:, 1:])
        each = np.arange(len(low))
        high = np.maximum(low, high)
        return pa.table({"discord": [int((apart[each, high] - apart[each, low]).sum())], "checked": [int((high - low).sum())]})

    low = extents(rows)
    asked = block_of(block_of(segments, "start_pos", low, "_w0"), "end_pos", low, "_w1")
    asked = asked.withColumn("w", F.explode(F.sequence("_w0", "_w1"))).select("chrom", "w", "hap1", "hap2", "start_pos", "end_pos")
    return over_blocks(rows, asked, run, "discord long, checked long", scratch, max(64, CELLS // width))
