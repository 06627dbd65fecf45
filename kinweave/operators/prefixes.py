"""Prefix orders and matches of haplotypes, block of markers by block of markers.

The order of haplotypes by their reversed prefixes seems to need marker after marker in one stream. But what a
block of markers does to it depends on the block alone: haplotypes fall into classes of equal alleles in the block, in an
order of their own, and the order after the block is the one before it, sorted stably by class. The divergence (one past
the marker where a haplotype last differs from the one ranked before it) is the block's between classes,
and within a class the greatest divergence passed over in the order before the block.

1. Each block finds its classes and their divergences, all blocks at once.
2. A scan combines them, one small step a block, and gives the order in which each block begins. It reads
   no genotypes, and is one stream for each (chromosome, interleave).
3. Each block goes through its markers from there, all blocks at once, and emits orders or matches.

So tasks grow with the markers, and a task holds one block of genotypes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import haploblocks
from kinweave.plans.storage import Scratch

SEGMENT = "chrom string, hap1 long, hap2 long, start_pos long, end_pos long"
ORDER = "chrom string, m long, rank long, hap long, divergence long"
_CLASSES = "chrom string, j long, b long, class binary, since binary"
_PLACES = ("m", "pos", "cm", "next_pos", "next_cm")
_STATE = "chrom string, j long, b long, state binary"


def _advanced(order: np.ndarray, div: np.ndarray, alleles: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and divergences after marker ``m``: a stable sort by allele; a divergence is the running maximum since the
    allele last occurred."""
    own = alleles[order]
    orders, divs = [], []
    for x in np.unique(own):
        where = np.flatnonzero(own == x)
        since = np.concatenate(([0], where[:-1] + 1))
        top = np.maximum.reduceat(np.append(div, 0), np.stack((since, where + 1), 1).ravel())[::2]
        top[0] = m + 1
        orders.append(order[where])
        divs.append(top)
    return np.concatenate(orders), np.concatenate(divs)


def _range_maxima(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The greatest of ``x[first:last + 1]`` for each pair, by maxima over powers of two."""
    level = np.floor(np.log2(last - first + 1)).astype(np.int64)
    out, table = np.empty(len(first), x.dtype), x
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.maximum(table[first[own]], table[last[own] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.maximum(table[: -(1 << k)], table[1 << k :])
    return out


def _combined(order: np.ndarray, div: np.ndarray, kind: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and divergences after a block whose classes are ``kind`` (by haplotype), with divergences ``since`` between classes."""
    own = kind[order]
    at = np.argsort(own, kind="stable")
    first = np.append(True, own[at][1:] != own[at][:-1])
    out = since[own[at]]
    inner = np.flatnonzero(~first)
    out[inner] = _range_maxima(div, at[inner - 1] + 1, at[inner])
    return order[at], out


def _classes(group: pa.Table) -> pa.Table:
    group = group.sort_by("m")
    rows = haploblocks.genotypes(group)
    order, div = np.arange(len(rows[0])), np.full(len(rows[0]), -1)
    for m, row in zip(group["m"].to_pylist(), rows, strict=True):
        order, div = _advanced(order, div, row, m)
    fresh = div >= 0
    fresh[0] = True
    kind = np.empty(len(order), np.int32)
    kind[order] = np.cumsum(fresh) - 1
    out = {c: pa.array([group[c][0].as_py()], kind_) for c, kind_ in (("chrom", pa.string()), ("j", pa.int64()), ("b", pa.int64()))}
    return pa.table(out | {"class": pa.array([kind.tobytes()], pa.binary()), "since": pa.array([div[fresh].tobytes()], pa.binary())})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block begins: order, divergences, their positions and centimorgans; and where the marker
    after each of its own is."""
    key, order, div = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks, places = [], []  # divergences that there can be so far, ascending, and where they are
    for batch in batches:
        for chrom, j, b, kind, since, places_ in zip(*(batch.column(c).to_pylist() for c in ("chrom", "j", "b", "class", "since", "places")), strict=True):
            kind, since = np.frombuffer(kind, np.int32), np.frombuffer(since, np.int64)
            m, pos, cm, next_pos, next_cm = (np.array([x[c] for x in places_], np.float64) for c in _PLACES)
            if key != (chrom, j):
                key, order, div = (chrom, j), np.arange(len(kind)), np.full(len(kind), j)
                marks, places = [np.array([j], np.int64)], [np.array([[pos[0]], [cm[0]]])]
            known, where = np.concatenate(marks), np.concatenate(places, 1)
            where = where[:, np.minimum(np.searchsorted(known, div), len(known) - 1)]
            state = np.concatenate((order.astype(np.float64), div.astype(np.float64), where.ravel(), next_pos, next_cm)).tobytes()
            yield pa.RecordBatch.from_pydict({"chrom": [chrom], "j": [j], "b": [b], "state": pa.array([state], pa.binary())})
            order, div = _combined(order, div, kind, since)
            marks.append(m.astype(np.int64) + 1)
            places.append(np.stack((next_pos, next_cm)))
            if len(marks) > 64:
                marks, places = [np.concatenate(marks)], [np.concatenate(places, 1)]


def _walk(emit: Callable[..., pa.RecordBatch]):
    """Goes through the markers of a block from the state in which it begins, and emits after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by([("ahead", "ascending"), ("m", "ascending")])
        state = next(x for x in held["state"].to_pylist() if x is not None)
        held = held.filter(pa.compute.is_valid(held["row"]))
        chrom, rows = held["chrom"][0].as_py(), haploblocks.genotypes(held)
        own = held.num_rows - sum(held["ahead"].to_pylist())
        n = len(rows[0])
        state = np.frombuffer(state, np.float64)
        order, div, pos, cm = state[: 4 * n].reshape(4, -1)
        order, div = order.astype(np.int64), div.astype(np.int64)
        marks, first = np.unique(div, return_index=True)
        places = np.stack((pos[first], cm[first]))
        m = held["m"].to_pylist()
        here, ahead = np.stack([held[c].to_numpy().astype(np.float64) for c in ("pos", "cm")]), state[4 * n :].reshape(2, -1)
        marks = np.concatenate((marks[marks <= m[0]], np.array(m[:own]) + 1))
        places = np.concatenate((places[:, : len(marks) - own], ahead), 1)
        for k in range(own):
            order, div = _advanced(order, div, rows[k], m[k])
            yield emit(chrom, n, m[k], here[:, k], order, div, marks, places, rows[k + 1] if k + 1 < len(rows) else None)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    typed.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return typed


def walked(markers: DataFrame, step: int, emit: Callable[..., pa.RecordBatch], schema: str, block: int | None = None) -> DataFrame:
    """``emit`` over all markers (chrom, m, pos, cm, alleles), ``block`` markers of an interleave in a task."""
    scratch = Scratch(markers.sparkSession)
    first = markers.select(F.size("alleles").alias("n")).first()
    block = block or haploblocks.width_for(first["n"] if first else 1)
    rows = scratch.keep(haploblocks.packed(markers.select("chrom", "m", F.col("pos").cast("long").alias("pos"), F.col("cm").cast("double").alias("cm"), "alleles")), "rows")
    own = rows.withColumn("j", F.col("m") % step).withColumn("b", F.floor(F.col("m") / (step * block)).cast("long")).withColumn("ahead", F.lit(False))
    by = Window.partitionBy("chrom").orderBy("m")
    after = own.select("chrom", "m", "pos", "cm", F.coalesce(F.lead("pos").over(by), "pos").alias("next_pos"), F.coalesce(F.lead("cm").over(by), "cm").alias("next_cm"), "j", "b")  # coordinates only
    after = after.groupBy("chrom", "j", "b").agg(F.sort_array(F.collect_list(F.struct(*_PLACES))).alias("places"))  # a block each
    classes = own.groupBy("chrom", "j", "b").applyInArrow(_classes, _CLASSES).join(after, ["chrom", "j", "b"])
    scan = classes.repartition("chrom", "j").sortWithinPartitions("chrom", "j", "b").mapInArrow(_scan, _STATE)
    states = scratch.keep(scan, "states")
    # the first marker of a block is also what the last one of the block before it looks ahead to; m of a block may be missing, so
    # which block that is comes from the blocks that there are
    before = states.select("chrom", "j", "b", F.lag("b").over(Window.partitionBy("chrom", "j").orderBy("b")).alias("back")).where("back is not null")
    heads = own.groupBy("chrom", "j", "b").agg(F.min("m").alias("m")).join(before, ["chrom", "j", "b"]).select("chrom", "m", "back")
    heads = own.join(heads, ["chrom", "m"]).withColumn("b", F.col("back")).withColumn("ahead", F.lit(True)).select(*own.columns)
    none = F.lit(None)
    named = states.select("chrom", none.cast("long").alias("m"), none.cast("long").alias("pos"), none.cast("double").alias("cm"), none.cast("binary").alias("row"), "j", "b", F.lit(False).alias("ahead"), "state")
    every = own.unionByName(heads).withColumn("state", none.cast("binary")).unionByName(named)
    return every.groupBy("chrom", "j", "b").applyInArrow(_walk(emit), schema)


def prefix_order_streamed(markers: DataFrame, step: int = 1, block: int | None = None) -> DataFrame:
    """(chrom, m, rank, hap, divergence) as the relational prefix order has them, ``hap`` the place in ``alleles``, from one row per
    marker (chrom, m, alleles) for chromosomes of any length."""

    def emit(chrom, n, m, here, order, div, marks, places, ahead) -> pa.RecordBatch:
        one = np.zeros(n, np.int64)
        return pa.RecordBatch.from_pydict({"chrom": pa.array([chrom]).take(pa.array(one)), "m": one + m, "rank": np.arange(n), "hap": order, "divergence": div})

    rows = markers.select("chrom", "m", F.col("m").alias("pos"), F.col("m").alias("cm"), "alleles")
    return walked(rows, step, emit, ORDER, block)


def match_segments_streamed(markers: DataFrame, min_cm: float, step: int = 1, block: int | None = None) -> DataFrame:
    """Maximal matches of at least ``min_cm`` between neighbours of the prefix order, from one row per marker (chrom, m, pos, cm, alleles)
    for panels of any length."""

    def emit(chrom, n, m, here, order, div, marks, places, ahead) -> pa.RecordBatch:
        begin, cm = places[:, np.minimum(np.searchsorted(marks, div[1:]), len(marks) - 1)]
        ok = (div[1:] <= m) & (cm <= here[1] - min_cm)
        if ahead is not None:
            ok &= ahead[order[1:]] != ahead[order[:-1]]
        one, two = order[1:][ok], order[:-1][ok]
        row = np.zeros(len(one), np.int64)
        return pa.RecordBatch.from_pydict({"chrom": pa.array([chrom]).take(pa.array(row)), "hap1": np.minimum(one, two), "hap2": np.maximum(one, two), "start_pos": begin[ok].astype(np.int64), "end_pos": row + int(here[0])})

    return walked(markers, step, emit, SEGMENT, block)


def backward_order(markers: DataFrame, last: int, step: int = 1) -> DataFrame:
    """``prefix_order_streamed`` from the other end of the chromosome, whose last marker is ``last``."""
    order = prefix_order_streamed(markers.withColumn("m", F.lit(last) - F.col("m")), step)
    return order.withColumn("m", F.lit(last) - F.col("m")).withColumn("divergence", F.lit(last) - F.col("divergence"))
