"""Identical-by-state segments: positional prefix ordering, emission, merging, stabbing, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import haploblocks
from kinweave.operators.components import connected_components, least_reachable
from kinweave.operators.prefixes import backward_order, match_segments_streamed, prefix_order_streamed  # noqa: F401  the same results by blocks
from kinweave.plans.storage import Scratch

#: Haplotypes whose names a broadcast may hold, 64 MB.
NAMED = 8_000_000


def prefix_order(panel: DataFrame, step: int = 1) -> DataFrame:
    """Haplotypes at each marker by their reversed prefixes within the interleaved marker subset.

    Columns: chrom, m, rank, hap, allele, next (allele at m + step, null at the end), prev (haplotype ranked
    before), prev_next, divergence (one past the last subset marker where it differs from ``prev``).
    """
    hap = panel.withColumn("j", F.col("m") % step).groupBy("chrom", "j", "hap").agg(F.sort_array(F.collect_list(F.struct("m", "allele"))).alias("row"))
    rows = hap.select("chrom", "j", "hap", F.col("row.m").alias("ms"), F.col("row.allele").alias("as"), F.posexplode("row.m").alias("i", "m"))
    rows = rows.select("chrom", "j", "m", "hap", F.get("as", F.col("i")).alias("allele"), F.get("as", F.col("i") + 1).alias("next"), F.reverse(F.slice("as", F.lit(1), F.col("i") + 1)).alias("prefix"))
    by = Window.partitionBy("chrom", "j", "m").orderBy("prefix", "hap")
    rows = rows.select("*", (F.row_number().over(by) - 1).alias("rank"), F.lag("hap").over(by).alias("prev"), F.lag("next").over(by).alias("prev_next"), F.lag("prefix").over(by).alias("before"))
    at = F.array_position(F.zip_with("prefix", "before", lambda a, b: a != b), True)
    divergence = F.when(F.col("prev").isNull(), F.col("m") + 1).when(at == 0, F.col("j")).otherwise(F.col("m") - step * (at - 1) + 1)
    return rows.select("chrom", "m", "rank", "hap", "allele", "next", "prev", "prev_next", divergence.cast("long").alias("divergence"))


def match_segments(panel: DataFrame, coords: DataFrame, min_cm: float, step: int = 1) -> DataFrame:
    """Maximal matches of at least ``min_cm`` between neighbours of the prefix order (coords: chrom, m, pos, cm)."""
    order = prefix_order(panel, step).where("prev is not null")
    end = coords.select("chrom", "m", F.col("pos").alias("end_pos"), F.col("cm").alias("end_cm"))
    start = coords.select("chrom", F.col("m").alias("divergence"), F.col("pos").alias("start_pos"), F.col("cm").alias("start_cm"))
    ends_here = F.col("next").isNull() | (F.col("next") != F.col("prev_next"))
    rows = order.where(ends_here).join(end, ["chrom", "m"]).join(start, ["chrom", "divergence"]).where(F.col("start_cm") <= F.col("end_cm") - min_cm)
    return rows.select("chrom", F.least("hap", "prev").cast("long").alias("hap1"), F.greatest("hap", "prev").cast("long").alias("hap2"), F.col("start_pos").cast("long"), F.col("end_pos").cast("long"))


def merged(segments: DataFrame, keys: list[str] | None = None, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Joins a segment with the one before it (by start, end) if that ends at or after its start.

    Only the immediately preceding row counts, not the furthest end so far.
    """
    keys = keys or ["chrom", "hap1", "hap2"]
    by = Window.partitionBy(*keys).orderBy(start, end)
    fresh = F.when(F.col(start) <= F.lag(end).over(by), 0).otherwise(1)
    rows = segments.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(by))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def output_grid(first_cm: float, last_cm: float, out_cm: float) -> list[tuple[int, float]]:
    """(step, centimorgans) of the output positions; the upper end is not covered."""
    delta = 0.01 * float(np.float32(out_cm))
    return [(k, 100 * k * delta) for k in range(int(np.ceil(first_cm * 0.01 / delta)), int(np.ceil(last_cm * 0.01 / delta)))]


def stab(points: DataFrame, segments: DataFrame, width: int, keys: list[str] | None = None, at: str = "pos", start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Points inside closed segments: an equi-join on buckets of ``width`` and a range condition."""
    keys = keys or ["chrom"]
    spread = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    found = points.withColumn("_b", F.floor(F.col(at) / width)).join(spread, [*keys, "_b"])
    return found.where(F.col(at).between(F.col(start), F.col(end))).drop("_b")


def stab_sums(points: DataFrame, segments: DataFrame, width: int, sums: list[str], keys: list[str] | None = None, at: str = "pos", start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Points inside closed segments with ``n``, how many these are, and the sums of their whole numbers ``sums``.

    No pair of a point and a segment is made, so work grows with points and segments and not with how many segments lie over each other:
    starts add to running sums and ends take away again, inside ranges of ``width`` on top of the sums of the ranges before.
    """
    keys = keys or ["chrom"]
    given = points.columns
    points = points.where(" and ".join(f"`{c}` is not null" for c in [*keys, at])).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*given).alias("_point"))
    parts = {"_n": F.lit(1)} | {f"_s{i}": F.coalesce(F.col(c).cast("long"), F.lit(0)) for i, c in enumerate(sums)} | {f"_c{i}": F.col(c).isNotNull().cast("int") for i, c in enumerate(sums)}
    values = segments.where(F.col(start) <= F.col(end)).where(" and ".join(f"`{c}` is not null" for c in keys)).select(*keys, start, end, *(v.cast("long").alias(k) for k, v in parts.items()))

    def edges(place: str, kind: int, sign: int) -> DataFrame:
        return values.select(*keys, F.col(place).alias("_at"), F.lit(kind).alias("_kind"), *((sign * F.col(k)).alias(k) for k in parts))

    rows = points.unionByName(edges(start, 0, 1), allowMissingColumns=True).unionByName(edges(end, 2, -1), allowMissingColumns=True)
    rows = rows.withColumn("_r", F.floor(F.col("_at") / width))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_r").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in parts))
    carried = carried.select(*keys, "_r", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in parts))  # ranges only
    so_far = Window.partitionBy(*keys, "_r").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "_r", "_kind", "_point", *(F.coalesce(F.sum(k).over(so_far), F.lit(0)).alias(k) for k in parts)).where("_kind = 1")
    rows = rows.join(carried, [*keys, "_r"]).select("_point", *((F.col(k) + F.col(f"{k}_before")).alias(k) for k in parts)).where("_n > 0")
    return rows.select("_point.*", F.col("_n").alias("n"), *(F.when(F.col(f"_c{i}") > 0, F.col(f"_s{i}")).alias(c) for i, c in enumerate(sums)))


def clusters_by_rounds(points: DataFrame, segments: DataFrame, haps: DataFrame, width: int = 100_000) -> DataFrame:
    """``clusters`` by joins and star rounds alone, for haplotypes too many to number in a task."""
    linked = stab(points.select("chrom", "pos").distinct(), segments, width)

    def node(hap: str):
        return F.struct("chrom", "pos", F.col(hap).cast("long").alias("hap"))

    parts = connected_components(linked.select(node("hap1").alias("u"), node("hap2").alias("v")))
    found = parts.select("node.chrom", "node.pos", "node.hap", F.col("component.hap").alias("root"))
    # every haplotype at every output position is the result itself: positions times haplotypes
    every = points.select("chrom", "pos").distinct().join(haps.select(F.col("hap").cast("long")).distinct())
    rows = every.join(found, ["chrom", "pos", "hap"], "left").withColumn("root", F.coalesce("root", "hap"))
    label = F.dense_rank().over(Window.partitionBy("chrom", "pos").orderBy("root")) - 1
    return rows.select("chrom", "pos", "hap", label.cast("long").alias("cluster"))


_LINKS = "chrom string, w long, hap1 long, hap2 long, a int, b int, at array<long>"
_CLUSTERS = "chrom string, pos long, hap long, cluster long"


def _lasting(group: pa.Table) -> pa.Table:
    """Links of a slice of a window: those that last through all of it as a forest, others unless that forest joins their ends."""
    ends = np.stack([group["hap1"].to_numpy(), group["hap2"].to_numpy()])
    a, b, last = (group[c].to_numpy() for c in ("a", "b", "last"))
    names, place = np.unique(ends, return_inverse=True)
    u, v = place.reshape(2, -1)
    whole = (a == 0) & (b == last)
    root = least_reachable(u[whole], v[whole], len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    kept = np.flatnonzero(~whole & (root[u] != root[v]))
    rows = len(moved) + len(kept)
    fixed = {c: pa.array([group[c][0].as_py() if group.num_rows else None] * rows, kind) for c, kind in (("chrom", pa.string()), ("w", pa.int64()))}
    columns = {"hap1": np.append(names[root[moved]], ends[0][kept]), "hap2": np.append(names[moved], ends[1][kept]), "a": np.append(np.zeros(len(moved), np.int32), a[kept].astype(np.int32)), "b": np.append(np.full(len(moved), last[0] if len(last) else 0, np.int32), b[kept].astype(np.int32))}
    return pa.table({**fixed, **columns, "at": pa.nulls(rows, pa.list_(pa.int64()))})


def _labels(names):
    """The clusters at each position of a window, a position at a time; ``names`` are the haplotypes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        chrom = held["chrom"][0].as_py()
        at = next(x for x in held["at"].to_pylist() if x is not None)
        links = held.filter(pc.is_null(held["at"]))
        ends = np.stack([links["hap1"].to_numpy(), links["hap2"].to_numpy()])
        a, b = links["a"].to_numpy(), links["b"].to_numpy()
        known = names.value
        every = np.union1d(known, ends.ravel()) if ends.size else known
        own = np.searchsorted(every, known)
        u, v = np.searchsorted(every, ends)
        whole = (a == 0) & (b == len(at) - 1)
        base = least_reachable(u[whole], v[whole], len(every))
        u, v, a, b = base[u[~whole]], base[v[~whole]], a[~whole], b[~whole]
        before, label = None, None
        for k, pos in enumerate(at):
            now = np.flatnonzero((a <= k) & (k <= b))
            if before is None or not np.array_equal(now, before):  # a step with the links of the one before has its labels
                root = least_reachable(u[now], v[now], len(every))[base]
                label, before = np.unique(root[own], return_inverse=True)[1], now
            yield pa.RecordBatch.from_pydict({"chrom": pa.array([chrom]).take(pa.array(np.zeros(len(known), np.int64))), "pos": np.full(len(known), pos), "hap": known, "cluster": label.astype(np.int64)})

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    typed.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return typed


def clusters(points: DataFrame, segments: DataFrame, haps: DataFrame, width: int = 100_000, window: int = 500, slice_rows: int = 1 << 20) -> DataFrame:
    """(chrom, pos, hap, cluster): haplotypes joined by segments over each position, labelled in order of first member.

    Positions go in windows of ``window``. A segment is one row for each window that it touches, with the first and last position of it
    that it covers; a window's union-find starts from what lasts through all of it and adds the rest position by
    position, and its labels leave the task one position at a time. Windows with more than ``slice_rows`` segments are contracted
    slice by slice first. Beyond ``NAMED`` haplotypes the same comes from ``clusters_by_rounds`` with bins of ``width``.
    """
    spark = segments.sparkSession
    scratch = Scratch(spark)
    known = scratch.keep(haps.select(F.col("hap").cast("long").alias("hap")).where("hap is not null").distinct(), "haps")
    if known.limit(NAMED + 1).count() > NAMED:
        return clusters_by_rounds(points, segments, known, width)
    names = spark.sparkContext.broadcast(np.sort(known.toPandas()["hap"].to_numpy(np.int64)))  # NAMED numbers at most
    place = F.row_number().over(Window.partitionBy("chrom").orderBy("pos")) - 1
    numbered = points.select("chrom", F.col("pos").cast("long").alias("pos")).where("chrom is not null and pos is not null").distinct()
    numbered = numbered.withColumn("w", F.floor(place / window).cast("long"))  # output positions only
    windows = scratch.keep(numbered.groupBy("chrom", "w").agg(F.sort_array(F.collect_list("pos")).alias("at"), F.min("pos").alias("low")), "windows")

    open_ = segments.select("chrom", F.col("hap1").cast("long").alias("hap1"), F.col("hap2").cast("long").alias("hap2"), F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos")).where("hap1 <> hap2")
    low = windows.select("chrom", "w", "low")
    open_ = haploblocks.block_of(haploblocks.block_of(open_, "start_pos", low, "_w0"), "end_pos", low, "_w1").withColumn("w", F.explode(F.sequence("_w0", "_w1"))).join(windows, ["chrom", "w"])
    a = F.aggregate("at", F.lit(0), lambda n, x: n + (x < F.col("start_pos")).cast("int"))
    b = F.aggregate("at", F.lit(-1), lambda n, x: n + (x <= F.col("end_pos")).cast("int"))
    inside = open_.select("chrom", "w", "hap1", "hap2", a.alias("a"), b.alias("b"), (F.size("at") - 1).alias("last")).where("a <= b")
    inside = scratch.keep(inside, "inside")
    slices = inside.groupBy("chrom", "w").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("n"))
    slices = scratch.keep(slices, "slices")
    links = inside.join(slices.where("n = 1"), ["chrom", "w"]).select("chrom", "w", "hap1", "hap2", "a", "b", F.lit(None).cast("array<long>").alias("at"))
    if slices.where("n > 1").limit(1).count():
        busy = inside.join(slices.where("n > 1"), ["chrom", "w"]).withColumn("slice", F.pmod(F.xxhash64("hap1", "hap2", "a"), F.col("n")))
        links = links.unionByName(busy.groupBy("chrom", "w", "slice").applyInArrow(_lasting, _LINKS))
    none = F.lit(None).cast("long")
    ask = windows.select("chrom", "w", none.alias("hap1"), none.alias("hap2"), none.cast("int").alias("a"), none.cast("int").alias("b"), "at")
    return ask.unionByName(links).groupBy("chrom", "w").applyInArrow(_labels(names), _CLUSTERS)


def discordance(segments: DataFrame, markers: DataFrame, width: int | None = None) -> DataFrame:
    """(discord, checked, rate): alleles of both haplotypes (by place in ``alleles``) at the markers inside each segment.

    Segments meet packed blocks of ``width`` of the ``markers`` (chrom, m, pos, alleles), a row for each block that they touch, and each
    slice of a block gives one pair of sums.
    """
    scratch = Scratch(markers.sparkSession)
    if not width:
        width = haploblocks.width_for(markers.agg(F.max(F.size("alleles"))).first()[0] or 1)
    rows = scratch.keep(haploblocks.blocks(markers.select("chrom", "m", "pos", "alleles"), width), "blocks")
    counts = haploblocks.discord_counts(rows, scratch.keep(segments, "segments"), width, scratch)
    sums = counts.agg(F.coalesce(F.sum("discord"), F.lit(0)).alias("discord"), F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"))
    return sums.withColumn("rate", F.when(F.col("checked") > 0, F.col("discord") / F.col("checked")))
