"""Allele statistics and filters of a long genotype panel (chrom, m, pos, hap, allele)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.genetics import min_mac
from kinweave.plans.config import Interval

MARKER = ["chrom", "m", "pos"]


def allele_counts(panel: DataFrame) -> DataFrame:
    """Called haplotypes per allele; missing alleles don't count."""
    return panel.where("allele is not null").groupBy(*MARKER, "allele").agg(F.count("*").alias("n"))


def allele_frequencies(panel: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("chrom", "m"))
    return allele_counts(panel).select(*MARKER, "allele", "n", (F.col("n") / total).alias("freq"))


def major_alleles(panel: DataFrame) -> DataFrame:
    """The commonest allele, the lowest of equals."""
    best = F.max_by("allele", F.struct("n", -F.col("allele")))
    return allele_counts(panel).groupBy(*MARKER).agg(best.alias("major"))


def minor_counts(panel: DataFrame) -> DataFrame:
    """Second largest allele count of each marker; 0 if only one allele occurs."""
    counts = allele_counts(panel).groupBy(*MARKER).agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    return counts.select(*MARKER, F.coalesce(F.get("ns", F.lit(1)), F.lit(0)).alias("mac"))


def common_markers(panel: DataFrame, min_maf: float, n_haps: int) -> DataFrame:
    return minor_counts(panel).where(F.col("mac") >= min_mac(min_maf, n_haps))


def without_samples(panel: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drops both haplotypes of excluded samples (column ``sample``) and numbers the others anew from 0."""
    kept = panel.withColumn("sample", F.floor(F.col("hap") / 2).cast("int")).join(excluded.select(F.col("sample").cast("int")).distinct(), "sample", "left_anti")
    return kept.join(numbered(kept.select("sample").distinct(), "sample", "new"), "sample").select(*MARKER, (2 * F.col("new") + F.col("hap") % 2).alias("hap"), "allele")


def numbered(rows: DataFrame, by: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Rows numbered from 0 in the order of the whole numbers ``by``: inside ranges of ``by``, on top of the counts of the
    ranges before, so only counts are ever in one place."""
    rows = rows.withColumn("_r", F.floor(F.col(by) / width))
    before = Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_r").agg(F.count("*").alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn(out, F.row_number().over(Window.partitionBy("_r").orderBy(by)) - 1)
    return inside.join(counts, "_r").withColumn(out, F.col(out) + F.col("_before")).drop("_r", "_before")


def number_markers(rows: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Adds ``m``, the number of each marker on its chromosome by (pos, ref, alt): rows are ordered inside ranges of
    ``width`` bases, on top of the counts of the ranges before."""
    rows = rows.withColumn("_r", F.floor(F.col("pos") / width))
    before = Window.partitionBy("chrom").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("chrom", "_r").agg(F.count("*").alias("_n")).select("chrom", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn("m", F.row_number().over(Window.partitionBy("chrom", "_r").orderBy("pos", "ref", "alt")) - 1)
    return inside.join(counts, ["chrom", "_r"]).withColumn("m", (F.col("m") + F.col("_before")).cast("long")).drop("_r", "_before")


def included(markers: DataFrame, include: DataFrame | None, exclude: DataFrame | None) -> DataFrame:
    """Markers with a name in ``include`` (all, without a list) and none in ``exclude``."""
    kept = markers if include is None else named_markers(markers, include, False)
    return kept if exclude is None else named_markers(kept, exclude, True)


def some_in_interval(rows: DataFrame, interval: Interval) -> DataFrame:
    """``in_interval``; an interval without rows is an error."""
    found = in_interval(rows, interval)
    if not found.limit(1).count():
        raise ValueError(f"no records in {interval}")
    return found


def restricted(rows: DataFrame, first: int | None = None, last: int | None = None, only: list[int] | None = None) -> DataFrame:
    """Markers from number ``first`` up to ``last`` (not included), or those of a list."""
    rows = rows if first is None else rows.where((F.col("m") >= first) & (F.col("m") < last))
    return rows if only is None else rows.where(F.col("m").isin(only))


def running_totals(markers: DataFrame) -> DataFrame:
    """Alleles, genotypes and bits of a haplotype before each marker (chrom, m, n_alleles)."""
    n = F.col("n_alleles")
    bits = F.when(n > 1, F.length(F.bin((n - 1).cast("long")))).otherwise(0)
    before = Window.partitionBy("chrom").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"alleles_before": n, "genotypes_before": (n * (n + 1) / 2).cast("long"), "bits_before": bits}
    return markers.select("chrom", "m", *(F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long").alias(k) for k, x in sums.items()))


def common(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """(on, i, j): what two lists (``on`` with its place ``i``) have in common, with both places; the order is that of ``i``."""
    return first.select(on, "i").join(second.select(on, F.col("i").alias("j")), on)


def concatenated(first: DataFrame, second: DataFrame, size: int) -> DataFrame:
    """Two lists (name, i) one after the other; ``size`` is the first one's."""
    return first.select("name", "i").unionByName(second.select("name", (F.col("i") + size).alias("i")))


def marker_names(markers: DataFrame) -> DataFrame:
    """All names of a marker: its ``;``-parted ids (``.`` is none) and CHROM:POS."""
    ids = F.filter(F.split("id", ";"), lambda x: (x != ".") & (x != ""))
    return markers.select(*MARKER, F.explode(F.array_union(ids, F.array(F.concat_ws(":", "chrom", "pos")))).alias("name"))


def named_markers(markers: DataFrame, names: DataFrame, exclude: bool) -> DataFrame:
    """Markers that have (or, with ``exclude``, lack) a name in the list."""
    hit = marker_names(markers).join(names.select("name").distinct(), "name", "left_semi").select("chrom", "m").distinct()
    return markers.join(hit, ["chrom", "m"], "left_anti" if exclude else "left_semi")


def in_interval(rows: DataFrame, interval: Interval) -> DataFrame:
    return rows.where((F.col("chrom") == interval.chrom) & F.col("pos").between(interval.start, interval.end))


def within_map(rows: DataFrame, gmap: DataFrame) -> DataFrame:
    """Rows between the first and last map position of their chromosome; a chromosome without map is an error."""
    ends = gmap.groupBy("chrom").agg(F.min("bp").alias("_lo"), F.max("bp").alias("_hi"))
    joined = rows.join(F.broadcast(ends), "chrom", "left")
    known = F.when(F.col("_lo").isNull(), F.raise_error(F.concat(F.lit("no map for chromosome "), "chrom")).cast("boolean")).otherwise(F.col("pos").between(F.col("_lo"), F.col("_hi")))
    return joined.where(known).select(rows.columns)


def monomorphic(panel: DataFrame) -> DataFrame:
    return panel.groupBy(*MARKER).agg((F.min("allele") == F.max("allele")).alias("monomorphic"))
