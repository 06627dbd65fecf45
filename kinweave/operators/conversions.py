"""Alleles that gene conversion may have changed: clusters in which both alleles are common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(rows: DataFrame, grid: DataFrame, at: str = "pos", out: str = "grid_pos", width: int = 100_000) -> DataFrame:
    """The grid position nearest to each row, the earlier of two equally near ones.

    The grid is laid out as intervals between neighbours over bins, so this is one equi-join with a range condition.
    """
    by = Window.partitionBy("chrom").orderBy("pos")
    knots = grid.select("chrom", "pos").distinct().select("chrom", F.col("pos").alias("_p"), F.lead("pos").over(by).alias("_q"))
    ends = knots.groupBy("chrom").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    inner = knots.where("_q is not null").withColumn("_b", F.explode(F.sequence(F.floor(F.col("_p") / width), F.floor(F.col("_q") / width))))
    inner = inner.withColumnRenamed("chrom", "_c").withColumnRenamed("_b", "_d")
    x = F.col(at)
    joined = rows.withColumn("_b", F.floor(x / width)).join(F.broadcast(ends), "chrom")
    joined = joined.join(inner, (F.col("chrom") == F.col("_c")) & (F.col("_b") == F.col("_d")) & (x >= F.col("_p")) & (x < F.col("_q")), "left")
    found = F.when(x <= F.col("_first"), F.col("_first")).when(x >= F.col("_last"), F.col("_last")).when(F.col("_q") - x < x - F.col("_p"), F.col("_q")).otherwise(F.col("_p"))
    return joined.select(*rows.columns, found.alias(out))


def contingency(panel: DataFrame, clusters: DataFrame, grid_of: DataFrame) -> DataFrame:
    """(chrom, pos, cluster, allele, n): haplotypes by cluster, at the grid position nearest to each marker, and allele."""
    labels = clusters.select("chrom", F.col("pos").alias("grid_pos"), "hap", "cluster")
    rows = panel.join(grid_of, ["chrom", "pos"]).join(labels, ["chrom", "grid_pos", "hap"])
    return rows.groupBy("chrom", "pos", "cluster", "allele").agg(F.count("*").alias("n"))


def mixed_clusters(panel: DataFrame, clusters: DataFrame, grid_of: DataFrame, min_maf: float, min_size: int = 4, min_part: int = 2) -> DataFrame:
    """(chrom, pos, cluster, n0, n1, haps0, haps1): clusters of ``min_size`` or more with two alleles, each held by ``min_part`` or more.

    Markers are used if their major allele leaves ``min_maf`` or more; where more than two alleles occur, rarer
    ones than that are set aside after cluster sizes are taken. A cluster all of whose individuals are
    homozygous at the marker may be a deletion and is left out.
    """
    rows = panel.where("allele is not null")
    freq = rows.groupBy("chrom", "pos", "allele").agg(F.count("*").alias("n"))
    marker = freq.groupBy("chrom", "pos").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.count("*").alias("kinds"))
    marker = marker.where((F.col("kinds") > 1) & (1 - F.col("top") / F.col("total") >= min_maf))
    used = freq.join(marker, ["chrom", "pos"]).select("chrom", "pos", "allele", ((F.col("kinds") <= 2) | (F.col("n") / F.col("total") >= min_maf)).alias("counts"))
    person = rows.groupBy("chrom", "pos", F.floor(F.col("hap") / 2).alias("ind")).agg((F.min("allele") == F.max("allele")).alias("homozygous"))
    labels = clusters.select("chrom", F.col("pos").alias("grid_pos"), "hap", "cluster")
    full = rows.join(used, ["chrom", "pos", "allele"]).withColumn("ind", F.floor(F.col("hap") / 2)).join(person, ["chrom", "pos", "ind"])
    full = full.join(grid_of, ["chrom", "pos"]).join(labels, ["chrom", "grid_pos", "hap"])
    member = F.struct("ind", (F.col("hap") % 2).alias("h"))
    sized = full.groupBy("chrom", "pos", "cluster", "allele", "counts").agg(F.count("*").alias("n"), F.min("homozygous").alias("hom"), F.sort_array(F.collect_list(member)).alias("haps"))
    part: Column = F.when(F.col("counts") & (F.col("n") >= min_part), F.struct("allele", "n", "haps"))
    whole = sized.groupBy("chrom", "pos", "cluster").agg(F.sum("n").alias("size"), F.min("hom").alias("hom"), F.sort_array(F.collect_list(part)).alias("parts"))
    whole = whole.where((F.col("size") >= min_size) & (F.size("parts") > 1) & ~F.col("hom"))
    return whole.select("chrom", "pos", "cluster", F.get("parts.n", F.lit(0)).alias("n0"), F.get("parts.n", F.lit(1)).alias("n1"), F.get("parts.haps", F.lit(0)).alias("haps0"), F.get("parts.haps", F.lit(1)).alias("haps1"))
