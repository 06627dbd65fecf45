"""Genetic maps as joins: base positions to centimorgans and back, and steps between markers.

Each map interval is laid out over bins as wide as the chromosome's intervals are on average, so that looking up a position is an
equi-join on (chrom, bin) with a range condition, and the intervals lie in three times as many bins as there are knots at most, whatever
the map's scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSIDE_CM = 5.0


def _segments(gmap: DataFrame, key: str, value: str) -> DataFrame:
    """(chrom, k0, k1, v0, v1): neighbouring knots of the map."""
    rows = gmap.select("chrom", F.col(key).cast("double").alias("k0"), F.col(value).cast("double").alias("v0"))
    by = Window.partitionBy("chrom").orderBy("k0")
    return rows.withColumn("k1", F.lead("k0").over(by)).withColumn("v1", F.lead("v0").over(by)).where("k1 > k0")


def _ends(gmap: DataFrame, key: str, value: str) -> DataFrame:
    """First and last knots, how many there are, and the knots 5 cM or more inside of them (the far end if none is)."""
    rows = gmap.select("chrom", F.col(key).cast("double").alias("k"), F.col(value).cast("double").alias("v"), F.col("cm").cast("double").alias("cm"))
    first = rows.groupBy("chrom").agg(F.min_by("v", "k").alias("fv"), F.min("k").alias("fk"), F.max_by("v", "k").alias("lv"), F.max("k").alias("lk"), F.min("cm").alias("fc"), F.max("cm").alias("lc"))
    both = rows.join(F.broadcast(first), "chrom")
    low = F.when(F.col("cm") >= F.col("fc") + INSIDE_CM, F.struct("k", "v"))
    high = F.when(F.col("cm") <= F.col("lc") - INSIDE_CM, F.struct("k", "v"))
    return both.groupBy("chrom", "fk", "fv", "lk", "lv").agg(F.min(low).alias("lo"), F.max(high).alias("hi"), F.count("*").alias("_n"))


def interpolate(rows: DataFrame, gmap: DataFrame, at: str, out: str, inverse: bool = False, bin_size: float | None = None) -> DataFrame:
    """Adds ``out``: centimorgans of base positions ``at`` (or, inverse, whole base positions of centimorgans).

    Bins are ``bin_size`` wide; without it, as wide as the map's intervals are on average. An interval and what lies in it are placed by the same
    sums, so they meet in a bin however these are rounded.
    """
    key, value = ("cm", "bp") if inverse else ("bp", "cm")
    x = F.col("_x")
    mean = (F.col("lk") - F.col("fk")) / F.col("_n")
    width = F.lit(float(bin_size)) if bin_size else F.when(mean > 0, mean).otherwise(1.0)
    ends = _ends(gmap, key, value).withColumn("_width", width)

    def bin_of(place: Column) -> Column:
        return F.floor((place - F.col("fk")) / F.col("_width"))

    knots = _segments(gmap, key, value).join(F.broadcast(ends.select("chrom", "fk", "_width")), "chrom")
    inside = knots.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("k0")), bin_of(F.col("k1"))))).select(F.col("chrom").alias("_c"), F.col("_bin").alias("_b"), "k0", "k1", "v0", "v1")
    near = ends.select(F.col("chrom").alias("_e"), "fk", "_width")  # the rest of the ends comes after the join that may shuffle
    placed = rows.withColumn("_x", F.col(at).cast("double")).join(F.broadcast(near), F.col("chrom") == F.col("_e"), "left").withColumn("_bin", bin_of(x)).drop(*near.columns)
    placed = placed.join(inside, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (x >= F.col("k0")) & (x < F.col("k1")), "left")
    placed = placed.join(F.broadcast(ends.withColumnRenamed("chrom", "_e")), F.col("chrom") == F.col("_e"), "left")

    def line(k0: Column, v0: Column, k1: Column, v1: Column) -> Column:
        return v0 + (x - k0) / (k1 - k0) * (v1 - v0)

    c = F.col
    before = line(c("fk"), c("fv"), F.coalesce(c("lo.k"), c("lk")), F.coalesce(c("lo.v"), c("lv")))
    after = line(c("lk"), c("lv"), F.coalesce(c("hi.k"), c("fk")), F.coalesce(c("hi.v"), c("fv")))
    found = F.when(x < c("fk"), before).when(x == c("lk"), c("lv")).when(x > c("lk"), after).otherwise(line(c("k0"), c("v0"), c("k1"), c("v1")))
    return placed.select(*rows.columns, (F.floor(found + 0.5).cast("long") if inverse else found).alias(out))


def mean_step(markers: DataFrame) -> DataFrame:
    """Mean genetic distance of one base per chromosome, 1e-8 at least; one position only is an error."""
    ends = markers.groupBy("chrom").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min_by("cm", "pos").alias("ca"), F.max_by("cm", "pos").alias("cb"))
    step = F.greatest((F.col("cb") - F.col("ca")) / (F.col("b") - F.col("a")), F.lit(1e-8))
    return ends.select("chrom", F.when(F.col("b") > F.col("a"), step).otherwise(F.raise_error(F.lit("a single position")).cast("double")).alias("step"))


def spaced(markers: DataFrame, least: float | Column, cm: str = "cm", out: str = "cm_spaced") -> DataFrame:
    """Running centimorgans whose steps are ``least`` or more; ``step`` holds the distance from the marker before."""
    by = Window.partitionBy("chrom").orderBy("m")
    least = F.lit(least) if isinstance(least, float) else least
    step = F.coalesce(F.greatest(F.col(cm) - F.lag(cm).over(by), least), F.lit(0.0))
    rows = markers.withColumn("step", step)
    start = F.first(cm).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, start + F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def map_faults(gmap: DataFrame) -> DataFrame:
    """Knots that break a map's rules: bases ascend strictly, centimorgans never fall, all are finite."""
    by = Window.partitionBy("chrom").orderBy("line")
    rows = gmap.withColumn("_bp", F.lag("bp").over(by)).withColumn("_cm", F.lag("cm").over(by))
    bad = F.isnan("cm") | (F.abs("cm") == float("inf")) | F.col("cm").isNull() | (F.col("bp") <= F.col("_bp")) | (F.col("cm") < F.col("_cm"))
    return rows.where(F.coalesce(bad, F.lit(False))).drop("_bp", "_cm")


def identity(rows: DataFrame, scale: float = 1e-6, at: str = "pos", out: str = "cm") -> DataFrame:
    """Coordinates where there is no map: base positions times ``scale``."""
    return rows.withColumn(out, F.col(at) * F.lit(scale))


def of_chromosome(gmap: DataFrame, chrom: str) -> DataFrame:
    """One chromosome's map; one that is not in the map is an error."""
    rows = gmap.where(F.col("chrom") == chrom)
    if not rows.limit(1).count():
        raise ValueError(f"no map for chromosome {chrom}")
    return rows


def output_windows(ranges: DataFrame, size: int, first: int, block: int = 1 << 16) -> DataFrame:
    """(chrom, window, n, first, last): windows of ``size`` steps from step ``first`` on, and which output positions each has, of ranges
    (chrom, low, high) of steps, both ends included.

    A window is a row, a position is none. Windows are made ``block`` by ``block``, so neither an array nor a task has a whole chromosome's.
    """
    def window_of(step: Column) -> Column:
        return F.floor((step - first) / size)

    rows = ranges.where("low <= high").select("chrom", "low", "high", window_of(F.col("low")).alias("_a"), window_of(F.col("high")).alias("_z"))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor(F.col("_z") / block)))).repartition("chrom", "_block")
    inside = F.sequence(F.greatest("_a", F.col("_block") * block), F.least("_z", (F.col("_block") + 1) * block - 1))
    rows = rows.withColumn("window", F.explode(inside))
    start = F.col("window") * size + first
    rows = rows.select("chrom", "window", F.greatest("low", start).alias("first"), F.least("high", start + size - 1).alias("last"))
    return rows.select("chrom", "window", (F.col("last") - F.col("first") + 1).alias("n"), "first", "last")
