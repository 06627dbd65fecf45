"""Records of variant files as column expressions over their lines: any genotypes, single FORMAT fields, names, INFO.

Every function takes a DataFrame with the tab-parted fields of records as an array ``f`` (see ``split``), so filters on
fixed fields come before genotypes are looked at, and nothing leaves generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_FIXED = 9


def split(lines: DataFrame) -> DataFrame:
    """(f): the fields of each line that is neither empty nor of the header."""
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))


def n_alleles(alt: Column) -> Column:
    return F.when(alt == ".", 1).otherwise(F.size(F.split(alt, ",")) + 1)


def marker_fields(rows: DataFrame, *keep: str) -> DataFrame:
    """chrom, pos, id, ref, alt, n_alleles (and ``keep``). A chromosome that is empty, ``.`` or holds white space or a colon is an error."""
    f = F.col("f")
    bad = (f[0] == "") | (f[0] == ".") | f[0].rlike(r"[\s:]")
    chrom = F.when(bad, F.raise_error(F.concat(F.lit("bad chromosome: "), f[0])).cast("string")).otherwise(f[0])
    return rows.select(chrom.alias("chrom"), f[1].cast("int").alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), n_alleles(f[4]).alias("n_alleles"), *keep)


def genotypes(rows: DataFrame, *keep: str) -> DataFrame:
    """The marker fields with ``alleles`` (two per sample, null where missing) and ``phased`` (one per sample).

    Alleles may be parted by ``|`` or ``/``. A half-missing genotype is missing; a haploid one stands for two equal
    alleles and counts as phased.
    """

    def both(sample: Column) -> Column:
        parts = F.split(F.substring_index(sample, ":", 1), r"[|/]")
        one, two = parts[0].try_cast("int"), F.get(parts, F.size(parts) - 1).try_cast("int")
        return F.when(one.isNotNull() & two.isNotNull(), F.array(one, two)).otherwise(F.array(F.lit(None).cast("int"), F.lit(None).cast("int")))

    samples = F.slice("f", F.lit(N_FIXED + 1), F.size("f") - N_FIXED)
    rows = rows.withColumn("alleles", F.flatten(F.transform(samples, both)))
    rows = rows.withColumn("phased", F.transform(samples, lambda s: ~F.substring_index(s, ":", 1).contains("/")))
    return marker_fields(rows, "alleles", "phased", *keep)


def sample_data(rows: DataFrame, code: str, out: str = "data", *keep: str) -> DataFrame:
    """The marker fields with the values of one FORMAT field, one per sample (null where a sample ends before it)."""
    samples = F.slice("f", F.lit(N_FIXED + 1), F.size("f") - N_FIXED)
    place = F.array_position(F.split(F.col("f")[8], ":"), code) - 1
    values = F.transform(samples, lambda s: F.when(place >= 0, F.get(F.split(s, ":"), place.cast("int"))))
    return marker_fields(rows.withColumn(out, values), out, *keep)


def ploidy(rows: DataFrame) -> DataFrame:
    """chrom, pos, diploid: one flag per sample, true where its genotype has two alleles."""
    samples = F.slice("f", F.lit(N_FIXED + 1), F.size("f") - N_FIXED)
    return rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("int").alias("pos"), F.transform(samples, lambda s: F.substring_index(s, ":", 1).rlike("[|/]")).alias("diploid"))


def ploidy_faults(flags: DataFrame) -> DataFrame:
    """Rows of ``ploidy`` that differ from the first record of their chromosome."""
    first = flags.groupBy("chrom").agg(F.min_by("diploid", "pos").alias("expected"))
    return flags.join(F.broadcast(first), "chrom").where(F.col("diploid") != F.col("expected")).select(flags.columns)


def reappearing(rows: DataFrame, at: str) -> DataFrame:
    """(chrom, runs): chromosomes whose records, in the order of ``at``, are not all in one run.

    Runs are counted where records lie: only the ends of each of many ranges of ``at`` are compared over ranges.
    """
    width = 10_000
    by = Window.partitionBy("_r").orderBy(at)
    rows = rows.withColumn("_r", F.floor(F.col(at) / width)).withColumn("_fresh", F.coalesce(F.col("chrom") != F.lag("chrom").over(by), F.lit(True)))
    inside = rows.where("_fresh").groupBy("chrom").agg(F.count("*").alias("runs"))
    ends = rows.groupBy("_r").agg(F.min_by("chrom", at).alias("first"), F.max_by("chrom", at).alias("last"))
    # a range that begins with the chromosome that the one before ends with goes on with its run
    joined = ends.withColumn("before", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("_r"))).where("first = before").groupBy(F.col("first").alias("chrom")).agg(F.count("*").alias("over"))
    found = inside.join(joined, "chrom", "left").select("chrom", (F.col("runs") - F.coalesce("over", F.lit(0))).alias("runs"))
    return found.where("runs > 1")


def coordinate(chrom: Column, pos: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"))


def coordinate_and_alleles(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """chrom:pos with the alleles, underscore-parted."""
    return F.concat_ws("_", coordinate(chrom, pos), ref, F.when(alt != ".", F.replace(alt, F.lit(","), F.lit("_"))))


def info_end(info: Column) -> Column:
    """The END of an INFO field, null without one."""
    return F.regexp_extract(info, r"(?:^|;)END=(\d+)(?:;|$)", 1).try_cast("int")


def with_counts(info: Column, alleles: Column, kinds: Column) -> Column:
    """INFO with AN and AC as the alleles have them, in place of any written before."""
    called = F.filter(alleles, lambda a: a.isNotNull())
    counts = F.transform(F.sequence(F.lit(1), kinds - 1), lambda k: F.size(F.filter(called, lambda a: a == k)).cast("string"))
    rest = F.filter(F.split(info, ";"), lambda x: (x != ".") & (x != "") & ~x.rlike("^A[NC]="))
    own = F.array(F.concat(F.lit("AN="), F.size(called).cast("string")))
    own = F.when(kinds > 1, F.array_append(own, F.concat(F.lit("AC="), F.array_join(counts, ",")))).otherwise(own)
    return F.array_join(F.concat(rest, own), ";")


def genotype_index(one: Column, two: Column) -> Column:
    """The place of an unordered pair of alleles among all, by the larger allele first."""
    high, low = F.greatest(one, two), F.least(one, two)
    return (high * (high + 1) / 2).cast("long") + low


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start <= other_end) & (other_start <= end)


def span(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """The least interval that holds both, null if they do not overlap."""
    return F.when(overlaps(start, end, other_start, other_end), F.struct(F.least(start, other_start).alias("start"), F.greatest(end, other_end).alias("end")))


def elapsed(seconds: Column) -> Column:
    """Hours, minutes and seconds in words; hours and minutes only where there are any."""
    whole = F.floor(seconds + 0.5).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60

    def words(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))

    return F.concat_ws(" ", F.when(hours > 0, words(hours, "hour")), F.when(minutes > 0, words(minutes, "minute")), words(rest, "second"))
