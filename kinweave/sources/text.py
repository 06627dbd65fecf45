"""Text sources and sinks: phased VCF, PLINK maps, id lists, cluster files. Compressed by extension, or BGZF."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.panel import number_markers
from kinweave.sources.located import SPLIT, located_lines
from kinweave.sources.records import with_counts

FIXED = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text, .gz or .bgz files. Compressed ones are read by ``located_lines``, so BGZF is read by many tasks; where tasks can't
    reach the files themselves, Spark's readers take .gz files one task each, and .bgz files whole."""
    if path.endswith((".gz", ".bgz")) and (found := located_lines(spark, path)) is not None:
        return found.select("value")
    if not path.endswith(".bgz"):
        return spark.read.text(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame({"value": gzip.decompress(content).decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def chosen(fields: Column, kept: Column | None) -> Column:
    """The samples' fields of a record for which ``kept``, an array of flags, is true; all without it.

    ``fields`` is what the functions go through and not what they look things up in, so a record's fields are found once and not once a sample.
    """
    samples = F.slice(fields, F.lit(len(FIXED) + 1), F.lit(1 << 30))  # to the end
    return samples if kept is None else F.filter(samples, lambda _, i: F.get(kept, i))


def checked_order(rows: DataFrame, kept: Column | None) -> int | None:
    """Which of the ``kept`` samples are diploid in the first record of located ``rows`` (number, at, value), as a hash.

    A chromosome whose records are not all in one run of the file is an error: then the range of places of another lies inside its own.
    One grouped pass over the first field, which keeps one line a chromosome.
    """
    place = F.struct("number", "at")
    first = rows.groupBy(F.substring_index("value", "\t", 1).alias("chrom")).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.min_by("value", place).alias("value"))
    found = first.select("chrom", "low", "high", ploidy_hash(chosen(F.split("value", "\t"), kept)).alias("hash")).collect()  # a row a chromosome
    found = sorted(found, key=lambda r: tuple(r["low"]))
    for one, two in zip(found, found[1:], strict=False):
        if tuple(two["low"]) < tuple(one["high"]):
            raise ValueError(f"chromosome {one['chrom']} appears again after {two['chrom']}")
    return found[0]["hash"] if found else None


def ploidy_hash(samples: Column) -> Column:
    """A hash of which samples have two alleles in a record."""
    return F.xxhash64(F.transform(samples, lambda x: F.substring_index(x, ":", 1).rlike("[|/]")))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample ids, from the one header line that starts with the nine fixed columns.

    Other header lines must begin with ``##``, and there must be a record.
    """
    rows = lines(spark, path).where("value <> ''")
    wrong = rows.where(F.col("value").startswith("#") & ~F.col("value").startswith("##") & ~F.col("value").startswith("#CHROM")).take(1)
    if wrong:
        raise ValueError(f"{path}: bad header line {wrong[0]['value'][:80]!r}")
    if not rows.where(~F.col("value").startswith("#")).take(1):
        raise ValueError(f"{path}: no records")
    head = rows.where(F.col("value").startswith("#CHROM")).take(1)
    names = head[0]["value"].split("\t") if head else []
    if names[: len(FIXED)] != FIXED:
        raise ValueError(f"{path}: no header line with the nine fixed columns")
    if "" in names:
        raise ValueError(f"{path}: empty sample id")
    return names[len(FIXED) :]


def _allele(text: Column, n_alleles: Column) -> Column:
    value = text.try_cast("int")
    bad = value.isNull() | (value < 0) | (value >= n_alleles)
    return F.when(bad, F.raise_error(F.concat(F.lit("unphased, missing or bad allele: "), text)).cast("int")).otherwise(value)


def read_vcf(spark: SparkSession, path: str, exclude_samples: set[str] | None = None, split: int = SPLIT) -> DataFrame:
    """One row per marker: chrom, pos, id, ref, alt, qual, filter, info, n_alleles, m, alleles (two per kept sample).

    Markers are numbered per chromosome by position. Genotypes are read up to the first colon; a haploid
    one stands for two equal haplotypes. Unphased, missing or out-of-range alleles are errors, and so are, in the order of the file, a
    chromosome that comes back and a sample whose ploidy is not that of the first record. Fixed fields
    are parsed first, so filters on them are applied before any genotype is. ``split`` bytes of a file are a task.
    """
    names = vcf_samples(spark, path)
    flags = ["0" if n in (exclude_samples or set()) else "1" for n in names]
    if "1" not in flags:
        raise ValueError("all samples are excluded")
    # one constant however many samples there are, in place of an expression for each of them
    kept = F.split(F.lit(",".join(flags)), ",").cast("array<boolean>") if "0" in flags else None
    records = ~F.col("value").startswith("#") & (F.col("value") != "")
    located = located_lines(spark, path, split)
    rows = (lines(spark, path) if located is None else located).where(records).select(F.split("value", "\t").alias("f"))
    c = F.col("f")
    changed = F.lit(False)
    if located is not None:
        changed = ploidy_hash(chosen(c, kept)) != F.lit(checked_order(located.where(records), kept))
    count = F.when(c[4] == ".", 1).otherwise(F.size(F.split(c[4], ",")) + 1)
    wrong = F.size(c) != len(FIXED) + len(names)
    moved = F.raise_error(F.concat(F.lit("ploidy changes at "), F.get(c, F.lit(0)), F.lit(":"), F.get(c, F.lit(1)))).cast("array<string>")
    fields = F.when(wrong, F.raise_error(F.lit("wrong number of fields")).cast("array<string>")).when(changed, moved).otherwise(c)

    def both(sample: Column) -> Column:
        genotype = F.substring_index(sample, ":", 1)
        return F.when(genotype.contains("|"), F.split(genotype, r"\|")).otherwise(F.array(genotype, genotype))

    texts = F.flatten(F.transform(chosen(fields, kept), both))
    alleles = F.transform(F.array(count), lambda n: F.transform(texts, lambda a: _allele(a, n)))[0]  # alleles are counted once a record
    out = rows.select(
        c[0].alias("chrom"), c[1].cast("int").alias("pos"), c[2].alias("id"), c[3].alias("ref"), c[4].alias("alt"), c[5].alias("qual"), c[6].alias("filter"), c[7].alias("info"),
        count.alias("n_alleles"), alleles.alias("alleles"),
    )
    return number_markers(out)


def vcf_lines(markers: DataFrame, samples: list[str]) -> DataFrame:
    """Text lines of a VCF body, two haplotypes per sample; AN and AC of INFO are counted anew."""
    markers = markers.withColumn("info", with_counts(F.coalesce("info", F.lit(".")), F.col("alleles"), F.col("n_alleles")))
    genotypes = F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda i: F.concat_ws("|", F.get("alleles", 2 * i), F.get("alleles", 2 * i + 1)))
    fixed = [F.coalesce(F.col(x).cast("string"), F.lit(".")) for x in ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")]
    return markers.select("chrom", "pos", F.concat_ws("\t", *fixed, F.lit("GT"), F.array_join(genotypes, "\t")).alias("value"))


def write_vcf(markers: DataFrame, samples: list[str], path: str) -> None:
    """A folder of ordered gzip parts, the first of which begins with the header."""
    spark = markers.sparkSession
    head = spark.createDataFrame([(0, "", 0, "##fileformat=VCFv4.2"), (1, "", 0, "\t".join([*FIXED, *samples]))], "part int, chrom string, pos int, value string")
    body = vcf_lines(markers, samples).select(F.lit(2).alias("part"), "chrom", "pos", "value")
    head.unionByName(body).orderBy("part", "chrom", "pos").select("value").write.text(path, compression="gzip")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, bp, cm) of a four-column genetic map; rows of another width or with bad numbers are errors. Bases are long: those beyond
    2,147,483,647 are read too."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).where(F.trim("value") != "").select(f.alias("f"))
    wrong = (F.size("f") != 4) | F.get("f", F.lit(2)).try_cast("double").isNull() | F.get("f", F.lit(3)).try_cast("long").isNull()
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("bad map line: "), F.array_join("f", " "))).cast("array<string>")).otherwise(F.col("f"))
    return rows.select(checked.alias("f")).select(F.col("f")[0].alias("chrom"), F.col("f")[3].cast("long").alias("bp"), F.col("f")[2].cast("double").alias("cm"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one to a line; a line with two words is an error."""
    word = F.trim("value")
    checked = F.when(word.rlike(r"\s"), F.raise_error(F.concat(F.lit("more than one field: "), word)).cast("string")).otherwise(word)
    return lines(spark, path).where(word != "").select(checked.alias("name")).distinct()


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """CHROM, POS, CM and one ``c1|c2`` column per sample, from (chrom, pos, cm, hap, cluster)."""
    labels = F.transform(F.sort_array(F.collect_list(F.struct("hap", "cluster"))), lambda x: x["cluster"].cast("string"))
    rows = clusters.groupBy("chrom", "pos", "cm").agg(labels.alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("c") / 2).cast("int") - 1), lambda i: F.concat_ws("|", F.get("c", 2 * i), F.get("c", 2 * i + 1)))
    return rows.select("chrom", "pos", F.concat_ws("\t", "chrom", "pos", F.call_function("format_number", "cm", F.lit("0.0000")), F.array_join(pairs, "\t")).alias("value"))


def write_clusters(clusters: DataFrame, samples: list[str], path: str) -> None:
    spark = clusters.sparkSession
    head = spark.createDataFrame([(0, "", 0, "\t".join(["CHROM", "POS", "CM", *samples]))], "part int, chrom string, pos long, value string")
    body = cluster_lines(clusters).select(F.lit(1).alias("part"), "chrom", F.col("pos").cast("long").alias("pos"), "value")
    head.unionByName(body).orderBy("part", "chrom", "pos").select("value").write.text(path, compression="gzip")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, cm, hap, cluster) of a cluster file."""
    f = F.split("value", "\t")
    rows = lines(spark, path).where(~F.col("value").startswith("CHROM\t")).select(f.alias("f"))
    haps = F.split(F.array_join(F.slice("f", F.lit(4), F.size("f") - 3), "|"), r"\|")
    rows = rows.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[2].cast("double").alias("cm"), F.posexplode(haps).alias("hap", "c"))
    return rows.select("chrom", "pos", "cm", F.col("hap").cast("long").alias("hap"), F.col("c").cast("long").alias("cluster"))
