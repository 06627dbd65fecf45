"""The whole analysis: variants and a genetic map in, clusters of haplotypes at evenly spaced positions out."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.genetics import min_mac
from kinweave.operators import endpoints, gmap, panel, segments
from kinweave.plans.config import Parameters, parse_arguments
from kinweave.plans.storage import Scratch
from kinweave.sources import bref, text


def markers(spark: SparkSession, par: Parameters, genetic_map: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(all rows inside the map, those common enough, sample ids)."""
    dropped = {r["name"] for r in text.read_ids(spark, par.excludesamples).collect()} if par.excludesamples else set()
    if par.gt.endswith(".bref3"):
        names = [n for n in bref.bref_samples(spark, par.gt) if n not in dropped]
        rows = bref.read_bref(spark, par.gt, dropped, par.interval)
    else:
        names = [n for n in text.vcf_samples(spark, par.gt) if n not in dropped]
        rows = text.read_vcf(spark, par.gt, dropped)
    rows = rows if "m" in rows.columns else rows.withColumn("m", F.lit(0).cast("long"))
    if par.excludemarkers:
        rows = panel.named_markers(rows.withColumn("m", F.xxhash64("chrom", "pos", "ref", "alt")), text.read_ids(spark, par.excludemarkers), True)
    if par.interval:
        rows = panel.some_in_interval(rows, par.interval)
    rows = panel.within_map(rows, genetic_map)
    least = min_mac(par.min_maf, 2 * len(names)) if names else None
    counts = F.transform(F.sequence(F.lit(0), F.col("n_alleles") - 1), lambda a: F.size(F.filter("alleles", lambda x: x == a)))
    second = F.coalesce(F.get(F.sort_array(counts, asc=False), F.lit(1)), F.lit(0))
    if least is None:
        least = F.ceil(F.lit(float(np.nextafter(np.float32(par.min_maf), np.float32(-1)))) * F.size("alleles"))
    return rows, rows.where(second >= least), names


def run(spark: SparkSession, par: Parameters) -> dict[str, object]:
    """Writes ``out`` + ``.ibdclust`` and returns the statistics of the run."""
    scratch = Scratch(spark)
    genetic_map = text.read_map(spark, par.map)
    faults = gmap.map_faults(genetic_map.withColumn("line", F.monotonically_increasing_id())).take(1)
    if faults:
        raise ValueError(f"map: {faults[0]}")
    everything, kept, names = markers(spark, par, genetic_map)
    kept = panel.number_markers(kept)
    kept = scratch.keep(gmap.interpolate(kept.select("chrom", "m", "pos", "alleles"), genetic_map, "pos", "cm"), "markers")
    ends = kept.groupBy("chrom").agg(F.min("cm").alias("a"), F.max("cm").alias("b"), F.count("*").alias("n")).collect()
    if not ends:
        raise ValueError("no records left")
    steps = gmap.mean_step(kept)
    coords = kept.select("chrom", "m", "cm").join(F.broadcast(steps.withColumnRenamed("step", "least")), "chrom")  # spaced without genotypes
    spaced = gmap.spaced(coords, F.col("least"), out="cm_ibs").select("chrom", "m", F.col("cm_ibs").alias("cm"))
    found = segments.merged(segments.match_segments_streamed(kept.drop("cm").join(spaced, ["chrom", "m"]), par.min_ibs_cm, par.pbwt))
    found = scratch.keep(found, "ibs")
    grid = [(r["chrom"], k, cm) for r in ends for k, cm in segments.output_grid(r["a"], r["b"], par.out_cm)]
    points = spark.createDataFrame(grid, "chrom string, step long, cm double")
    points = gmap.interpolate(points, genetic_map, "cm", "pos", inverse=True).groupBy("chrom", "pos").agg(F.min("cm").alias("cm"))
    refined = [endpoints.refined(kept, found, r["chrom"], par) for r in ends]
    descent = refined[0]
    for more in refined[1:]:
        descent = descent.unionByName(more)
    descent = scratch.keep(descent, "ibd")
    size = kept.select(F.size("alleles")).first()[0]
    haps = spark.range(size).withColumnRenamed("id", "hap")
    labelled = segments.clusters(points, descent, haps, window=par.out_window_size).join(points, ["chrom", "pos"])
    labelled = scratch.keep(labelled, "clusters")
    names = names or [f"sample{i}" for i in range(size // 2)]
    text.write_clusters(labelled, names, f"{par.out}.ibdclust")
    sets = labelled.groupBy("chrom", "pos").agg((F.max("cluster") + 1).alias("n")).agg(F.sum("n"), F.count("*")).first()
    rate = segments.discordance(descent, kept).first()
    stats = {"samples": len(names), "haplotypes": size, "input VCF records": everything.count(), "filtered records": kept.count(), "output positions": len(grid), "clusters/position": round((sets[0] or 0) / max(sets[1], 1)), "discordance rate": f"{rate['rate'] or 0:.2e}"}
    written = [(k, f"{name:<20}: {value}") for k, (name, value) in enumerate(stats.items())]
    spark.createDataFrame(written, "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{par.out}.log")
    scratch.drop()
    return stats


def main(args: list[str]) -> None:
    par = parse_arguments(args)
    stats = run(SparkSession.builder.appName("kinweave").getOrCreate(), par)
    sys.stdout.write("".join(f"{k:<20}: {v}\n" for k, v in stats.items()))


if __name__ == "__main__":
    main(sys.argv[1:])
