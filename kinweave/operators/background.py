"""Background of chance sharing: pair counts by marker range, length probabilities, sampled lengths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.genetics import JavaRandom
from kinweave.operators import haploblocks
from kinweave.plans.storage import Scratch


def k_of_n(n: int, k: int, seed: int) -> list[int]:
    """``k`` of ``range(n)`` without replacement, ascending, by a partial shuffle; all if there are no more."""
    if n <= k:
        return list(range(n))
    r, moved = JavaRandom(seed), {}
    for j in range(k):
        x = j + r.next_int(n - j)
        moved[j], moved[x] = moved.get(x, x), moved.get(j, j)
    return sorted(moved[j] for j in range(k))


def wide(panel: DataFrame) -> DataFrame:
    """One row per marker: chrom, m, and the alleles of all haplotypes in order."""
    return panel.groupBy("chrom", "m").agg(F.transform(F.sort_array(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"]).alias("alleles"))


_RANGES = "chrom string, w long, m_start long, m_end long, n_pairs long, classes binary"


def _refining(least: int):
    """Counts of ranges over one block: classes of haplotypes are refined marker by marker until too few pairs are left. Ranges begin at
    each marker of the block where ``asked`` has no classes, and go on from those of the block before where it has; what is
    still open at the block's end is handed on with its classes."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        begun = zip(asked["m_start"].to_pylist(), asked["classes"].to_pylist(), strict=True)
        live = {m: np.frombuffer(x, np.int32) for m, x in begun if x is not None}
        fresh = asked["classes"].null_count > 0
        out: list[tuple] = []
        chrom, w = own["chrom"][0].as_py(), own["w"][0].as_py()
        for m, alleles in zip(own["m"].to_pylist(), haploblocks.genotypes(own), strict=True):
            row = alleles.astype(np.int64)
            if fresh:
                live[m] = np.zeros(len(row), np.int32)
            for start in list(live):
                _, classes, sizes = np.unique(live[start] * (row.max() + 1) + row, return_inverse=True, return_counts=True)
                pairs = int((sizes * (sizes - 1)).sum())
                if pairs < least:
                    del live[start]
                else:
                    live[start] = classes.astype(np.int32)
                    out.append((chrom, w, start, m, pairs, None))
        out += [(chrom, w + 1, start, None, None, classes.tobytes()) for start, classes in live.items()]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({c.split()[0]: pa.array(x, k) for c, x, k in zip(_RANGES.split(", "), columns, kinds, strict=True)})

    return run


def pair_counts(markers: DataFrame, n_haps: int, max_cdf: float = 0.999, starts: int = 64) -> DataFrame:
    """(chrom, m_start, m_end, n_pairs): ordered haplotype pairs identical over each marker range of (chrom, m, alleles).

    A range is kept while its count is at least ``ceil((1 - max_cdf) n (n - 1))``; longer ranges have fewer pairs.
    Ranges are counted in the block of ``starts`` markers where they begin; those that it does not end go on in the next one from
    the classes that they have reached.
    """
    scratch = Scratch(markers.sparkSession)
    least = max(1, math.ceil((1 - float(np.float32(max_cdf))) * n_haps * (n_haps - 1)))
    rows = scratch.keep(haploblocks.blocks(markers.select("chrom", "m", "alleles"), starts), "rows")
    none = F.lit(None)
    asked, done = rows.select("chrom", "w").distinct().select("chrom", "w", none.cast("long").alias("m_start"), none.cast("binary").alias("classes")), None
    while True:
        found = scratch.keep(haploblocks.over_blocks(rows, asked, _refining(least), _RANGES, scratch, starts), "counts")
        ended = found.where("m_end is not null").select("chrom", "m_start", "m_end", "n_pairs")
        done = ended if done is None else done.unionByName(ended)
        asked = found.where("m_end is null").select("chrom", "w", "m_start", "classes")
        if not asked.limit(1).count():
            return done


def length_probabilities(counts: DataFrame, n_haps: int, last: DataFrame) -> DataFrame:
    """Probability, as a 32-bit float, that a match from ``m_start`` first ends at ``m_end``.

    Where counts reach the chromosome's last marker (``last``: chrom, last), one more row gives the chance that the
    match goes on to the end, at the marker past it.
    """
    all_pairs = n_haps * (n_haps - 1)
    by = Window.partitionBy("chrom", "m_start").orderBy("m_end")
    before = F.coalesce(F.lag("n_pairs").over(by), F.lit(all_pairs))
    rows = counts.select("chrom", "m_start", "m_end", ((before - F.col("n_pairs") + 1) / (all_pairs + 1)).cast("float").alias("prob"))
    tail = counts.join(F.broadcast(last), "chrom").where("m_end = last")
    return rows.unionByName(tail.select("chrom", "m_start", (F.col("m_end") + 1).alias("m_end"), ((F.col("n_pairs") + 1) / (all_pairs + 1)).cast("float").alias("prob")))


def reversed_counts(counts: DataFrame, last_marker: int) -> DataFrame:
    """The same counts seen from the other end of the chromosome."""
    return counts.select("chrom", (F.lit(last_marker) - F.col("m_end")).alias("m_start"), (F.lit(last_marker) - F.col("m_start")).alias("m_end"), "n_pairs")


def drawn(spark: SparkSession, chrom: str, first: float, last: float, n_haps: int, loci: int, pairs: int, seed: int) -> DataFrame:
    """(chrom, locus, at, pair, hap1, hap2): ``pairs`` random pairs at each of ``loci`` random places from ``first`` to ``last``,
    a generator for each locus, seeded ``seed`` + its number."""
    if n_haps < 2:
        raise ValueError("fewer than two haplotypes")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for locus in frame["id"].tolist():
                r = JavaRandom(seed + locus)
                at = first + r.next_double() * (last - first)
                at = math.nextafter(at, -math.inf) if at >= last else at
                both = r.distinct_pairs(n_haps, pairs)
                yield pd.DataFrame({"chrom": chrom, "locus": locus, "at": at, "pair": range(pairs), "hap1": both[:, 0], "hap2": both[:, 1]})

    return spark.range(loci).mapInPandas(run, "chrom string, locus long, at double, pair long, hap1 long, hap2 long")


OPEN = "chrom string, w long, locus long, at double, pair long, hap1 long, hap2 long, forward boolean, m1 long, begin long, length double"


def _first_difference(own: pa.Table, asked: pa.Table) -> pa.Table:
    """``asked`` with the length of the match where it ends in this block, else with the block and the marker to go on at."""
    m, x = own["m"].to_numpy(), own["x"].to_numpy()
    hap1, hap2, begin, m1, at = (asked[c].to_numpy() for c in ("hap1", "hap2", "begin", "m1", "at"))
    forward = asked["forward"].to_numpy(zero_copy_only=False)
    ended = np.full(len(begin), -1)
    rows = haploblocks.genotypes(own)
    for ahead in (True, False):
        live = np.flatnonzero(forward == ahead)
        for k in range(len(rows)) if ahead else range(len(rows) - 1, -1, -1):
            here = m[k] >= begin[live] if ahead else m[k] <= begin[live]
            hit = here & ((rows[k][hap1[live]] != rows[k][hap2[live]]) | (m[k] == (m1[live] if ahead else 0)))
            ended[live[hit]] = k
            live = live[~hit]
            if not len(live):
                break
    w = own["w"][0].as_py()
    new = {"w": np.where(forward, w + 1, w - 1), "begin": np.where(forward, m[-1] + 1, m[0] - 1), "length": pa.array(np.abs(x[ended] - at), mask=ended < 0)}
    return pa.table({c: new.get(c, asked[c] if c in asked.column_names else None) for c, _ in (f.split() for f in OPEN.split(", "))})


def one_sided_lengths(markers: DataFrame, draws: DataFrame, reach: int = 64, width: float = 0.01) -> DataFrame:
    """(chrom, locus, pair, length): how far the pairs of ``draws`` (chrom, locus, at, pair, hap1, hap2) match from ``at`` on, over
    ``markers`` (chrom, m, x, alleles), forwards from places in the first half of the chromosome, backwards from others. Blocks hold
    ``reach`` markers, unless ``markers`` are blocks already (chrom, w, m, x, row).

    A match ends at the first marker at which the pair differs, or at the chromosome's last one on that side. Pairs are compared in
    the block in which they begin, and those still equal at its edge go on to the next one. Places are looked up in bins of
    ``width``, in the unit of ``x``.
    """
    scratch = Scratch(markers.sparkSession)
    rows = markers if "row" in markers.columns else scratch.keep(haploblocks.blocks(markers.select("chrom", "m", "x", "alleles"), reach), "blocks")
    markers = rows.select("chrom", "m", "x")
    ends = markers.groupBy("chrom").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("m").alias("m1"))
    size = rows.where("w = 0").groupBy("chrom").agg((F.max("m") + 1).alias("size"))
    by = Window.partitionBy("chrom").orderBy("m")
    knots = markers.select("chrom", "m", "x", F.lead("x").over(by).alias("next")).where("next > x")  # coordinates only
    knots = knots.withColumn("bin", F.explode(F.sequence(F.floor(F.col("x") / width), F.floor(F.col("next") / width))))
    draws = scratch.keep(draws.select("chrom", "locus", "at", "pair", "hap1", "hap2"), "draws")
    loci = draws.select("chrom", "locus", "at").distinct().join(F.broadcast(ends), "chrom").join(F.broadcast(size), "chrom")
    loci = loci.withColumn("forward", F.col("at") <= 0.5 * (F.col("x0") + F.col("x1"))).withColumn("bin", F.floor(F.col("at") / width))
    placed = loci.join(knots, ["chrom", "bin"]).where((F.col("x") <= F.col("at")) & (F.col("at") < F.col("next")))
    begin = F.when(F.col("forward") & (F.col("x") < F.col("at")), F.col("m") + 1).otherwise(F.col("m"))
    loci = placed.select("chrom", "locus", F.floor(begin / F.col("size")).cast("long").alias("w"), "m1", "forward", begin.alias("begin"))
    open_, done = draws.join(loci, ["chrom", "locus"]), None
    while True:
        found = scratch.keep(haploblocks.over_blocks(rows, open_, _first_difference, OPEN, scratch), "matched")
        ended = found.where("length is not null").select("chrom", "locus", "pair", "length")
        done = ended if done is None else done.unionByName(ended)
        open_ = found.where("length is null").drop("length")
        if not open_.limit(1).count():
            return done


def order_statistic(lengths: DataFrame, quantile: float) -> DataFrame:
    """Per locus, the length at rank ``floor(q n)`` (q as a 32-bit float) of all in ascending order."""
    by = Window.partitionBy("locus").orderBy("length", "pair")
    ranked = lengths.withColumn("r", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy("locus")))
    return ranked.where(F.col("r") == F.floor(F.lit(float(np.float32(quantile))) * F.col("n"))).select("locus", F.col("length").alias("stat"))


def usual_loci(stats: DataFrame, multiple: float) -> DataFrame:
    """Loci whose statistic is at most ``multiple`` times the median over loci."""
    middle = stats.agg(F.median("stat").alias("mid"))
    return stats.join(F.broadcast(middle)).where(F.col("stat") <= F.lit(float(multiple)) * F.col("mid")).select("locus", "stat")


def ecdf(lengths: DataFrame, at: DataFrame) -> DataFrame:
    """Share of lengths at most each ``x`` of a small table, held between 1/n and (n-1)/n.

    Lengths are counted by the least asked value that is not below them, so what is summed up is one row a value.
    """
    asked = sorted({float(r["x"]) for r in at.select("x").distinct().collect()})
    place = F.lit(len(asked)) if not asked else F.aggregate(F.array(*map(F.lit, asked)), F.lit(0), lambda k, x: k + F.when(x < F.col("length"), 1).otherwise(0))
    counts = {r["k"]: r["n"] for r in lengths.groupBy(place.alias("k")).agg(F.count("*").alias("n")).collect()}
    n, seen, rows = sum(counts.values()), 0, []
    for k, x in enumerate(asked):
        seen += counts.get(k, 0)
        rows.append((x, min(max(seen / n, 1 / n), (n - 1) / n)))
    return lengths.sparkSession.createDataFrame(rows, "x double, cdf double")
