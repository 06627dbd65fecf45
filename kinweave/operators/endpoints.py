"""Descent segments: where a shared segment around a focus most likely ends, by a coalescent length model.

Every identical-by-state segment is refined on its own, from the markers at which its two haplotypes differ
and from a model of its surroundings (coordinates, and probabilities of shared ranges), which only reach as far as
the segment's end is in doubt. So neither genotypes nor a chromosome's model are ever in one place:

1. Segments meet the blocks of genotypes around them (``haploblocks``), and a row of bits for each block goes on.
2. The bits of a segment are grouped with the model of the same blocks: its home (blocks of the size of its level) and one
   home on either side. Busy homes are dealt to slices of bounded number.
3. A segment whose ends are still in doubt at the edge of these is handed on to homes of twice the size, for the next
   round. A home that covers the chromosome settles all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import background as chance
from kinweave.operators import haploblocks
from kinweave.plans.config import Parameters
from kinweave.plans.storage import Scratch

#: Bytes of sampled lengths that a broadcast may hold, and rows (a segment's block each) of a slice.
BROADCAST_LIMIT, SLICE = 256 << 20, 1 << 14
RESULT = "chrom string, hap1 long, hap2 long, start_pos long, end_pos long"
ROUND = f"{RESULT}, new_start long, new_end long, state int"


class Beyond(Exception):
    """An estimate needs markers that are not at hand."""


class Background:
    """Chance that a match starting at a marker first breaks at another: stored ranges, else sampled lengths."""

    def __init__(self, probs: dict[int, np.ndarray] | list[np.ndarray], lengths: np.ndarray):
        """``probs``: start marker -> probabilities by length in markers; ``lengths``: ascending, in Morgans."""
        every = [np.asarray(probs.get(m, ())) for m in range(max(probs, default=-1) + 1)] if isinstance(probs, dict) else probs
        self.count = np.array([len(x) for x in every], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.values = np.concatenate([np.zeros(0), *every]).astype(np.float64)
        self.lengths = lengths

    def cdf(self, x: np.ndarray) -> np.ndarray:
        n = len(self.lengths)
        return np.clip(np.searchsorted(self.lengths, x, side="right") / n, 1 / n, (n - 1) / n)

    def across(self, morgans: np.ndarray, first: int, end: int, last: int) -> np.ndarray:
        """The chances from each of the markers ``first`` to ``end`` to ``end``; ``last`` is the hypothetical marker past the end."""
        start = np.arange(first, end + 1)
        if end == last:
            out = 1 - self.cdf(morgans[last - 1] - morgans[start])
        else:
            near, far = self.cdf(morgans[end - 1] - morgans[start]), self.cdf(morgans[end] - morgans[start])
            out = np.where(far != near, far - near, 0.5 / len(self.lengths))
        some = start[start < len(self.count)]
        some = some[end - some < self.count[some]]
        out[some - first] = self.values[self.first[some] + end - some]
        if end == last:
            out[-1] = 1.0
        return out

    def __call__(self, morgans: np.ndarray, start: int, end: int) -> float:
        return float(self.across(np.asarray(morgans), start, end, len(morgans) - 1)[0])


class View:
    """Markers read forwards, or backwards as their reflection. With ``closed`` they end where the chromosome does, in a
    hypothetical marker that always differs; else what runs past them is ``Beyond``."""

    def __init__(self, pos: np.ndarray, morgans: np.ndarray, background: Background, par: Parameters, closed: bool = True, rows: np.ndarray | None = None):
        self.closed, self.markers, self.rows = closed, pos, rows
        self.pos = np.append(pos, pos[-1]) if closed else pos
        self.morgans = np.append(morgans, morgans[-1] + float(np.float32(par.end_morgans))) if closed else morgans
        self.last = len(pos) if closed else -1
        self.background, self.par = background, par
        self.discord, self.gc = float(np.float32(par.discord)), float(np.float32(par.gc_discord))
        self.least = float(np.float32(par.min_cdf_ratio))

    def breaks(self, apart: np.ndarray) -> np.ndarray:
        """Places at which haplotypes differ, from whether they do at each marker."""
        return np.append(np.flatnonzero(apart), len(self.markers)) if self.closed else np.flatnonzero(apart)

    def differs(self, h1: int, h2: int) -> np.ndarray:
        """``breaks`` of two haplotypes of ``rows`` (markers by haplotypes)."""
        return self.breaks(self.rows[:, h1] != self.rows[:, h2])

    def length_cdf(self, y: np.ndarray) -> np.ndarray:
        return 1 - 1 / (2 * self.par.ne * np.expm1(2 * y) + 1)

    def end_distribution(self, breaks: np.ndarray, start_m: float, focus_pos: int, focus_m: float) -> tuple[int, np.ndarray]:
        """(first marker after the focus, distribution of the segment's end over the markers from there); ``breaks``: where the
        haplotypes differ, ascending."""
        at = first = int(np.searchsorted(self.markers, focus_pos, side="right"))
        total, before, factor = 0.0, float(self.length_cdf(focus_m - start_m)), 1.0
        cdf: list[np.ndarray] = []
        k, gate = int(np.searchsorted(breaks, at)), None
        while True:
            if k >= len(breaks):
                raise Beyond
            next_break = int(breaks[k])
            back = self.background.across(self.morgans, at, next_break, self.last)
            if gate is None:
                gate = self.pos[next_break] + self.par.gc_bases
            else:
                error = self.gc
                if self.pos[next_break] >= gate:
                    error, gate = self.discord, self.pos[next_break] + self.par.gc_bases
                factor *= error / back[0]
            mark = total
            ends = self.length_cdf(self.morgans[at : next_break + 1] - start_m)
            grown = np.cumsum(np.concatenate(([total], np.diff(np.concatenate(([before], ends))) * back * factor)))[1:]
            cdf.append(grown)
            total, before = float(grown[-1]), float(ends[-1])
            if next_break == self.last or total - mark < self.least * total:
                return first, np.concatenate(cdf) / total
            if total > 1e50:
                cdf = [c / total for c in cdf]
                factor, total = factor / total, 1.0
            at, k = next_break + 1, k + 1

    def quantile(self, breaks: np.ndarray, start_m: float, focus_pos: int, focus_m: float, p: float) -> tuple[int, float]:
        """(base position, Morgans) of a quantile of the segment's end."""
        first, cdf = self.end_distribution(breaks, start_m, focus_pos, focus_m)
        i = min(int(np.searchsorted(cdf, p, side="left")), len(cdf) - 1)
        m = first + i
        if m == self.last:
            return int(self.pos[m]), float(self.morgans[m - 1])
        x1, x2 = (focus_m if i == 0 else self.morgans[m - 1]), self.morgans[m]
        low, high = float(self.length_cdf(x1 - start_m)), float(self.length_cdf(x2 - start_m))
        below = cdf[i - 1] if i else 0.0
        pp = low + (p - below) / (cdf[i] - below) * (high - low)
        d = 2 * self.par.ne * (1 - pp)
        x = start_m + 0.5 * math.log((pp + d) / d)
        share = min(max((x - x1) / (x2 - x1), 0.0), math.nextafter(1.0, 0.0)) if x2 > x1 else 0.0
        y1 = focus_pos + 1 if i == 0 else self.pos[m - 1]
        return int(np.rint(y1 + share * (self.pos[m] - y1))), float(x)


class Estimator:
    """Alternates estimates of both ends around a moving focus, then takes the final quantiles.

    ``pos`` and ``morgans`` are consecutive markers, the chromosome's first and last among them if ``closed`` says so.
    """

    def __init__(self, pos: np.ndarray, morgans: np.ndarray, rows: np.ndarray | None, forward: Background, backward: Background, par: Parameters, closed: tuple[bool, bool] = (True, True)):
        self.pos, self.morgans, self.rows, self.par, self.closed = pos, morgans, rows, par, closed
        self.fwd = View(pos, morgans, forward, par, closed[1], rows)
        self.bwd = View(-pos[::-1], -morgans[::-1], backward, par, closed[0], None if rows is None else rows[::-1])
        self.prefocus, self.final = float(np.float32(par.prefocus_quantile)), float(np.float32(par.quantile))
        self.gate, self.trim = float(np.float32(par.max_rel_diff)), float(np.float32(0.01) * np.float32(par.trim))
        self.least = 0.01 * float(np.float32(par.min_ibd_cm))

    def to_morgans(self, x: int) -> float:
        return self._line(self.pos, self.morgans, x, 5_000_000)

    def to_pos(self, x: float) -> int:
        return math.floor(self._line(self.morgans, self.pos, x, 0.05) + 0.5)

    def _line(self, xs: np.ndarray, ys: np.ndarray, x: float, inside: float) -> float:
        """Interpolation between markers; past the ends, along the line to a marker ``inside`` or more from the end."""
        if x < xs[0]:
            k = int(np.searchsorted(xs, xs[0] + inside))
            if not self.closed[0] or (k >= len(xs) and not self.closed[1]):
                raise Beyond
            k = min(k, len(xs) - 1)
            return float(ys[0] + (x - xs[0]) / (xs[k] - xs[0]) * (ys[k] - ys[0]))
        if x > xs[-1]:
            k = int(np.searchsorted(xs, xs[-1] - inside, side="right")) - 1
            if not self.closed[1] or (k < 0 and not self.closed[0]):
                raise Beyond
            k = max(k, 0)
            return float(ys[-1] + (x - xs[-1]) / (xs[-1] - xs[k]) * (ys[-1] - ys[k]))
        k = int(np.searchsorted(xs, x))
        if xs[k] == x:
            return float(ys[k])
        return float(ys[k - 1] + (x - xs[k - 1]) / (xs[k] - xs[k - 1]) * (ys[k] - ys[k - 1]))

    def _end(self, breaks, other_m: float, focus: int, p: float) -> tuple[int, float]:
        return self.fwd.quantile(breaks, other_m, focus, self.to_morgans(focus), p)

    def _start(self, breaks, other_m: float, focus: int, p: float) -> tuple[int, float]:
        pos, m = self.bwd.quantile(breaks, -other_m, -focus, -self.to_morgans(focus), p)
        return -pos, -m

    def _moves(self, focus: int, old: int, new: int) -> bool:
        was, now = abs(old - focus), abs(new - focus)
        return was > 0 and now > 0 and abs(now - was) / was > self.gate

    def estimate(self, h1: int, h2: int, start: int, end: int) -> tuple[int, int] | None:
        """The segment of two haplotypes of ``rows``."""
        return self.between(self.rows[:, h1] != self.rows[:, h2], start, end)

    def between(self, differs: np.ndarray, start: int, end: int) -> tuple[int, int] | None:
        """The ends of a segment of two haplotypes that differ at these markers, None if it is too short."""
        if not self.pos[0] <= start <= end <= self.pos[-1]:
            if all(self.closed):
                raise ValueError(f"segment {start}-{end} is not inside the markers")
            raise Beyond
        forward, backward = self.fwd.breaks(differs), self.bwd.breaks(differs[::-1])
        low, high, focus, still = start, end, (start + end) // 2, 0
        for turn in range(2 * self.par.max_its - 2):
            ends = turn % 2 == 0
            new = self._end(forward, self.to_morgans(low), focus, self.prefocus)[0] if ends else self._start(backward, self.to_morgans(high), focus, self.prefocus)[0]
            moved = self._moves(focus, high if ends else low, new)
            if moved:
                a, b = (low, new) if ends else (new, high)
                mid = focus if self.par.fix_focus else min(max((a + b) // 2, start + 1), end - 1)
                moved = a < mid < b
                if moved:
                    low, high, focus = a, b, mid
            still = 0 if moved else still + 1
            if still == 2:
                break
        last = self._end(forward, self.to_morgans(low), focus, self.final)[1]
        first = self._start(backward, self.to_morgans(high), focus, self.final)[1]
        if last - first < self.least or first + self.trim > last - self.trim:
            return None
        return self.to_pos(first + self.trim), self.to_pos(last - self.trim)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def estimates(lengths, blocks: int, par: Parameters):
    """(model of consecutive blocks, bits of segments there) -> segments with their ends; state 0: too short, 1: found, 2: beyond."""

    def run(model: pa.Table, bits: pa.Table) -> pa.Table:
        model, bits = model.sort_by("w"), bits.sort_by([(c, "ascending") for c in ("hap1", "hap2", "start_pos", "end_pos", "w")])
        columns = {c: model[c].combine_chunks().flatten() for c in ("pos", "x", "forward", "backward")}
        pos, x = columns["pos"].to_numpy(), columns["x"].to_numpy()
        forward, backward = (_lists(pa.chunked_array([columns[c]])) for c in ("forward", "backward"))
        closed = (model["w"][0].as_py() == 0, model["w"][model.num_rows - 1].as_py() == blocks - 1)
        sampled = lengths.value
        made = Estimator(pos, x, None, Background(forward, sampled), Background(backward[::-1], sampled), par, closed)
        size = np.diff(model["pos"].combine_chunks().offsets.to_numpy()).tolist()
        key = np.stack([bits[c].to_numpy() for c in ("hap1", "hap2", "start_pos", "end_pos")], 1)
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        packed = bits["bits"].to_pylist()
        out = np.zeros((len(head), 3), np.int64)
        for i, a in enumerate(head.tolist()):
            apart = np.concatenate([np.unpackbits(np.frombuffer(packed[a + k], np.uint8), count=n) for k, n in enumerate(size)]).view(bool)
            try:
                found = made.between(apart, int(key[a, 2]), int(key[a, 3]))
                out[i] = (*found, 1) if found else (0, 0, 0)
            except Beyond:
                out[i] = (0, 0, 2)
        return pa.table(
            {"chrom": pa.array([model["chrom"][0].as_py()] * len(head), pa.string()), **{c: key[head, k] for k, c in enumerate(("hap1", "hap2", "start_pos", "end_pos"))}, "new_start": out[:, 0], "new_end": out[:, 1], "state": out[:, 2].astype(np.int32)}
        )

    return run


def model_blocks(coords: DataFrame, counts: DataFrame, n_haps: int, last: int, width: int) -> DataFrame:
    """(chrom, w, pos, x, forward, backward) from coords (chrom, m, pos, x): one row a block, an item a marker; ``forward`` and
    ``backward`` hold the stored chances of ranges that begin at the marker, read either way."""
    ends = coords.groupBy("chrom").agg(F.max("m").alias("last"))

    def ragged(table: DataFrame, name: str) -> DataFrame:
        rows = chance.length_probabilities(table, n_haps, ends).groupBy("m_start")
        return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("m_end", "prob"))), lambda p: p["prob"]).alias(name))

    forward = ragged(counts, "forward").withColumnRenamed("m_start", "m")
    backward = ragged(chance.reversed_counts(counts, last), "backward").select((F.lit(last) - F.col("m_start")).alias("m"), "backward")
    none = F.array().cast("array<float>")
    rows = coords.join(forward, "m", "left").join(backward, "m", "left").withColumn("w", F.floor(F.col("m") / width).cast("long"))
    rows = rows.groupBy("chrom", "w").agg(F.sort_array(F.collect_list(F.struct("m", F.col("pos").cast("long").alias("pos"), "x", F.coalesce("forward", none).alias("forward"), F.coalesce("backward", none).alias("backward")))).alias("rows"))
    return rows.select("chrom", "w", *(F.col(f"rows.{c}").alias(c) for c in ("pos", "x", "forward", "backward")))


def descent_segments(found: DataFrame, rows: DataFrame, model: DataFrame, lengths: np.ndarray, last: int, width: int, par: Parameters, scratch: Scratch) -> DataFrame:
    """Segments (haplotypes by place) of one chromosome with estimated ends; those too short are dropped, and repeated ones count once.

    ``rows`` are its blocks of genotypes, ``model`` its ``model_blocks``, ``last`` its last marker.
    """
    blocks = last // width + 1
    shared = found.sparkSession.sparkContext.broadcast(lengths)
    low = scratch.keep(haploblocks.extents(rows), "extents")
    open_ = haploblocks.block_of(haploblocks.block_of(found.distinct(), "start_pos", low, "_w0"), "end_pos", low, "_w1")
    reach = F.ceil(F.log2(F.greatest(F.col("_w1") - F.col("_w0"), F.lit(1)))).cast("int")  # so that a segment begins and ends in its home or beside it
    open_ = scratch.keep(open_.withColumn("level", reach), "open")
    top, done = max(0, math.ceil(math.log2(blocks))), None
    none = haploblocks._nothing(ROUND)
    run = estimates(shared, blocks, par)
    for turn in range(top + 2):
        size = F.pow(F.lit(2.0), F.col("level")).cast("long")
        homes = open_.withColumn("home", F.floor((F.col("_w0") + F.col("_w1")) / 2 / size).cast("long"))
        reached = F.sequence(F.greatest((F.col("home") - 1) * size, F.lit(0)), F.least((F.col("home") + 2) * size - 1, F.lit(blocks - 1)))
        asked = homes.withColumn("w", F.explode(reached)).select("chrom", "w", "hap1", "hap2", "start_pos", "end_pos", "_w0", "_w1", "level", "home")
        bits = scratch.keep(haploblocks.pair_bits(rows, asked, width, scratch), "bits")
        slices = scratch.keep(bits.groupBy("chrom", "level", "home").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("_n"), F.min("w").alias("_lo"), F.max("w").alias("_hi")), "homes")
        near = slices.withColumn("w", F.explode(F.sequence("_lo", "_hi"))).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        left = model.join(near.drop("_lo", "_hi", "_n"), ["chrom", "w"])
        right = bits.join(slices.select("chrom", "level", "home", "_n"), ["chrom", "level", "home"])
        right = right.withColumn("_slice", F.pmod(F.xxhash64("hap1", "hap2", "start_pos"), F.col("_n")).cast("int")).drop("_n")
        key = ["chrom", "level", "home", "_slice"]
        made = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: run(a, b) if a.num_rows and b.num_rows else none, ROUND)
        made = scratch.keep(made, f"ends-{turn}")
        settled = made.where("state = 1").select("chrom", "hap1", "hap2", F.col("new_start").alias("start_pos"), F.col("new_end").alias("end_pos"))
        done = settled if done is None else done.unionByName(settled)
        beyond = made.where("state = 2").select("chrom", "hap1", "hap2", "start_pos", "end_pos")
        open_ = scratch.keep(open_.join(beyond.distinct(), beyond.columns, "left_semi").withColumn("level", F.col("level") + 1), "open")
        scratch.drop(bits)
        if not open_.limit(1).count():
            return done
    raise RuntimeError("segments that no home settles")


def refined(markers: DataFrame, found: DataFrame, chrom: str, par: Parameters, width: int | None = None) -> DataFrame:
    """Descent segments of one chromosome of ``markers`` (chrom, m, pos, cm, alleles; m from 0 without gaps), with the background
    of its own markers: counts of locally shared ranges, and sampled match lengths. ``width``: markers of a block.

    Of genotypes nothing reaches the driver; of sampled lengths, a number for each locus and pair that the parameters ask for does.
    """
    spark = markers.sparkSession
    scratch = Scratch(spark)
    own = markers.where(F.col("chrom") == chrom)
    size = own.agg(F.count("*").alias("n"), F.max(F.size("alleles")).alias("haps"), F.min_by("cm", "m").alias("first")).first()
    if not size["n"]:
        raise ValueError(f"no markers on {chrom}")
    if 8 * par.global_loci * par.global_segments > BROADCAST_LIMIT:
        raise ValueError(f"{par.global_loci} loci of {par.global_segments} pairs are more lengths than a broadcast takes")
    n_haps, last, width = size["haps"], size["n"] - 1, width or haploblocks.width_for(size["haps"])
    by = Window.partitionBy("chrom").orderBy("m")
    step = F.coalesce(F.greatest(F.col("cm") - F.lag("cm").over(by), F.lit(1e-6)), F.lit(0.0))
    coords = own.select("chrom", "m", F.col("pos").cast("long").alias("pos"), step.alias("step"))  # coordinates only
    along = F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0))
    coords = scratch.keep(coords.select("chrom", "m", "pos", (0.01 * (F.lit(size["first"]) + along)).alias("x")), "coords")
    rows = scratch.keep(haploblocks.blocks(own.select("chrom", "m", "alleles").join(coords, ["chrom", "m"]), width), "blocks")

    picks = chance.k_of_n(n_haps, par.local_segments, par.seed)
    some = own if len(picks) == n_haps else own.withColumn("alleles", F.transform(F.array(*map(F.lit, picks)), lambda i: F.get("alleles", i)))
    counts = scratch.keep(chance.pair_counts(some, len(picks), par.local_max_cdf), "pairs")
    model = scratch.keep(model_blocks(coords, counts, len(picks), last, width), "model")
    span = coords.agg(F.min("x"), F.max("x")).first()
    draws = chance.drawn(spark, chrom, span[0], span[1], n_haps, par.global_loci, par.global_segments, par.seed)
    lengths = scratch.keep(chance.one_sided_lengths(rows, draws), "lengths")
    usual = chance.usual_loci(chance.order_statistic(lengths, par.global_quantile), par.global_multiple)
    sampled = lengths.join(F.broadcast(usual), "locus", "left_semi").select("length").toPandas()["length"]
    return descent_segments(found.where(F.col("chrom") == chrom).select("chrom", "hap1", "hap2", "start_pos", "end_pos"), rows, model, np.sort(sampled.to_numpy()), last, width, par, scratch)
