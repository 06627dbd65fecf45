"""The haplotype operators on golden micro-fixtures and against plain forms."""

import gzip
import itertools
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.functions.genetics import JavaRandom, coalescent_cdf, coalescent_quantile, min_mac
from kinweave.operators import background, conversions, endpoints, gmap, haploblocks, panel, segments
from kinweave.operators.components import connected_components
from kinweave.plans.config import HIGHEST, LOWEST, Interval, Parameters, parse_arguments, parse_interval
from kinweave.plans.run import run
from kinweave.sources import bref, located, records, text
from kinweave.streaming.segments import window_counts


def test_intervals():
    for written in ("20", "20:", "20:-"):
        assert parse_interval(written) == Interval("20", LOWEST, HIGHEST)
    assert parse_interval("20:100") == Interval("20", 100, 100)
    assert parse_interval("20:100-") == Interval("20", 100, HIGHEST)
    assert parse_interval("20:-200") == Interval("20", LOWEST, 200)
    assert parse_interval("a:b:100-200") == Interval("a:b", 100, 200)
    for bad in ("20:200-100", "20:a-b", ""):
        with pytest.raises(ValueError):
            parse_interval(bad)


def test_arguments():
    par = parse_arguments(["gt=a", "map=b", "out=c", "min-maf=0.2", "max-rel-change=0.3", "fix-focus=t", "nthreads=8"])
    assert (par.min_maf, par.max_rel_diff, par.fix_focus, par.seed) == (0.2, 0.3, True, -99999)
    for bad in (["gt=a", "map=b", "out=a"], ["gt=a", "map=b"], ["gt=a", "map=b", "out=c", "nope=1"], ["gt=a", "map=b", "out=c", "min-maf=0.7"], ["gt=a", "map=b", "out=c", "pbwt=0"]):
        with pytest.raises(ValueError):
            parse_arguments(bad)


def test_min_mac_table():
    assert [min_mac(0.1, n) for n in (2, 10, 20, 100, 1000, 2000, 20000, 400000)] == [1, 1, 2, 10, 100, 200, 2000, 40000]


def test_java_random():
    for seed, first, rest in ((42, 0.7275636800328681, [248, 384, 470, 25, 5, 418]), (-99999, 0.45913451767113456, [366, 443, 228, 232, 191, 274])):
        r = JavaRandom(seed)
        assert r.next_double() == first and [r.next_int(500) for _ in rest] == rest


def test_coalescent(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(coalescent_cdf(F.lit(0.01), 10000).alias("a"), coalescent_quantile(F.lit(0.5), 10000).alias("b"), coalescent_quantile(coalescent_cdf(F.lit(0.01), 10000), 10000).alias("c")).first()
    assert abs(r.a - 0.9975310275797088) < 1e-12 and abs(r.b - 2.4999375020885306e-05) < 1e-17 and abs(r.c - 0.01) < 1e-9


def test_interpolation(spark):
    knots = spark.createDataFrame([("1", 1000, 0.0), ("1", 2000, 1.0), ("1", 4000, 2.0)], "chrom string, bp long, cm double")
    rows = spark.createDataFrame([("1", x) for x in (500, 1000, 1500, 2000, 3000, 4000, 5000)], "chrom string, pos long")
    got = {r.pos: r.cm for r in gmap.interpolate(rows, knots, "pos", "cm").collect()}
    want = {500: -1 / 3, 1000: 0.0, 1500: 0.5, 2000: 1.0, 3000: 1.5, 4000: 2.0, 5000: 8 / 3}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    back = spark.createDataFrame([("1", v) for v in want.values()], "chrom string, cm double")
    assert sorted(r.bp for r in gmap.interpolate(back, knots, "cm", "bp", inverse=True).collect()) == sorted(want)
    assert gmap.map_faults(spark.createDataFrame([("1", 5, 1.0, 0), ("1", 5, 1.0, 1), ("1", 6, 0.5, 2)], "chrom string, bp long, cm double, line long")).count() == 2


def _panel(spark, matrix):
    rows = [("1", m, 1000 * (m + 1), 0.1 * (m + 1), h, int(a)) for m, row in enumerate(matrix) for h, a in enumerate(row)]
    return spark.createDataFrame(rows, "chrom string, m long, pos long, cm double, hap long, allele int")


def test_prefix_order_fixture(spark):
    got = segments.prefix_order(_panel(spark, [[0, 1, 0, 1], [1, 1, 0, 0], [0, 0, 0, 1]])).toPandas().sort_values(["m", "rank"])
    assert [list(g.hap) for _, g in got.groupby("m")] == [[0, 2, 1, 3], [2, 3, 0, 1], [2, 0, 1, 3]]
    assert [list(g.divergence) for _, g in got.groupby("m")] == [[1, 0, 1, 0], [2, 1, 2, 1], [3, 2, 1, 3]]


@pytest.mark.parametrize("step", [1, 3])
def test_streamed_matches_equal_relational(spark, step):
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    matrix = r.integers(0, 3, size=(25, 14)) * (r.random((25, 14)) < 0.6)
    rows = _panel(spark, matrix)
    wide = rows.groupBy("chrom", "m", "pos", "cm").agg(F.transform(F.sort_array(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"]).alias("alleles"))
    one = segments.match_segments(rows, rows.select("chrom", "m", "pos", "cm").distinct(), 0.2, step).collect()
    two = segments.match_segments_streamed(wide, 0.2, step).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and one
    columns = ["chrom", "m", "rank", "hap", "divergence"]
    assert sorted(map(tuple, segments.prefix_order(rows, step).select(columns).collect())) == sorted(map(tuple, segments.prefix_order_streamed(wide, step).select(columns).collect()))
    for x in one:
        a, b = x.start_pos // 1000 - 1, x.end_pos // 1000 - 1
        assert x.hap1 < x.hap2 and all(matrix[m, x.hap1] == matrix[m, x.hap2] for m in range(a, b + 1) if m % step == b % step)


def test_merge_compares_with_previous_row(spark):
    rows = [("1", 1, 2, *x) for x in ((0, 100), (10, 20), (50, 60))] + [("1", 1, 3, *x) for x in ((0, 5), (5, 9), (10, 11))]
    got = segments.merged(spark.createDataFrame(rows, "chrom string, hap1 long, hap2 long, start_pos long, end_pos long")).collect()
    assert sorted((r.hap2, r.start_pos, r.end_pos) for r in got) == [(2, 0, 100), (2, 50, 60), (3, 0, 9), (3, 10, 11)]


def test_cluster_labels(spark):
    points = spark.createDataFrame([("1", 50)], "chrom string, pos long")
    edges = spark.createDataFrame([("1", 1, 4, 0, 60), ("1", 4, 5, 50, 50), ("1", 0, 1, 51, 90)], "chrom string, hap1 long, hap2 long, start_pos long, end_pos long")
    got = segments.clusters(points, edges, spark.range(6).withColumnRenamed("id", "hap"), 7).orderBy("hap").collect()
    assert [r.cluster for r in got] == [0, 1, 2, 3, 1, 1]


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 640)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)] + [(3, 3), (None, 4)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_panel_statistics(spark):
    rows = _panel(spark, [[0, 1, 1, 2, 2, 1], [0, 0, 0, 0, 0, 0]])
    assert {(r.m, r.major) for r in panel.major_alleles(rows).collect()} == {(0, 1), (1, 0)}
    assert {(r.m, r.mac) for r in panel.minor_counts(rows).collect()} == {(0, 2), (1, 0)}
    assert {r.m: r.monomorphic for r in panel.monomorphic(rows).collect()} == {0: False, 1: True}
    kept = panel.without_samples(rows, spark.createDataFrame([(1,)], "sample int")).where("m = 0").orderBy("hap").collect()
    assert [(r.hap, r.allele) for r in kept] == [(0, 0), (1, 1), (2, 2), (3, 1)]
    with pytest.raises(Exception, match="no map for chromosome"):
        panel.within_map(rows, spark.createDataFrame([("2", 1), ("2", 9)], "chrom string, bp long")).count()


def test_pair_counts(spark):
    r = np.random.default_rng(5)
    matrix = r.integers(0, 2, size=(6, 8))
    got = {(x.m_start, x.m_end): x.n_pairs for x in background.pair_counts(background.wide(_panel(spark, matrix)), 8, 0.5, starts=2).collect()}
    want = {}
    for a, b in itertools.combinations_with_replacement(range(6), 2):
        n = sum((matrix[a : b + 1, i] == matrix[a : b + 1, j]).all() for i in range(8) for j in range(8) if i != j)
        if (n := int(n)) >= 28:
            want[a, b] = n
    assert got == want
    table = spark.createDataFrame([("1", a, b, n) for (a, b), n in want.items()], "chrom string, m_start long, m_end long, n_pairs long")
    twice = background.reversed_counts(background.reversed_counts(table, 5), 5)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, table.collect()))


def test_pair_counts_of_long_matches_and_the_end(spark):
    """Two equal haplotypes outlast every window; the last marker brings one more probability."""
    r = np.random.default_rng(6)
    matrix = r.integers(0, 3, size=(70, 5))
    matrix[:, 4] = matrix[:, 1]
    counts = background.pair_counts(background.wide(_panel(spark, matrix)), 5, 0.95, starts=4)
    got = {(x.m_start, x.m_end): x.n_pairs for x in counts.collect()}
    assert len(got) == 70 * 71 // 2 and all(got[a, 69] >= 2 for a in range(70))
    last = spark.createDataFrame([("1", 69)], "chrom string, last long")
    probs = {(x.m_start, x.m_end): x.prob for x in background.length_probabilities(counts, 5, last).collect()}
    assert len(probs) == len(got) + 70
    for a in (0, 33, 69):
        before = [20, *(got[a, b] for b in range(a, 70))]
        want = [(x - y + 1) / 21 for x, y in itertools.pairwise(before)] + [(got[a, 69] + 1) / 21]
        assert np.allclose([probs[a, b] for b in range(a, 71)], want, atol=1e-6)


def test_one_sided_lengths(spark):
    r = np.random.default_rng(8)
    matrix = r.integers(0, 2, size=(90, 6))
    matrix[:, 5] = matrix[:, 0]
    x = np.cumsum(r.random(90)) * 0.002
    markers = spark.createDataFrame([("1", m, float(x[m]), row.tolist()) for m, row in enumerate(matrix)], "chrom string, m long, x double, alleles array<int>")
    draws = background.drawn(spark, "1", float(x[0]), float(x[-1]), 6, 12, 30, -99999)
    got = {(g.locus, g.pair): g.length for g in background.one_sided_lengths(markers, draws, reach=7).collect()}
    rows = draws.collect()
    assert len(got) == len(rows) == 360
    for d in rows:
        apart = matrix[:, d.hap1] != matrix[:, d.hap2]
        if d.at <= (x[0] + x[-1]) / 2:
            m = next((m for m in range(90) if x[m] >= d.at and apart[m]), 89)
        else:
            m = next((m for m in range(89, -1, -1) if x[m] <= d.at and apart[m]), 0)
        assert abs(got[d.locus, d.pair] - abs(x[m] - d.at)) < 1e-12
    again = JavaRandom(-99999 + 3)
    at = x[0] + again.next_double() * (x[-1] - x[0])
    assert abs(next(d.at for d in rows if d.locus == 3) - at) < 1e-15


def test_k_of_n():
    r, items = JavaRandom(5), list(range(50))
    for j in range(20):
        k = j + r.next_int(50 - j)
        items[j], items[k] = items[k], items[j]
    assert background.k_of_n(50, 20, 5) == sorted(items[:20]) and background.k_of_n(3, 9, 5) == [0, 1, 2]


def test_nearest_ties_go_back(spark):
    rows = spark.createDataFrame([("1", x) for x in (5, 10, 14, 15, 16, 99)], "chrom string, pos long")
    grid = spark.createDataFrame([("1", 10), ("1", 20)], "chrom string, pos long")
    assert {r.pos: r.grid_pos for r in conversions.nearest(rows, grid, width=7).collect()} == {5: 10, 10: 10, 14: 10, 15: 10, 16: 20, 99: 20}


def test_mixed_clusters(spark):
    alleles = [0, 1, 0, 1, 0, 0, 1, 1]  # haplotypes 0..7; 0..3 share a cluster
    rows = spark.createDataFrame([("1", 100, h, a) for h, a in enumerate(alleles)], "chrom string, pos long, hap long, allele int")
    labels = spark.createDataFrame([("1", 100, h, 0 if h < 4 else 1) for h in range(8)], "chrom string, pos long, hap long, cluster long")
    grid = spark.createDataFrame([("1", 100, 100)], "chrom string, pos long, grid_pos long")
    got = conversions.mixed_clusters(rows, labels, grid, 0.1).collect()
    assert [(r.cluster, r.n0, r.n1) for r in got] == [(0, 2, 2)] and [tuple(x) for x in got[0].haps0] == [(0, 0), (1, 0)]


def test_endpoint_model_is_sane():
    r = np.random.default_rng(3)
    n = 400
    pos, matrix = 5000 * np.arange(1, n + 1), r.integers(0, 2, size=(n, 6)).astype(np.int8)
    matrix[100:300, 1] = matrix[100:300, 0]
    morgans = pos * 1e-8
    back = endpoints.Background({}, np.sort(r.exponential(2e-4, 500)))
    estimator = endpoints.Estimator(pos, morgans, matrix, back, back, Parameters(min_ibd_cm=0.1, trim=0.0))
    first, cdf = estimator.fwd.end_distribution(estimator.fwd.differs(0, 1), morgans[100], pos[200], morgans[200])
    assert first == 201 and (np.diff(cdf) >= 0).all() and abs(cdf[-1] - 1) < 1e-12
    start, end = estimator.estimate(0, 1, int(pos[100]), int(pos[299]))
    assert abs(start - pos[100]) < 150_000 and abs(end - pos[299]) < 150_000
    assert endpoints.Estimator(pos, morgans, matrix, back, back, Parameters(min_ibd_cm=50)).estimate(0, 1, int(pos[100]), int(pos[299])) is None


def test_vcf_and_bref(spark, tmp_path):
    body = ["##fileformat=VCFv4.2", "\t".join([*text.FIXED, "a", "b", "c"]), "1\t10\trs1;x\tA\tC,G\t.\tPASS\tEND=5\tGT:DP\t0|1:3\t2|2:1\t1", "", "1\t20\t.\tA\t.\t.\tPASS\t.\tGT\t0|0\t0|0\t0"]
    path = tmp_path / "x.vcf"
    path.write_text("\n".join(body) + "\n")
    got = text.read_vcf(spark, str(path), {"b"}).orderBy("pos").collect()
    assert [(r.pos, r.n_alleles, r.alleles, r.m) for r in got] == [(10, 3, [0, 1, 1, 1], 0), (20, 1, [0, 0, 0, 0], 1)]
    for bad in ("0/1", "0|7", ".|."):
        path.write_text("\n".join(body[:2]) + f"\n1\t10\t.\tA\tC\t.\t.\t.\tGT\t0|1\t{bad}\t0|0\n")
        with pytest.raises(Exception, match="unphased, missing or bad allele"):
            text.read_vcf(spark, str(path)).collect()
    records = [(5, "rs1", "A", "C", [0, 1, 1, 0]), (9, ".", "A", "C,T", [2, 0, 1, 2])]
    assert [(x[1], x[2], x[4], x[6]) for x in bref.decode(bref.encode("7", ["a", "b"], records))] == [(5, "rs1", "C", [0, 1, 1, 0]), (9, ".", "C,T", [2, 0, 1, 2])]
    (tmp_path / "m.map").write_text("1 . 0.0 10\n1 . 1.5 2000\n")
    assert sorted(map(tuple, text.read_map(spark, str(tmp_path / "m.map")).collect())) == [("1", 10, 0.0), ("1", 2000, 1.5)]
    (tmp_path / "ids").write_text("a\n\n b \n")
    assert sorted(r.name for r in text.read_ids(spark, str(tmp_path / "ids")).collect()) == ["a", "b"]


def _plain_end(pos, morgans, differs, back, par, start_m, focus_pos, focus_m, p):
    """(base position, Morgans) of a quantile of the end, marker by marker; the last marker is the one past the end."""
    n = len(pos) - 1
    f = lambda y: 1 - 1 / (2 * par.ne * math.expm1(2 * y) + 1)
    s = next((m for m in range(n) if pos[m] > focus_pos), n)
    following = lambda m: next(k for k in range(m, n + 1) if k == n or differs[k])
    cdf, factor, before, start = {s - 1: 0.0}, 1.0, f(focus_m - start_m), s
    nd = following(start)
    gate = pos[nd] + par.gc_bases
    while True:
        for m in range(start, nd + 1):
            now = f(morgans[m] - start_m)
            cdf[m] = cdf[m - 1] + (now - before) * back(m, nd) * factor
            before = now
        end = nd + 1
        if end == n + 1 or cdf[end - 1] - cdf[start - 1] < np.float32(par.min_cdf_ratio) * cdf[end - 1]:
            break
        start = end
        nd = following(start)
        error = np.float32(par.gc_discord)
        if pos[nd] >= gate:
            error, gate = np.float32(par.discord), pos[nd] + par.gc_bases
        factor *= float(error) / back(start, nd)
    share = {m: c / cdf[end - 1] for m, c in cdf.items()}
    at = next((m for m in range(s, end) if share[m] >= p), end - 1)
    if at == n:
        return pos[n], morgans[n - 1]
    x1, x2 = focus_m if at == s else morgans[at - 1], morgans[at]
    pp = f(x1 - start_m) + (p - share[at - 1]) / (share[at] - share[at - 1]) * (f(x2 - start_m) - f(x1 - start_m))
    d = 2 * par.ne * (1 - pp)
    x = start_m + 0.5 * math.log((pp + d) / d)
    y1 = focus_pos + 1 if at == s else pos[at - 1]
    return round(y1 + min(max((x - x1) / (x2 - x1), 0), 1) * (pos[at] - y1)), x


def test_endpoints_agree_with_a_plain_form_segment_by_segment():
    r = np.random.default_rng(9)
    n, kept, dropped = 150, 0, 0
    for turn in range(8):
        pos = np.cumsum(r.integers(500, 9000, n))
        morgans = np.cumsum(r.integers(500, 9000, n)) * 1e-8
        matrix = r.integers(0, 2, size=(n, 8)).astype(np.int8)
        for a, b in ((0, 1), (2, 3), (4, 5)):
            lo = int(r.integers(10, 40))
            matrix[lo : lo + 80, b] = matrix[lo : lo + 80, a]
            matrix[lo + 30, b] ^= turn % 2  # a gene conversion or error inside
        stored = lambda: {m: r.random(int(r.integers(1, 6))).astype(np.float32) * 0.4 + 0.05 for m in range(0, n, 2)}
        lengths = np.sort(r.exponential(3e-4, 400))
        backs = [endpoints.Background(stored(), lengths) for _ in range(2)]
        par = Parameters(min_ibd_cm=0.01, trim=0.0005, fix_focus=turn % 3 == 0, max_its=2 + turn % 2, quantile=0.5 if turn < 4 else 0.2)
        model = endpoints.Estimator(pos, morgans, matrix, *backs, par)
        where = lambda x, pos=pos, morgans=morgans: float(np.interp(x, pos, morgans))
        sides = []
        for sign, b in ((1, backs[0]), (-1, backs[1])):
            p_, m_ = (pos, morgans) if sign > 0 else (-pos[::-1], -morgans[::-1])
            p_, m_ = np.append(p_, p_[-1]), np.append(m_, m_[-1] + 1.0)
            sides.append((p_.tolist(), m_.tolist(), lambda s, e, b=b, m_=m_: b(m_, s, e)))

        def plain(h1, h2, start, end, sides=sides, par=par, matrix=matrix, where=where):
            apart = matrix[:, h1] != matrix[:, h2]
            forward, backward = [*apart, True], [*apart[::-1], True]
            ahead = lambda low, focus, p: _plain_end(*sides[0][:2], forward, sides[0][2], par, where(low), focus, where(focus), p)
            behind = lambda high, focus, p: tuple(-x for x in _plain_end(*sides[1][:2], backward, sides[1][2], par, -where(high), -focus, -where(focus), p))
            low, high, focus, still = start, end, (start + end) // 2, 0
            for j in range(2 * par.max_its - 2):
                old = high if j % 2 == 0 else low
                new = (ahead(low, focus, float(np.float32(0.05))) if j % 2 == 0 else behind(high, focus, float(np.float32(0.05))))[0]
                was, now, moved = abs(old - focus), abs(new - focus), False
                if was > 0 and now > 0 and abs(now - was) / was > float(np.float32(0.1)):
                    a, b = (low, new) if j % 2 == 0 else (new, high)
                    mid = focus if par.fix_focus else min(max((a + b) // 2, start + 1), end - 1)
                    if a < mid < b:
                        low, high, focus, moved = a, b, mid, True
                still = 0 if moved else still + 1
                if still == 2:
                    break
            q = float(np.float32(par.quantile))
            return behind(high, focus, q)[1], ahead(low, focus, q)[1]

        for h1, h2 in itertools.combinations(range(8), 2):
            i = int(r.integers(20, 60))
            start, end = int(pos[i]), int(pos[i + int(r.integers(3, 50))])
            first, last = plain(h1, h2, start, end)
            trim = float(np.float32(0.01) * np.float32(par.trim))
            want = None if last - first < 0.01 * float(np.float32(par.min_ibd_cm)) or first + trim > last - trim else (model.to_pos(first + trim), model.to_pos(last - trim))
            assert model.estimate(h1, h2, start, end) == want
            kept, dropped = kept + (want is not None), dropped + (want is None)
    assert kept > 20 and dropped > 3
    with pytest.raises(ValueError, match="not inside the markers"):
        model.estimate(0, 1, int(pos[0]) - 1, int(pos[5]))


def test_records_with_missing_and_unphased_genotypes(spark):
    lines = ["##fileformat=VCFv4.2", "#CHROM\tx", "1\t10\trs1\tA\tC,G\t.\tPASS\tAN=9;END=5;AC=1\tGT:DP\t0|2:3\t./1:7\t1", "1\t20\t.\tA\t.\t.\tPASS\t.\tGT\t0/0\t0|0\t0"]
    rows = records.split(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = records.genotypes(rows).orderBy("pos").collect()
    assert [(r.n_alleles, r.alleles, r.phased) for r in got] == [(3, [0, 2, None, None, 1, 1], [True, False, True]), (1, [0, 0, 0, 0, 0, 0], [False, True, True])]
    assert [r.data for r in records.sample_data(rows, "DP").orderBy("pos").collect()] == [["3", "7", None], [None, None, None]]
    assert records.ploidy_faults(records.ploidy(rows)).count() == 0
    f = rows.select(F.col("f")[7].alias("info")).withColumn("a", F.array(F.lit(0), F.lit(2), F.lit(None), F.lit(1)))
    assert sorted(r[0] for r in f.select(records.with_counts(F.col("info"), F.col("a"), F.lit(3))).collect()) == ["AN=3;AC=1,1", "END=5;AN=3;AC=1,1"]
    with pytest.raises(Exception, match="bad chromosome"):
        records.marker_fields(spark.createDataFrame([(["a b", "1", ".", "A", "C"],)], "f array<string>")).collect()


def test_numbers_of_markers_and_samples(spark):
    rows = [("1", p, "A", "C") for p in (5, 2_000_005, 7, 1_000_001)] + [("2", 9, "A", "C"), ("2", 9, "A", "G")]
    got = panel.number_markers(spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string")).collect()
    assert sorted((r.chrom, r.m, r.pos, r.alt) for r in got) == [("1", 0, 5, "C"), ("1", 1, 7, "C"), ("1", 2, 1_000_001, "C"), ("1", 3, 2_000_005, "C"), ("2", 0, 9, "C"), ("2", 1, 9, "G")]
    assert sorted(map(tuple, panel.numbered(spark.createDataFrame([(9,), (3,), (70,)], "k long"), "k", "i", 5).select("k", "i").collect())) == [(3, 0), (9, 1), (70, 2)]
    with pytest.raises(ValueError, match="no records"):
        panel.some_in_interval(spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string"), parse_interval("3"))


def test_bref_files_by_sample(spark, tmp_path):
    (tmp_path / "a.bref3").write_bytes(bref.encode("7", ["a", "b"], [(5, "rs1", "A", "C", [0, 1, 1, 0])]))
    assert bref.bref_samples(spark, str(tmp_path / "a.bref3")) == ["a", "b"]
    assert [r.alleles for r in bref.read_bref(spark, str(tmp_path / "a.bref3"), {"a"}).collect()] == [[1, 0]]
    (tmp_path / "bad.vcf").write_text("##x\n#odd\n" + "\t".join([*text.FIXED, "a"]) + "\n1\t1\t.\tA\tC\t.\t.\t.\tGT\t0|1\n")
    with pytest.raises(ValueError, match="bad header line"):
        text.vcf_samples(spark, str(tmp_path / "bad.vcf"))


def test_whole_run_finds_a_planted_segment(spark, tmp_path):
    r = np.random.default_rng(11)
    n, haps = 240, 20
    matrix = r.integers(0, 2, size=(n, haps))
    matrix[:, 7] = matrix[:, 2]  # one pair shares everything
    head = ["##fileformat=VCFv4.2", "\t".join([*text.FIXED, *(f"s{i}" for i in range(haps // 2))])]
    rows = ["\t".join(["1", str(10_000 * (m + 1)), f"rs{m}", "A", "C", ".", ".", ".", "GT", *(f"{matrix[m, 2 * s]}|{matrix[m, 2 * s + 1]}" for s in range(haps // 2))]) for m in range(n)]
    (tmp_path / "p.vcf").write_text("\n".join(head + rows) + "\n")
    (tmp_path / "p.map").write_text(f"1 . 0.0 10000\n1 . {0.01 * n} {10_000 * n}\n")
    stats = run(spark, Parameters(gt=str(tmp_path / "p.vcf"), map=str(tmp_path / "p.map"), out=str(tmp_path / "o"), global_loci=60, global_segments=200, min_ibs_cm=0.8, min_ibd_cm=0.5, out_cm=0.4, trim=0.1, pbwt=1))
    assert (stats["haplotypes"], stats["input VCF records"]) == (20, 240)
    assert spark.read.text(str(tmp_path / "o.log")).count() == len(stats)
    got = text.read_clusters(spark, str(tmp_path / "o.ibdclust")).toPandas()
    middle = got[(got.pos > 800_000) & (got.pos < 1_700_000)]
    together = middle[middle.hap == 2].set_index("pos").cluster.eq(middle[middle.hap == 7].set_index("pos").cluster)
    assert len(together) and together.all()


def test_window_counts_stream(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(2).write.parquet(f"{tmp_path}/in")
    batch = window_counts(source).toPandas()
    query = window_counts(spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    streamed = spark.table("counts").toPandas()
    key = ["start", "event_type"]
    pd.testing.assert_frame_equal(batch.sort_values(key, ignore_index=True)[[*key, "n"]], streamed.sort_values(key, ignore_index=True)[[*key, "n"]])


def test_java_random_in_bulk():
    for seed in (42, -99999, 7):
        for bound in (2, 3, 8, 500, 1 << 30, (1 << 30) + 1):
            one, many = JavaRandom(seed), JavaRandom(seed)
            assert one.next_double() == many.next_double()
            want = []
            for _ in range(300):
                a, b = one.next_int(bound), one.next_int(bound)
                while a == b:
                    b = one.next_int(bound)
                want.append((a, b))
            assert list(map(tuple, many.distinct_pairs(bound, 300).tolist())) == want


def test_blocks_of_positions_and_wide_alleles(spark):
    rows = spark.createDataFrame([("1", m, 10 * m * m + 5, [0, 300 if m == 3 else 1, 2]) for m in range(10)] + [("2", 0, 7, [1, 1, 0])], "chrom string, m long, pos long, alleles array<int>")
    blocks = haploblocks.blocks(rows, 4)
    got = {(r.chrom, r.m): haploblocks.alleles_of(bytes(r.row)).tolist() for r in blocks.collect()}
    assert got == {(r.chrom, r.m): r.alleles for r in rows.collect()}
    points = spark.createDataFrame([("1", x) for x in (-3, 5, 164, 165, 644, 645, 5000)] + [("2", 1), ("2", 9), ("3", 1)], "chrom string, at long")
    placed = haploblocks.block_of(points, "at", haploblocks.extents(blocks)).collect()
    assert sorted(map(tuple, placed)) == [("1", -3, 0), ("1", 5, 0), ("1", 164, 0), ("1", 165, 1), ("1", 644, 1), ("1", 645, 2), ("1", 5000, 2), ("2", 1, 0), ("2", 9, 0)]


def _recombining_panel(seed, n=150, haps=16):
    """Markers of haplotypes that copy each other in stretches, as ancestors' do."""
    r = np.random.default_rng(seed)
    founders = r.integers(0, 2, size=(n, 5))
    matrix = np.empty((n, haps), np.int64)
    for h in range(haps):
        at = 0
        while at < n:
            to = at + int(r.integers(10, 90))
            matrix[at:to, h] = founders[at:to, r.integers(5)]
            at = to
    flip = r.random(matrix.shape) < 0.004
    return np.where(flip, 1 - matrix, matrix)


@pytest.mark.parametrize("width", [7, 40, 1000])
def test_segments_over_windows_have_the_ends_of_the_whole_chromosome(spark, width):
    """Blocks smaller than segments hand them on; the ends are those of an estimator that has all markers."""
    matrix = _recombining_panel(2)
    matrix[:, 9] = matrix[:, 3]  # one pair shares the whole chromosome
    n, haps = matrix.shape
    par = Parameters(pbwt=1, min_ibs_cm=0.2, min_ibd_cm=0.05, trim=0.005, global_loci=40, global_segments=30, local_max_cdf=0.9)
    rows = [("1", m, 0.02 * m + 0.003 * (m % 5), 1000 * m + 13 * (m % 7) + 1, matrix[m].tolist()) for m in range(n)]
    wide = spark.createDataFrame(rows, "chrom string, m long, cm double, pos long, alleles array<int>")
    wide = wide.unionByName(wide.where("m < 3").withColumn("chrom", F.lit("2")))
    found = segments.merged(segments.match_segments_streamed(wide, par.min_ibs_cm, par.pbwt)).unionByName(spark.createDataFrame([("1", 0, 5, 40013, 60005)], wide_segments))
    got = sorted(tuple(x)[1:] for x in endpoints.refined(wide, found, "1", par, width).collect())

    first = rows[0][2]
    steps = np.maximum(np.diff([r[2] for r in rows]), 1e-6)
    x, pos = 0.01 * (first + np.concatenate(([0.0], steps)).cumsum()), np.array([r[3] for r in rows])
    counts = background.pair_counts(wide.where("chrom = '1'"), haps, par.local_max_cdf)
    last = wide.where("chrom = '1'").groupBy("chrom").agg(F.max("m").alias("last"))

    def stored(table):
        table = background.length_probabilities(table, haps, last).toPandas().sort_values(["m_start", "m_end"])
        return {m: g["prob"].to_numpy() for m, g in table.groupby("m_start")}

    x_rows = wide.where("chrom = '1'").drop("cm", "pos").join(spark.createDataFrame([(m, float(v)) for m, v in enumerate(x)], "m long, x double"), "m")
    draws = background.drawn(spark, "1", float(x[0]), float(x[-1]), haps, par.global_loci, par.global_segments, par.seed)
    lengths = background.one_sided_lengths(x_rows, draws, 33)
    usual = background.usual_loci(background.order_statistic(lengths, par.global_quantile), par.global_multiple)
    sampled = np.sort(lengths.join(usual, "locus", "left_semi").toPandas()["length"].to_numpy())
    backs = [endpoints.Background(stored(t), sampled) for t in (counts, background.reversed_counts(counts, n - 1))]
    whole = endpoints.Estimator(pos, x, matrix, *backs, par)
    want = []
    for s in found.where("chrom = '1'").collect():
        if ends := whole.estimate(s.hap1, s.hap2, s.start_pos, s.end_pos):
            want.append((s.hap1, s.hap2, *ends))
    assert got == sorted(want) and len(got) > 20
    with pytest.raises(ValueError, match="no markers"):
        endpoints.refined(wide, found, "7", par)


wide_segments = "chrom string, hap1 long, hap2 long, start_pos long, end_pos long"


@pytest.mark.parametrize("width", [3, 64])
def test_discordance_over_blocks_counts_every_marker(spark, width):
    matrix = _recombining_panel(4, 60, 8)
    rows = [("1", m, 100 * m + 3 * (m % 4), matrix[m].tolist()) for m in range(60)]
    wide = spark.createDataFrame(rows, "chrom string, m long, pos long, alleles array<int>")
    r = np.random.default_rng(1)
    found = [("1", int(a), int(b), int(s), int(s + d)) for a, b, s, d in zip(r.integers(0, 8, 200), r.integers(0, 8, 200), r.integers(-50, 6100, 200), r.integers(0, 3000, 200), strict=True)]
    got = segments.discordance(spark.createDataFrame(found, wide_segments), wide, width).first()
    inside = [[m for m in range(60) if s <= rows[m][2] <= e] for _, _, _, s, e in found]
    apart = sum(int(matrix[m, f[1]] != matrix[m, f[2]]) for f, own in zip(found, inside, strict=True) for m in own)
    assert (got.discord, got.checked) == (apart, sum(map(len, inside)))
    empty = segments.discordance(spark.createDataFrame([], wide_segments), wide, width).first()
    assert (empty.discord, empty.checked, empty.rate) == (0, 0, None)


@pytest.mark.parametrize("window,slice_rows", [(1, 1 << 20), (4, 5), (7, 1), (500, 1 << 20)])
def test_clusters_do_not_depend_on_windows_or_slices(spark, window, slice_rows):
    r = np.random.default_rng(6)
    found = [(str(r.integers(1, 3)), int(a), int(b), int(s), int(s + d)) for a, b, s, d in zip(r.integers(0, 12, 60), r.integers(0, 12, 60), r.integers(-5, 230, 60), r.integers(0, 160, 60), strict=True)]
    found += [("1", 3, 50, 0, 200), ("1", 50, 9, 0, 200), ("3", 1, 2, 0, 99)]  # 50 is no haplotype here; chromosome 3 has no positions
    points = spark.createDataFrame([("1", 10 * k) for k in range(20)] + [("2", 7 * k) for k in range(9)] + [("2", 7), ("4", 1)], "chrom string, pos long")
    haps = spark.range(11).withColumnRenamed("id", "hap")
    segs = spark.createDataFrame(found, wide_segments)
    got = segments.clusters(points, segs, haps, 50, window, slice_rows)
    want = segments.clusters_by_rounds(points, segs, haps, 50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert segments.clusters(points, segs.limit(0), haps, 50, window).groupBy("pos").agg(F.countDistinct("cluster").alias("n")).select("n").distinct().collect() == [(11,)]


def test_flagship_query_names_haplotypes_whose_ids_have_gaps(spark, tmp_path):
    from kinweave import queries

    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id not in (3, 50, 51)")
    source.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries._panel(spark, str(tmp_path))
    common = panel.common_markers(rows, 0.1, source.count()).count()
    assert common == 64  # then the flagship's clusters are those of the relational matches
    coords = rows.select("chrom", "m", "pos", "cm").distinct()
    found = segments.merged(segments.match_segments(rows, coords, 1.2))
    want = segments.clusters_by_rounds(queries._grid(spark), found, rows.select("hap").distinct(), 10_000)
    got = queries.haplotype_clusters(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("hap in (3, 50, 51)").count() == 0 and want.where("cluster < hap - 3").count() > 0


@pytest.mark.parametrize("block", [1, 4, 9, 25])
@pytest.mark.parametrize("step", [1, 3])
def test_prefix_orders_and_matches_do_not_depend_on_blocks(spark, block, step):
    """Blocks of 1 to all markers, with markers missing between them, over two chromosomes, against one stream."""
    r = np.random.default_rng(5)
    kept = sorted(r.choice(60, 25, replace=False).tolist())
    matrix = r.integers(0, 3, size=(25, 30)) * (r.random((25, 30)) < 0.5)
    matrix[:, 7] = matrix[:, 21]
    rows = [("1", m, 100 * m + 1, 0.01 * m, matrix[i].tolist()) for i, m in enumerate(kept)] + [("2", m, 5 * m + 1, 0.02 * m, matrix[m][::-1].tolist()) for m in range(5)]
    wide = spark.createDataFrame(rows, "chrom string, m long, pos long, cm double, alleles array<int>")
    orders, matches = [], []
    for chrom in ("1", "2"):
        own = [x for x in rows if x[0] == chrom]
        for j in range(step):
            some = [i for i, x in enumerate(own) if x[1] % step == j]
            order, div, begins = list(range(30)), [j] * 30, {j: own[some[0]][2:4]} if some else {}
            for k, i in enumerate(some):
                _, m, pos, cm, alleles = own[i]
                begins[m + 1] = own[min(i + 1, len(own) - 1)][2:4]
                after, since = [], []
                for x in sorted(set(alleles)):
                    top = m + 1
                    for h, d in zip(order, div, strict=True):
                        top = max(top, d)
                        if alleles[h] == x:
                            after.append(h)
                            since.append(top)
                            top = 0
                order, div = after, since
                orders += [(chrom, m, rank, h, d) for rank, (h, d) in enumerate(zip(order, div, strict=True))]
                ahead = own[some[k + 1]][4] if k + 1 < len(some) else None
                for a, b, d in zip(order[1:], order[:-1], div[1:], strict=True):
                    if d <= m and begins[d][1] <= cm - 0.05 and (ahead is None or ahead[a] != ahead[b]):
                        matches.append((chrom, min(a, b), max(a, b), begins[d][0], pos))
    assert sorted(map(tuple, segments.prefix_order_streamed(wide, step, block).collect())) == sorted(orders)
    assert sorted(map(tuple, segments.match_segments_streamed(wide, 0.05, step, block).collect())) == sorted(matches) and len(matches) > 20
    assert segments.match_segments_streamed(wide.limit(0), 0.05, step, block).count() == 0


def bgzf(content: bytes, size: int) -> bytes:
    """BGZF blocks of ``size`` bytes of text each, and the empty block that ends a file."""
    out = []
    for at in [*range(0, len(content), size), None]:
        text_ = b"" if at is None else content[at : at + size]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(text_) + deflate.flush()
        out.append(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 25 + len(body)) + body + struct.pack("<II", zlib.crc32(text_), len(text_)))
    return b"".join(out)


def _read_in_ranges(path, split):
    reader = located.LinesReader({"files": f"{path}\t{path.stat().st_size}", "split": str(split)})
    return [(at, v) for part in reader.partitions() for b in reader.read(part) for at, v in zip(b["at"].to_pylist(), b["value"].to_pylist(), strict=True)]


def test_lines_of_ranges_cut_anywhere_are_read_once(tmp_path):
    r = random.Random(3)
    content = "\n".join(r.choice(["", "a", "é" * r.randrange(40), "x" * r.randrange(300), "\x1f\u008b\x08\x04 no block"]) for _ in range(120)) + r.choice(["", "\n"])
    want = content.removesuffix("\n").split("\n")
    plain, blocks, stream = tmp_path / "a.txt", tmp_path / "a.bgz", tmp_path / "a.gz"
    plain.write_bytes(content.encode())
    stream.write_bytes(gzip.compress(content.encode()[:500]) + gzip.compress(content.encode()[500:]))
    for split in [*range(1, 60, 7), 100, 1000, 10**6]:
        got = _read_in_ranges(plain, split)
        assert [v for _, v in got] == want and [a for a, _ in got] == sorted({a for a, _ in got})
    for size in (1, 13, 64, 700, 10**5):
        blocks.write_bytes(bgzf(content.encode(), size))
        for split in (37, 64, 333, 5000, 10**6):
            got = _read_in_ranges(blocks, split)
            assert [v for _, v in got] == want and [a for a, _ in got] == sorted({a for a, _ in got})
    assert [v for _, v in _read_in_ranges(stream, 10)] == want
    for offset in range(0, 60):  # a line cut by a block at every offset
        line = "first line of some length\nsecond line that is a bit longer than it\nthird"
        blocks.write_bytes(bgzf(line.encode()[:offset], 100)[:-28] + bgzf(line.encode()[offset:], 100) if offset else bgzf(line.encode(), 100))
        assert [v for _, v in _read_in_ranges(blocks, 40)] == line.split("\n")
    blocks.write_bytes(bgzf(content.encode(), 64)[:-40])
    with pytest.raises(ValueError, match="bad block"):
        _read_in_ranges(blocks, 10**6)


def test_bgzf_variants_over_partitions_and_faults_of_file_order(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n" + "\t".join([*text.FIXED, "a", "b"]) + "\n"
    body = [f"{1 + k // 150}\t{100 + k}\trs{k}\tA\tC\t.\t.\t.\tGT\t{k % 2}|1\t{k // 2 % 2}|0" for k in range(300)]
    (tmp_path / "p.vcf").write_text(head + "\n".join(body) + "\n")
    (tmp_path / "p.vcf.gz").write_bytes(bgzf((head + "\n".join(body) + "\n").encode(), 400))
    lines = located.located_lines(spark, str(tmp_path / "p.vcf.gz"), 700)
    assert lines.rdd.getNumPartitions() >= 4
    want = sorted(map(tuple, text.read_vcf(spark, str(tmp_path / "p.vcf")).collect()), key=str)
    assert sorted(map(tuple, text.read_vcf(spark, str(tmp_path / "p.vcf.gz"), split=700).collect()), key=str) == want and len(want) == 300

    def fails(rows, message, split):
        (tmp_path / "bad.vcf").write_text(head + "\n".join(rows) + "\n")
        with pytest.raises(Exception, match=message):
            text.read_vcf(spark, str(tmp_path / "bad.vcf"), split=split).collect()

    for split in (150, 1 << 20):
        fails([*body[:5], body[200], body[6]], "chromosome 1 appears again after 2", split)
        fails([*body[:5], body[6].replace("0|1", "0")], "ploidy changes at 1:106", split)
    one = [x.replace("1|0", "1").replace("0|0", "0") for x in body]  # haploid throughout
    (tmp_path / "one.vcf").write_text(head + "\n".join(one) + "\n")
    assert {tuple(x.alleles[2:]) for x in text.read_vcf(spark, str(tmp_path / "one.vcf")).collect()} == {(0, 0), (1, 1)}


def test_bref_blocks_of_an_index_and_of_other_writers(spark, tmp_path):
    records = [(10 * k, f"rs{k}", "A", "C", [k % 2, 1, 0, k // 2 % 2]) for k in range(1, 31)]
    (tmp_path / "p.bref3").write_bytes(bref.encode("7", ["a", "b"], records, 4))
    path = str(tmp_path / "p.bref3")
    assert [(x[1], x[4]) for x in bref.decode((tmp_path / "p.bref3").read_bytes())] == [(r[0], r[3]) for r in records]
    got = bref.read_bref(spark, path)
    assert got.rdd.getNumPartitions() == 8 and sorted((r.pos, r.id, r.alleles) for r in got.collect()) == [(r[0], r[1], r[4]) for r in records]
    some = parse_interval("7:95-130")
    assert len(bref.blocks_of(spark, path, some)) == 2 and len(bref.blocks_of(spark, path)) == 8 and bref.blocks_of(spark, path, parse_interval("8")) == []
    assert sorted(r.pos for r in bref.read_bref(spark, path, {"a"}, some).collect()) == [100, 110, 120, 130]
    assert bref.read_bref(spark, path, None, parse_interval("8")).count() == 0

    # a file as other writers make it: two chromosomes, haplotypes that share a sequence, single-nucleotide codes, records of either kind
    utf = lambda x: struct.pack(">H", len(x)) + x.encode()
    strings = lambda xs: struct.pack(">i", len(xs)) + b"".join(map(utf, xs))
    head = struct.pack(">i", bref.MAGIC) + utf("another") + strings(["s1", "s2", "s3"])
    code = bref.PERMUTATIONS.index(("G", "A", "C", "T")) << 2
    one = struct.pack(">i", 3) + utf("1") + struct.pack(">H6H", 3, 0, 2, 1, 2, 0, 0)
    one += struct.pack(">iB", 100, 1) + utf("rs1") + struct.pack(">bb3B", code | 1, 0, 0, 1, 1)  # G, A; by sequence
    one += struct.pack(">iB", 150, 0) + struct.pack(">bb", code | 2, 1) + struct.pack(">i2i", 2, 1, 4) + struct.pack(">i", -1) + struct.pack(">ii", 1, 0)  # G, A, C; by allele, A is the rest
    one += struct.pack(">iB", 170, 2) + utf("x") + utf("y") + struct.pack(">b", -1) + strings(["AT", "A"]) + struct.pack(">ib3B", 171, 0, 1, 0, 0)
    two = struct.pack(">i", 1) + utf("2") + struct.pack(">H6H", 2, 0, 1, 0, 1, 0, 1) + struct.pack(">iB", 5, 0) + struct.pack(">bb2B", code | 3, 0, 3, 2)
    index = len(head) + len(one) + len(two) + 4
    tail = struct.pack(">i", 0) + strings(["1", "2"]) + struct.pack(">2i", 0, 1) + struct.pack(">qi", -len(head), 100) + struct.pack(">qi", -(len(head) + len(one)), 5) + struct.pack(">qq", bref.END, index)
    (tmp_path / "q.bref3").write_bytes(head + one + two + tail)
    want = [
        ("1", 100, "rs1", "G", "A", 2, [0, 1, 1, 1, 0, 0]), ("1", 150, ".", "G", "A,C", 3, [2, 0, 1, 1, 0, 1]), ("1", 170, "x;y", "AT", "A", 2, [1, 0, 0, 0, 1, 1]), ("2", 5, ".", "G", "A,C,T", 4, [3, 2, 3, 2, 3, 2]),
    ]
    assert sorted(map(tuple, bref.read_bref(spark, str(tmp_path / "q.bref3")).collect())) == want
    assert [tuple(x) for x in bref.decode((tmp_path / "q.bref3").read_bytes())] == want
    assert [r.alleles for r in bref.read_bref(spark, str(tmp_path / "q.bref3"), {"s1", "s3"}, parse_interval("2:1-9")).collect()] == [[3, 2]]
    (tmp_path / "cut.bref3").write_bytes(head + one)
    with pytest.raises(ValueError, match="no index"):
        bref.read_bref(spark, str(tmp_path / "cut.bref3"))


@pytest.mark.parametrize("block", [3, 8, 64])
def test_pair_counts_go_on_from_block_to_block(spark, block):
    matrix = _recombining_panel(8, 40, 9)
    matrix[:, 4] = matrix[:, 1]
    wide = spark.createDataFrame([("1", m, matrix[m].tolist()) for m in range(40)] + [("2", m, matrix[m][::-1].tolist()) for m in range(5)], "chrom string, m long, alleles array<int>")
    got = sorted(map(tuple, background.pair_counts(wide, 9, 0.9, block).collect()))
    want = []
    for chrom, own in (("1", matrix), ("2", matrix[:5, ::-1])):
        for a in range(len(own)):
            for b in range(a, len(own)):
                pairs = sum(bool((own[a : b + 1, x] == own[a : b + 1, y]).all()) for x in range(9) for y in range(9) if x != y)
                if pairs < math.ceil((1 - float(np.float32(0.9))) * 72):
                    break
                want.append((chrom, a, b, pairs))
    assert got == sorted(want)


def test_variants_of_many_samples_are_read_in_proportion(spark, tmp_path):
    names, rng = [f"s{i}" for i in range(6000)], np.random.default_rng(3)
    alleles = rng.integers(0, 2, (3, 12000))
    body = [f"1\t{10 + k}\t.\tA\tC\t.\t.\t.\tGT\t" + "\t".join(f"{a}|{b}" for a, b in row.reshape(-1, 2)) for k, row in enumerate(alleles)]
    (tmp_path / "many.vcf").write_text("\t".join([*text.FIXED, *names]) + "\n" + "\n".join(body) + "\n")
    began = time.time()
    every = text.read_vcf(spark, str(tmp_path / "many.vcf")).orderBy("m").collect()
    assert [r.alleles for r in every] == alleles.tolist()
    some = text.read_vcf(spark, str(tmp_path / "many.vcf"), set(names[1::3])).orderBy("m").collect()
    kept = alleles.reshape(3, -1, 2)[:, np.arange(6000) % 3 != 1].reshape(3, -1)
    assert [r.alleles for r in some] == kept.tolist()
    assert time.time() - began < 60  # work in the square of the samples took minutes


def test_orders_of_more_haplotypes_than_a_broadcast_may_name_are_not_broadcast(spark, tmp_path):
    from kinweave import queries, record_queries

    n, rng = 100_200, np.random.default_rng(5)
    x = rng.integers(0, 2, (2, n))
    pd.DataFrame({"vec_id": 3 * np.arange(n), "embedding": list((x.T - 0.5).astype(np.float32))}).to_parquet(tmp_path / "embeddings.parquet")
    found = record_queries.backward_order(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[hap#", plan) and re.search(r"SortMergeJoin \[hap#", plan)
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.toPandas().sort_values(["m", "rank"])
    one = np.argsort(x[1], kind="stable")
    zero = one[np.argsort(x[0][one], kind="stable")]
    assert got["m"].tolist() == [0] * n + [1] * n and got["hap"].tolist() == (3 * np.append(zero, one)).tolist()
    assert queries._haps(spark, str(tmp_path)) == n


def test_maps_of_more_bases_than_an_int_holds_are_read(spark, tmp_path):
    (tmp_path / "m.map").write_text("c0 . 0.5 10\nc0 . 2.4502509900001E7 4950001000\nc0 . 81.0 9000000000\n")
    assert sorted(map(tuple, text.read_map(spark, str(tmp_path / "m.map")).collect())) == [("c0", 10, 0.5), ("c0", 4950001000, 24502509.900001), ("c0", 9000000000, 81.0)]
    for bad in ("c0 . 1.0 1.5", "c0 . 1.0 99999999999999999999", "c0 . x 5", "c0 1.0 5"):
        (tmp_path / "bad.map").write_text(bad + "\n")
        with pytest.raises(Exception, match="bad map line"):
            text.read_map(spark, str(tmp_path / "bad.map")).collect()


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e12])
def test_maps_of_any_scale_are_looked_up_by_as_many_bins_as_they_have_knots(spark, scale):
    rng = np.random.default_rng(11)
    bp = np.sort(rng.choice(10**6, 200, replace=False)) * (1 if scale < 1 else 10**4)
    cm = np.cumsum(rng.random(200) ** 8) * scale  # most steps are tiny beside a few, and the first 20 are none
    cm[:20] = cm[0]
    knots = spark.createDataFrame([("1", int(b), float(c)) for b, c in zip(bp, cm)], "chrom string, bp long, cm double")
    at = np.concatenate((bp, rng.integers(bp[0], bp[-1], 300)))
    rows = spark.createDataFrame([("1", int(x), k) for k, x in enumerate(at)] + [("2", 5, -1)], "chrom string, pos long, n int")
    got = {r.n: r.cm for r in gmap.interpolate(rows, knots, "pos", "cm").collect()}
    want = np.interp(at, bp, cm)
    assert got.pop(-1) is None and all(math.isclose(got[k], w, rel_tol=1e-9) for k, w in enumerate(want))
    x = np.concatenate((cm[19:], rng.uniform(cm[0], cm[-1], 300)))
    back = spark.createDataFrame([("1", float(v), k) for k, v in enumerate(x)], "chrom string, cm double, n int")
    got = {r.n: r.bp for r in gmap.interpolate(back, knots, "cm", "bp", inverse=True).collect()}
    for k, v in enumerate(x[1:], 1):  # at the first step's place bases of many knots are equally right
        i = min(int(np.searchsorted(cm, v, side="right")) - 1, 198)
        exact = bp[i] + (v - cm[i]) / (cm[i + 1] - cm[i]) * (bp[i + 1] - bp[i])
        assert got[k] in (math.floor(exact + 0.5), math.floor(exact + 0.5 + 1e-6), math.floor(exact + 0.5 - 1e-6))


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_output_windows_are_ranges_of_positions(spark, block):
    ranges = [("1", -7, 25), ("2", 5, 5), ("3", 9, 8), ("4", 10, 19)]
    got = gmap.output_windows(spark.createDataFrame(ranges, "chrom string, low long, high long"), 10, -3, block).collect()
    plain = {}
    for chrom, low, high in ranges:
        for step in range(low, high + 1):
            plain.setdefault((chrom, (step + 3) // 10), []).append(step)
    assert sorted(map(tuple, got)) == sorted((*k, len(v), v[0], v[-1]) for k, v in plain.items())


def test_output_windows_of_more_positions_than_an_array_holds(spark, tmp_path):
    from kinweave import record_queries

    keys = [1, 9_000_001, 9_000_301]  # all of chromosome c0
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    low, high = (math.ceil(k * k * 1e-6 * 0.01 / 0.0002) for k in (keys[0], keys[-1]))
    found = record_queries.output_windows(spark, str(tmp_path)).agg(F.count("*"), F.sum("n"), F.min("first"), F.max("last"), F.countDistinct("window"), F.max("n")).first()
    assert high - low > 1 << 31
    assert tuple(found) == ((high - 1) // 500 - low // 500 + 1, high - low, low, high - 1, (high - 1) // 500 - low // 500 + 1, 500)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_sums_over_stabbed_segments_are_those_of_the_pairs(spark, width):
    rng = random.Random(width)
    value = lambda: rng.choice([None, rng.randint(-5, 9)])
    segs = [(rng.choice(["a", "b", None]), rng.choice([rng.randint(-40, 60), rng.randint(0, 5), None]), rng.choice([rng.randint(-40, 90), rng.randint(0, 9), None]), value()) for _ in range(300)]
    segs.append(("c", 5, 5, None))
    points = [(rng.choice(["a", "b", None]), k, rng.choice([rng.randint(-50, 100), rng.randint(0, 9), None])) for k in range(200)] + [("a", 7, 3), ("a", 7, 3), ("c", 500, 5), ("c", 501, 6), ("d", 502, 5)]
    p = spark.createDataFrame(points, "kind string, id int, pos long")
    s = spark.createDataFrame(segs, "kind string, start_pos long, end_pos long, value int")
    got = segments.stab_sums(p, s, width, ["value"], ["kind"]).collect()
    want = []
    for kind, k, pos in points:
        met = [v for c, a, b, v in segs if None not in (kind, pos, a, b) and c == kind and a <= pos <= b]
        held = [v for v in met if v is not None]
        want += [(kind, k, pos, len(met), sum(held) if held else None)] * bool(met)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and ("c", 500, 5, 1, None) in want


def test_stabbing_makes_no_pairs(spark, tmp_path):
    from kinweave import queries

    n = 60_000  # segments that lie over each other: 3.6e9 pairs
    spark.range(n).selectExpr("id event_id", "timestamp_seconds(1704067200 + id % 1000) ts", "id % 10 user_id", "'view' event_type", "100.0D value").write.parquet(f"{tmp_path}/events.parquet")
    found = queries.position_stabbing(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, .*_at#.*<=|Join Inner, .*pos#.*<=", plan)
    began = time.time()
    got = {r.event_id: (r.n, r.users) for r in found.where("event_id in (0, 500, 999, 59999)").collect()}
    assert got == {k: (60 * (k % 1000 + 1), sum(60 * (x % 10) for x in range(k % 1000 + 1))) for k in (0, 500, 999, 59999)}
    assert found.count() == n and time.time() - began < 60
