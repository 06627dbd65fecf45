"""Registered queries of the haplotype operators over the given tables, each with its DuckDB counterpart.

Adapters: a row of ``embeddings`` is a haplotype, a dimension a marker (allele = sign, pos = 1000 (m + 1),
cm = 0.1 (m + 1)); ``lineitem`` and ``events`` give positions, lengths and intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.genetics import coalescent_cdf, coalescent_quantile, recombination
from kinweave.operators import background, conversions, endpoints, gmap, panel, segments
from kinweave.plans.config import Parameters, parse_interval
from kinweave.plans.storage import Scratch
from kinweave.sources import bref, text

NE = 10000.0


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("hap"), F.posexplode("embedding").alias("m", "x"))
    rows = rows.withColumn("m", F.col("m").cast("long"))
    return rows.select(F.lit("1").alias("chrom"), "m", (1000 * (F.col("m") + 1)).alias("pos"), (0.1 * (F.col("m") + 1)).alias("cm"), "hap", (F.col("x") > 0).cast("int").alias("allele"))


PANEL = "panel as (select '1' as chrom, i - 1 as m, 1000 * i as pos, 0.1::double * i as cm, vec_id as hap, (embedding[i] > 0)::int as allele from embeddings, range(1, 65) t(i) where embedding is not null)"


def _haps(spark: SparkSession, sf: str) -> int:
    return _read(spark, sf, "embeddings").where("embedding is not null").count()


def allele_counts(spark, sf):
    return panel.allele_counts(_panel(spark, sf)).select("chrom", "m", "pos", "allele", "n")


def allele_freq(spark, sf):
    return panel.allele_frequencies(_panel(spark, sf)).select("chrom", "m", "allele", F.round("freq", 9).alias("freq"))


def major_allele(spark, sf):
    return panel.major_alleles(_panel(spark, sf)).select("chrom", "m", "major")


def mac_filter(spark, sf):
    return panel.common_markers(_panel(spark, sf), 0.46, _haps(spark, sf)).select("chrom", "m", "mac")


def sample_exclude(spark, sf):
    out = _read(spark, sf, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("sample"))
    return panel.without_samples(_panel(spark, sf), out).groupBy("chrom", "m").agg(F.count("*").alias("n"), F.sum(F.col("hap") * F.col("allele")).alias("weighted"))


def _markers(spark, sf):
    rows = _read(spark, sf, "part")
    return rows.select(F.concat(F.lit("c"), F.col("p_size") % 5).alias("chrom"), F.col("p_partkey").alias("m"), (F.col("p_partkey") * 10).alias("pos"), F.concat_ws(";", "p_name", "p_brand").alias("id"))


def _listed(spark, sf):
    brands = _read(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_brand").alias("name"))
    places = _read(spark, sf, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey") % 5, F.lit(":"), F.col("s_suppkey") * 10).alias("name"))
    return brands.where("name like '%1'").unionByName(places)


def marker_exclude(spark, sf):
    return panel.named_markers(_markers(spark, sf), _listed(spark, sf), True).select("chrom", "m", "pos")


def marker_include(spark, sf):
    return panel.named_markers(_markers(spark, sf), _listed(spark, sf), False).select("chrom", "m", "pos")


def region_filter(spark, sf):
    return panel.in_interval(_markers(spark, sf).select("chrom", "m", "pos"), parse_interval("c3:500-15000"))


def _gmap(spark, sf):
    """Knots at every hundredth order key: 1000 bases a key, centimorgans by its square."""
    rows = _read(spark, sf, "orders").where("o_orderkey % 100 = 1").select(F.col("o_orderkey").alias("k"))
    return rows.select(F.concat(F.lit("c"), F.pmod(F.floor(F.col("k") / 100), F.lit(3))).alias("chrom"), (F.col("k") * 1000).alias("bp"), (F.col("k") * F.col("k") * 1e-6).alias("cm"))


GMAP = "gmap as (select 'c' || ((o_orderkey // 100) % 3) as chrom, o_orderkey * 1000 as bp, o_orderkey * o_orderkey * 1e-6 as cm from orders where o_orderkey % 100 = 1)"


def _places(spark, sf):
    rows = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    return rows.select(F.concat(F.lit("c"), F.col("k") % 3).alias("chrom"), "k", "line", (F.col("k") * 1050 + F.col("line")).alias("pos"))


PLACES = "places as (select 'c' || (l_orderkey % 3) as chrom, l_orderkey as k, l_linenumber as line, l_orderkey * 1050 + l_linenumber as pos from lineitem)"


def map_bounds(spark, sf):
    return panel.within_map(_places(spark, sf), _gmap(spark, sf)).groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


def map_interpolate(spark, sf):
    return gmap.interpolate(_places(spark, sf), _gmap(spark, sf), "pos", "cm").select("chrom", "k", "line", F.round("cm", 7).alias("cm"))


def map_invert(spark, sf):
    rows = _places(spark, sf).withColumn("x", F.col("k") * F.col("k") * 1.1e-6)
    return gmap.interpolate(rows, _gmap(spark, sf), "x", "bp", inverse=True).select("chrom", "k", "line", "bp")


_ASOF = """ends as (select chrom, min(bp) fk, max(bp) lk, arg_min(cm, bp) fv, arg_max(cm, bp) lv from gmap group by chrom),
 lo as (select g.chrom, arg_min(g.bp, g.bp) k, arg_min(g.cm, g.bp) v from gmap g join ends e using (chrom) where g.cm >= e.fv + 5 group by g.chrom),
 hi as (select g.chrom, arg_max(g.bp, g.bp) k, arg_max(g.cm, g.bp) v from gmap g join ends e using (chrom) where g.cm <= e.lv - 5 group by g.chrom),
 edge as (select e.*, coalesce(lo.k, e.lk) lok, coalesce(lo.v, e.lv) lov, coalesce(hi.k, e.fk) hik, coalesce(hi.v, e.fv) hiv from ends e left join lo using (chrom) left join hi using (chrom)),
 knots as (select chrom, bp k0, cm v0, lead(bp) over w k1, lead(cm) over w v1 from gmap window w as (partition by chrom order by bp))"""


def _steps(spark, sf):
    rows = _gmap(spark, sf).select("chrom", (F.col("bp") / 1000).cast("long").alias("m"), F.col("bp").alias("pos"), "cm")
    return gmap.spaced(rows, 0.5)


def min_step_cm(spark, sf):
    return _steps(spark, sf).select("chrom", "m", F.round("cm_spaced", 6).alias("cm"))


def genetic_steps(spark, sf):
    return _steps(spark, sf).select("chrom", "m", F.round("step", 6).alias("step"))


def recomb_prob(spark, sf):
    return _steps(spark, sf).select("chrom", "m", F.round(recombination(0.04, F.col("step")), 9).alias("p"))


def mean_base_step(spark, sf):
    rows = _gmap(spark, sf).select("chrom", F.col("bp").alias("pos"), "cm")
    return gmap.mean_step(rows).select("chrom", F.round(F.col("step") * 1e6, 6).alias("step_mb"))


def coalescent_cdf_values(spark, sf):
    rows = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 1000).alias("y"))
    return rows.select("l_orderkey", "l_linenumber", F.round(coalescent_cdf(F.col("y"), NE), 9).alias("f"))


def coalescent_inv_values(spark, sf):
    rows = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_discount") + 0.01) / 2).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", F.round(coalescent_quantile(F.col("p"), NE) * 1e6, 6).alias("y"))


def _coords(rows):
    return rows.select("chrom", "m", "pos", "cm").distinct()


def _named(spark, sf, rows, *columns):
    """Places in ``alleles`` as haplotype names; one narrow row a haplotype is numbered.

    What comes out of a block is many times what went in, so Spark takes ``rows`` for small: the join is told never to broadcast them.
    """
    haps = _panel(spark, sf).where("m = 0").select("hap")
    haps = panel.numbered(haps, "hap", "i").select(F.col("hap").cast("long").alias("_h"), F.col("i").cast("long").alias("_i"))
    haps = F.broadcast(haps) if haps.limit(100_001).count() <= 100_000 else haps.hint("merge")
    for c in columns:
        rows = rows.join(haps, F.col(c) == F.col("_i")).withColumn(c, F.col("_h")).drop("_h", "_i")
    return rows


def pbwt_order(spark, sf):
    return _named(spark, sf, segments.prefix_order_streamed(background.wide(_panel(spark, sf))), "hap").select("chrom", "m", "rank", "hap")


def pbwt_divergence(spark, sf):
    return _named(spark, sf, segments.prefix_order_streamed(background.wide(_panel(spark, sf)), 2), "hap").select("chrom", "m", "hap", "divergence")


def _wide_coords(spark, sf):
    return background.wide(_panel(spark, sf)).select("chrom", "m", (1000 * (F.col("m") + 1)).alias("pos"), (0.1 * (F.col("m") + 1)).alias("cm"), "alleles")


def _matches(spark, sf, least, step):
    """Matches of the panel from one row a marker, by haplotype name (lower first)."""
    found = _named(spark, sf, segments.match_segments_streamed(_wide_coords(spark, sf), least, step), "hap1", "hap2")
    return found.select("chrom", "hap1", "hap2", "start_pos", "end_pos")


def ibs_segments(spark, sf):
    rows = _panel(spark, sf)
    return segments.match_segments(rows, _coords(rows), 1.0, 1)


def ibs_segments_streamed(spark, sf):
    return _matches(spark, sf, 1.0, 1)


def merge_segments(spark, sf):
    return segments.merged(_matches(spark, sf, 1.0, 4))


def _intervals(spark, sf):
    rows = _read(spark, sf, "events").select("user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start_pos"), F.floor(60 * F.col("value")).cast("long").alias("n"))
    return rows.select("user_id", "event_type", "start_pos", (F.col("start_pos") + F.greatest("n", F.lit(0))).alias("end_pos"))


INTERVALS = "intervals as (select user_id, event_type, floor(epoch(ts))::bigint as start_pos, floor(epoch(ts))::bigint + greatest(floor(60 * value)::bigint, 0) as end_pos from events)"


def merge_intervals(spark, sf):
    return segments.merged(_intervals(spark, sf), ["user_id"])


def position_stabbing(spark, sf):
    points = _read(spark, sf, "events").select("event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))
    found = segments.stab_sums(points, _intervals(spark, sf), 3600, ["user_id"], ["event_type"])
    return found.groupBy("event_type", "event_id").agg(F.sum("n").alias("n"), F.sum("user_id").alias("users"))


def _last(spark, sf):
    return _panel(spark, sf).groupBy("chrom").agg(F.max("m").alias("last"))


def ibs_pair_counts(spark, sf):
    return background.pair_counts(background.wide(_panel(spark, sf)), _haps(spark, sf))


def ibs_length_probs(spark, sf):
    found = background.length_probabilities(ibs_pair_counts(spark, sf), _haps(spark, sf), _last(spark, sf))
    return found.select("chrom", "m_start", "m_end", F.round(F.col("prob").cast("double"), 6).alias("prob"))


def reverse_counts(spark, sf):
    return background.reversed_counts(ibs_pair_counts(spark, sf), _last(spark, sf).first()["last"])


def _with_coordinates(spark, sf):
    return background.wide(_panel(spark, sf)).withColumn("x", 0.1 * (F.col("m") + 1))


def _lengths(spark, sf):
    """One-sided matches of each haplotype with the next one, at 16 places between markers."""
    n = _haps(spark, sf) - 1
    rows = spark.range(16 * n).select(F.floor(F.col("id") / n).cast("long").alias("locus"), (F.col("id") % n).alias("pair"))
    draws = rows.select(F.lit("1").alias("chrom"), "locus", (0.25 + 0.4 * F.col("locus")).alias("at"), "pair", F.col("pair").alias("hap1"), (F.col("pair") + 1).alias("hap2"))
    return background.one_sided_lengths(_with_coordinates(spark, sf), draws, 16, 1.0)


def ibs_lengths(spark, sf):
    return background.usual_loci(background.order_statistic(_lengths(spark, sf), 0.9), 3.0).select("locus", F.round("stat", 6).alias("stat"))


def global_ibs_ecdf(spark, sf):
    rows = _lengths(spark, sf).withColumn("length", F.round("length", 6))
    at = spark.range(1, 12).select(F.round(F.col("id") * 0.1, 6).alias("x"))
    return background.ecdf(rows, at).select(F.round("x", 6).alias("x"), F.round("cdf", 9).alias("cdf"))


def _grid(spark):
    return spark.range(6).select(F.lit("1").alias("chrom"), (10_000 * (F.col("id") + 1)).alias("pos"))


def _clusters(spark, sf):
    rows = _panel(spark, sf)
    return segments.clusters(_grid(spark), _matches(spark, sf, 1.2, 1), rows.where("m = 0").select("hap"), 10_000)


def ibd_clusters(spark, sf):
    return _clusters(spark, sf)


def cluster_counts(spark, sf):
    return _clusters(spark, sf).groupBy("chrom", "pos").agg(F.countDistinct("cluster").alias("sets"))


def cluster_sizes(spark, sf):
    sizes = _clusters(spark, sf).groupBy("chrom", "pos", "cluster").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


def discordance_rate(spark, sf):
    wide = Scratch(spark).keep(_wide_coords(spark, sf), "wide")
    found = segments.discordance(segments.match_segments_streamed(wide, 1.2, 4), wide, 16)
    return found.select("discord", "checked", F.round("rate", 9).alias("rate"))


def nearest_position_join(spark, sf):
    grid = _read(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey") % 3).alias("chrom"), (F.col("o_orderkey") * 1000).alias("pos"))
    return conversions.nearest(_places(spark, sf), grid).select("chrom", "k", "line", F.col("grid_pos").cast("long").alias("grid_pos"))


def _near_grid(spark, sf):
    return conversions.nearest(_coords(_panel(spark, sf)).select("chrom", "pos"), _grid(spark), width=10_000)


def cluster_allele_contingency(spark, sf):
    return conversions.contingency(_panel(spark, sf), _clusters(spark, sf), _near_grid(spark, sf))


def gene_conversions(spark, sf):
    found = conversions.mixed_clusters(_panel(spark, sf), _clusters(spark, sf), _near_grid(spark, sf), 0.1)
    return found.select("chrom", "pos", "cluster", "n0", "n1", *(F.array_join(F.transform(f"haps{k}", lambda x: F.concat_ws(":", x["ind"], x["h"])), " ").alias(f"haps{k}") for k in (0, 1)))


def haplotype_clusters(spark, sf):
    """The run end to end on the panel: filter, coordinates, streamed matches, merge, grid, components, labels.

    Matches stand in for estimated descent segments here; ``ibd_segments`` runs the endpoint model.
    """
    rows = _panel(spark, sf)
    kept = panel.common_markers(rows, 0.1, _haps(spark, sf)).select("chrom", "m")
    rows = rows.join(kept, ["chrom", "m"])
    wide = rows.groupBy("chrom", "m", "pos", "cm").agg(F.transform(F.sort_array(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"]).alias("alleles"))
    wide = Scratch(spark).keep(wide, "wide")
    found = _named(spark, sf, segments.merged(segments.match_segments_streamed(wide, 1.2, 1)), "hap1", "hap2")
    return segments.clusters(_grid(spark), found, rows.select("hap").distinct(), 10_000)


def ibd_segments(spark, sf):
    """Matches refined by the endpoint model; its background comes from the same panel."""
    par = Parameters(pbwt=1, min_ibs_cm=1.2)
    wide = Scratch(spark).keep(_with_coordinates(spark, sf).select("chrom", "m", F.col("x").alias("cm"), (1000 * (F.col("m") + 1)).alias("pos"), "alleles"), "wide")
    found = segments.merged(segments.match_segments_streamed(wide, par.min_ibs_cm, par.pbwt))
    refined = endpoints.refined(wide, found, "1", par, 16)
    return _named(spark, sf, refined, "hap1", "hap2").select("chrom", "hap1", "hap2", "start_pos", "end_pos")


def _wide_markers(spark, sf):
    rows = _panel(spark, sf).groupBy("chrom", "m", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("hap", "allele"))), lambda x: x["allele"]).alias("alleles"))
    fixed = {"id": F.concat(F.lit("rs"), "m"), "ref": F.lit("A"), "alt": F.lit("C"), "qual": F.lit("."), "filter": F.lit("PASS"), "info": F.lit("."), "n_alleles": F.lit(2)}
    return rows.withColumns(fixed).withColumn("pos", F.col("pos").cast("int")).withColumn("alleles", F.slice("alleles", F.lit(1), F.size("alleles") - F.size("alleles") % 2))


def _digest(rows):
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), "id", "ref", "alt", F.aggregate("alleles", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"))


def vcf_roundtrip(spark, sf):
    """The panel written as VCF and read again."""
    path = f"{Scratch(spark).root}/panel.vcf"
    n = _haps(spark, sf) // 2
    text.write_vcf(_wide_markers(spark, sf), [f"s{i}" for i in range(n)], path)
    return _digest(text.read_vcf(spark, path))


def bref3_roundtrip(spark, sf):
    """The panel encoded as binary reference files and decoded again."""
    n = _haps(spark, sf) // 2
    return _digest(bref.decoded_bref(bref.encoded_bref(_wide_markers(spark, sf), [f"s{i}" for i in range(n)], 16)))


def cluster_file_roundtrip(spark, sf):
    """Clusters written in the wide text form and read again."""
    path = f"{Scratch(spark).root}/clusters.gz"
    labelled = _clusters(spark, sf).withColumn("cm", F.col("pos") / 10000.0)
    text.write_clusters(labelled, [f"s{i}" for i in range(_haps(spark, sf) // 2)], path)
    return text.read_clusters(spark, path).select("chrom", "pos", "hap", "cluster")


_ORDER = f"""with {PANEL}, rows as (select p.chrom, p.m, p.hap, p.allele, p.pos, p.cm, (select 1) one,
 reverse(string_agg(q.allele::varchar, '' order by q.m)) prefix from panel p join panel q on q.hap = p.hap and q.m <= p.m and (p.m - q.m) % STEP = 0 group by p.chrom, p.m, p.hap, p.allele, p.pos, p.cm),
 nxt as (select r.*, n.allele nx from rows r left join panel n on n.hap = r.hap and n.m = r.m + STEP),
 ranked as (select *, row_number() over w - 1 as rank, lag(hap) over w prev, lag(nx) over w prev_nx, lag(prefix) over w before from nxt window w as (partition by m order by prefix, hap)),
 div as (select *, case when prev is null then m + 1 when list_position(d, true) is null then m % STEP else m - STEP * (list_position(d, true) - 1) + 1 end divergence
  from (select *, [prefix[i] <> before[i] for i in range(1, length(prefix) + 1)] d from ranked))"""
_SEGS = _ORDER + """, segs as (select d.chrom, least(d.hap, d.prev) hap1, greatest(d.hap, d.prev) hap2, s.pos start_pos, d.pos end_pos
 from div d join (select distinct m, pos, cm from panel) s on s.m = d.divergence where d.prev is not null and (d.nx is null or d.nx <> d.prev_nx) and s.cm <= d.cm - MINCM::double)"""
_LABELS = _SEGS + """, grid as (select '1' chrom, 10000 * (i + 1) pos from range(6) t(i)), edges as (select g.pos, hap1 a, hap2 b from segs join grid g on g.pos between start_pos and end_pos),
 sym as (select pos, a, b from edges union select pos, b, a from edges), haps as (select distinct hap from panel)"""


def _segs(step: int, least: float) -> str:
    return _SEGS.replace("STEP", str(step)).replace("MINCM", str(least))


_RANGES = f"""with recursive panel as (select * from ({PANEL.replace("panel as ", "", 1)}) p), n as (select count(distinct hap) n, max(m) last, ceil((1 - 0.9990000128746033) * count(distinct hap) * (count(distinct hap) - 1)) least from panel),
 s as (select m m_start, m m_end, hap, allele::varchar k from panel
  union all select x.m_start, x.m_end + 1, x.hap, x.k || p.allele from (select *, sum(c - 1) over (partition by m_start) pairs from (select *, count(*) over (partition by m_start, k) c from s)) x
  join panel p on p.hap = x.hap and p.m = x.m_end + 1 where x.pairs >= (select least from n)),
 counts as (select '1' chrom, m_start, m_end, sum(c * (c - 1))::bigint n_pairs from (select m_start, m_end, k, count(*) c from s group by all) group by all having sum(c * (c - 1)) >= (select least from n))"""
_LENGTHS = f"""with {PANEL}, h as (select *, dense_rank() over (order by hap) - 1 i from panel), places as (select k, 0.25::double + 0.4::double * k as here from range(16) t(k)),
 lens as (select k locus, a.i pair, case when here <= 0.5 * (0.1::double + 0.1::double * 64) then coalesce(min(case when a.allele <> b.allele and a.cm >= here then a.cm end), max(a.cm)) - here
  else here - coalesce(max(case when a.allele <> b.allele and a.cm <= here then a.cm end), min(a.cm)) end length
  from h a join h b on a.m = b.m and b.i = a.i + 1 cross join places group by k, here, a.i)"""
_MARK = "markers as (select 'c' || (p_size % 5) chrom, p_partkey m, p_partkey * 10 pos, p_name || ';' || p_brand id from part), names as (select p_brand name from part where p_partkey % 50 = 0 and p_brand like '%1' union select 'c' || (s_suppkey % 5) || ':' || (s_suppkey * 10) from supplier), hit as (select distinct m.chrom, m.m from markers m, unnest(list_append(string_split(id, ';'), chrom || ':' || pos)) t(x) where x <> '.' and x in (select name from names))"
_SPACED = f"with {GMAP}, steps as (select chrom, bp // 1000 as m, bp, cm, coalesce(greatest(cm - lag(cm) over w, 0.5), 0) step, first(cm) over w c0 from gmap window w as (partition by chrom order by bp))"


def _interpolated(place: str, x: str, k: str, v: str) -> str:
    return f"""case when {x} < fk then fv + ({x} - fk) / (lok - fk)::double * (lov - fv) when {x} = lk then lv when {x} > lk then lv + ({x} - lk) / (hik - lk)::double * (hiv - lv) else v0 + ({x} - k0) / (k1 - k0)::double * (v1 - v0) end"""


ORACLE_SQL = {
    "allele_counts": f"with {PANEL} select chrom, m, pos, allele, count(*) n from panel group by all",
    "allele_freq": f"with {PANEL} select chrom, m, allele, round(n / sum(n) over (partition by m), 9) freq from (select chrom, m, allele, count(*) n from panel group by all)",
    "major_allele": f"with {PANEL} select chrom, m, arg_max(allele, n * 2 - allele) major from (select chrom, m, allele, count(*) n from panel group by all) group by all",
    "mac_filter": f"with {PANEL}, c as (select chrom, m, least(sum(allele), count(*) - sum(allele))::bigint mac, count(*) n from panel group by all) select chrom, m, mac from c where mac >= ceil((0.46::float * n::float)::double)",
    "sample_exclude": f"with {PANEL}, kept as (select *, dense_rank() over (order by hap // 2) - 1 s from panel where hap // 2 not in (select c_custkey from customer where c_custkey % 7 = 0)) select chrom, m, count(*) n, sum((2 * s + hap % 2) * allele)::bigint weighted from kept group by all",
    "marker_exclude": f"with {_MARK} select chrom, m, pos from markers where (chrom, m) not in (select (chrom, m) from hit)",
    "marker_include": f"with {_MARK} select chrom, m, pos from markers where (chrom, m) in (select (chrom, m) from hit)",
    "region_filter": f"with {_MARK} select chrom, m, pos from markers where chrom = 'c3' and pos between 500 and 15000",
    "map_bounds": f"with {GMAP}, {PLACES} select chrom, count(*) n, min(pos) lo, max(pos) hi from places join (select chrom, min(bp) a, max(bp) b from gmap group by chrom) using (chrom) where pos between a and b group by chrom",
    "map_interpolate": f"with {GMAP}, {PLACES}, {_ASOF} select p.chrom, k, line, round({_interpolated('p', 'pos', 'bp', 'cm')}, 7) cm from places p join edge using (chrom) asof left join knots n on n.chrom = p.chrom and p.pos >= n.k0",
    "map_invert": f"with {GMAP}, places as (select 'c' || (l_orderkey % 3) as chrom, l_orderkey as k, l_linenumber as line, l_orderkey * l_orderkey * 1.1e-6 as x from lineitem), {_ASOF}, inv as (select chrom, fv fk, lv lk, fk fv, lk lv, lov lok, lok lov, hiv hik, hik hiv from edge), kn as (select chrom, v0 k0, v1 k1, k0 v0, k1 v1 from knots) select p.chrom, k, line, floor({_interpolated('p', 'x', 'cm', 'bp')} + 0.5)::bigint bp from places p join inv using (chrom) asof left join kn n on n.chrom = p.chrom and p.x >= n.k0",
    "min_step_cm": f"{_SPACED} select chrom, m, round(c0 + sum(step) over (partition by chrom order by bp), 6) cm from steps",
    "genetic_steps": f"{_SPACED} select chrom, m, round(step, 6) step from steps",
    "recomb_prob": f"{_SPACED} select chrom, m, round(1 - exp(-0.04 * step), 9) p from steps",
    "mean_base_step": f"with {GMAP} select chrom, round(greatest((arg_max(cm, bp) - arg_min(cm, bp)) / (max(bp) - min(bp)), 1e-8) * 1e6, 6) step_mb from gmap group by chrom",
    "coalescent_cdf": "select l_orderkey, l_linenumber, round(1 - 1 / (20000 * (exp(2 * l_quantity / 1000) - 1) + 1), 9) f from lineitem",
    "coalescent_inv": "select l_orderkey, l_linenumber, round(0.5 * ln((p + 20000 * (1 - p)) / (20000 * (1 - p))) * 1e6, 6) y from (select *, (l_discount + 0.01) / 2 p from lineitem)",
    "pbwt_order": _ORDER.replace("STEP", "1") + " select chrom, m, rank, hap from ranked",
    "pbwt_divergence": _ORDER.replace("STEP", "2") + " select chrom, m, hap, divergence from div",
    "ibs_segments": _segs(1, 1.0) + " select * from segs",
    "ibs_segments_streamed": _segs(1, 1.0) + " select * from segs",
    "merge_segments": _segs(4, 1.0) + " select chrom, hap1, hap2, min(start_pos) start_pos, max(end_pos) end_pos from (select *, sum(f) over (partition by hap1, hap2 order by start_pos, end_pos rows unbounded preceding) isle from (select *, case when start_pos <= lag(end_pos) over (partition by hap1, hap2 order by start_pos, end_pos) then 0 else 1 end f from segs)) group by chrom, hap1, hap2, isle",
    "merge_intervals": f"with {INTERVALS} select user_id, min(start_pos) start_pos, max(end_pos) end_pos from (select *, sum(f) over (partition by user_id order by start_pos, end_pos rows unbounded preceding) isle from (select *, case when start_pos <= lag(end_pos) over (partition by user_id order by start_pos, end_pos) then 0 else 1 end f from intervals)) group by user_id, isle",
    "position_stabbing": f"with {INTERVALS} select p.event_type, p.event_id, count(*) n, sum(i.user_id)::bigint users from (select event_type, event_id, floor(epoch(ts))::bigint pos from events) p join intervals i on i.event_type = p.event_type and p.pos between i.start_pos and i.end_pos group by all",
    "ibs_pair_counts": f"{_RANGES} select * from counts",
    "ibs_length_probs": f"{_RANGES} select chrom, m_start, m_end, round(((coalesce(lag(n_pairs) over (partition by m_start order by m_end), n * (n - 1)) - n_pairs + 1) / (n * (n - 1) + 1)::double)::float::double, 6) prob from counts, n union all select chrom, m_start, m_end + 1, round(((n_pairs + 1) / (n * (n - 1) + 1)::double)::float::double, 6) from counts, n where m_end = last",
    "reverse_counts": f"{_RANGES} select chrom, last - m_end as m_start, last - m_start as m_end, n_pairs from counts, n",
    "ibs_lengths": f"{_LENGTHS}, stat as (select locus, length stat from (select *, row_number() over (partition by locus order by length, pair) - 1 r, count(*) over (partition by locus) n from lens) where r = floor(0.8999999761581421 * n)) select locus, round(stat, 6) stat from stat where stat <= 3 * (select median(stat) from stat)",
    "global_ibs_ecdf": f"{_LENGTHS}, l as (select round(length, 6) x from lens), n as (select count(*) n from l) select q.x, round(least(greatest((select count(*) from l where l.x <= q.x) / n, 1 / n), (n - 1) / n), 9) cdf from (select round(i * 0.1, 6) x from range(1, 12) t(i)) q, n",
    "discordance_rate": _segs(4, 1.2) + " select sum((a.allele <> b.allele)::int)::bigint discord, count(*) checked, round(sum((a.allele <> b.allele)::int) / count(*), 9) rate from segs s join panel a on a.hap = s.hap1 and a.pos between s.start_pos and s.end_pos join panel b on b.hap = s.hap2 and b.m = a.m",
    "nearest_position_join": f"with {PLACES}, grid as (select 'c' || (o_orderkey % 3) chrom, o_orderkey * 1000 pos from orders) select chrom, k, line, (case when nx is null or (pv is not null and pos - pv <= nx - pos) then pv else nx end)::bigint grid_pos from (select p.*, a.pos pv, b.pos nx from places p asof left join grid a on a.chrom = p.chrom and p.pos >= a.pos asof left join grid b on b.chrom = p.chrom and p.pos <= b.pos)",
}
_COMPONENTS = _LABELS.replace("STEP", "1").replace("MINCM", "1.2").replace("with panel", "with recursive panel", 1) + """, reach as (select pos, a as hap, a as lab from sym union select r.pos, s.b, r.lab from reach r join sym s on s.pos = r.pos and s.a = r.hap and s.b > r.lab),
 roots as (select g.pos, h.hap, coalesce(min(r.lab), h.hap) root from grid g cross join haps h left join reach r on r.pos = g.pos and r.hap = h.hap group by g.pos, h.hap),
 labels as (select '1' chrom, pos, hap, dense_rank() over (partition by pos order by root) - 1 as cluster from roots)"""
_ONES = f"with {PANEL} select chrom, pos, 'rs' || m id, 'A' as ref, 'C' alt, sum(allele)::bigint ones from panel where hap < (select count(*) // 2 * 2 from embeddings) group by all"
ORACLE_SQL |= {
    "vcf_roundtrip": _ONES,
    "bref3_roundtrip": _ONES,
    "ibd_clusters": _COMPONENTS + " select chrom, pos, hap, cluster from labels",
    "haplotype_clusters": _COMPONENTS + " select chrom, pos, hap, cluster from labels",
    "cluster_file_roundtrip": _COMPONENTS + " select chrom, pos, hap, cluster from labels",
    "cluster_counts": _COMPONENTS + " select chrom, pos, count(distinct cluster) sets from labels group by all",
    "cluster_sizes": _COMPONENTS + " select size, count(*) n from (select pos, cluster, count(*) size from labels group by all) group by all",
    "cluster_allele_contingency": _COMPONENTS + ", near as (select m, arg_min(g.pos, abs(g.pos - p.pos) * 1000000 + g.pos) gp from (select distinct m, pos from panel) p, grid g group by m) select p.chrom, p.pos, l.cluster, p.allele, count(*) n from panel p join near using (m) join labels l on l.pos = gp and l.hap = p.hap group by all",
    "gene_conversions": _COMPONENTS + """, near as (select m, arg_min(g.pos, abs(g.pos - p.pos) * 1000000 + g.pos) gp from (select distinct m, pos from panel) p, grid g group by m),
 used as (select m from (select m, allele, count(*) n from panel group by all) group by m having count(*) > 1 and 1 - max(n) / sum(n) >= 0.1),
 person as (select m, hap // 2 ind, min(allele) = max(allele) hom from panel group by all),
 part as (select p.pos, l.cluster, p.allele, count(*) n, bool_and(hom) hom, string_agg((p.hap // 2) || ':' || (p.hap % 2), ' ' order by p.hap) haps from panel p join used using (m) join person e on e.m = p.m and e.ind = p.hap // 2
  join near on near.m = p.m join labels l on l.pos = near.gp and l.hap = p.hap group by p.pos, l.cluster, p.allele)
 select '1' chrom, a.pos, a.cluster, a.n n0, b.n n1, a.haps haps0, b.haps haps1 from part a join part b on a.pos = b.pos and a.cluster = b.cluster and a.allele = 0 and b.allele = 1
 where a.n + b.n >= 4 and a.n >= 2 and b.n >= 2 and not (a.hom and b.hom)""",
}

QUERIES = {
    "haplotype_clusters": haplotype_clusters, "allele_counts": allele_counts, "allele_freq": allele_freq, "major_allele": major_allele, "mac_filter": mac_filter,
    "sample_exclude": sample_exclude, "marker_exclude": marker_exclude, "marker_include": marker_include, "region_filter": region_filter,
    "map_bounds": map_bounds, "map_interpolate": map_interpolate, "map_invert": map_invert, "min_step_cm": min_step_cm, "genetic_steps": genetic_steps,
    "recomb_prob": recomb_prob, "mean_base_step": mean_base_step, "coalescent_cdf": coalescent_cdf_values, "coalescent_inv": coalescent_inv_values,
    "pbwt_order": pbwt_order, "pbwt_divergence": pbwt_divergence, "ibs_segments": ibs_segments, "ibs_segments_streamed": ibs_segments_streamed,
    "merge_segments": merge_segments, "merge_intervals": merge_intervals, "position_stabbing": position_stabbing, "ibs_pair_counts": ibs_pair_counts,
    "ibs_length_probs": ibs_length_probs, "reverse_counts": reverse_counts, "ibs_lengths": ibs_lengths, "global_ibs_ecdf": global_ibs_ecdf,
    "ibd_clusters": ibd_clusters, "cluster_counts": cluster_counts, "cluster_sizes": cluster_sizes, "discordance_rate": discordance_rate,
    "nearest_position_join": nearest_position_join, "cluster_allele_contingency": cluster_allele_contingency, "gene_conversions": gene_conversions,
    "ibd_segments": ibd_segments, "vcf_roundtrip": vcf_roundtrip, "bref3_roundtrip": bref3_roundtrip, "cluster_file_roundtrip": cluster_file_roundtrip,
}
