"""Registered queries of record sources, list operations and scalar functions, each with its DuckDB counterpart.

Adapters: haplotypes 2 s and 2 s + 1 of the panel are sample s of a variant file that Spark writes as lines, with
half-missing, unphased and (if their number is odd, for the last sample) haploid genotypes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave import queries as base
from kinweave.functions.genetics import genotype_count, half_up
from kinweave.operators import background, gmap, panel, segments
from kinweave.plans.config import parse_interval
from kinweave.plans.storage import Scratch
from kinweave.sources import records, text


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    wide = background.wide(base._panel(spark, sf))

    def sample(s: Column) -> Column:
        one, two, k = F.get("alleles", 2 * s), F.get("alleles", 2 * s + 1), (s + F.col("m")).cast("int")
        gt = F.concat(F.when(k % 11 == 0, ".").otherwise(one.cast("string")), F.when(k % 5 == 0, "/").otherwise("|"), two.cast("string"))
        gt = F.when(two.isNull(), one.cast("string")).otherwise(gt)
        return F.when(k % 13 == 0, gt).otherwise(F.concat_ws(":", gt, ((s * 7 + F.col("m")) % 50).cast("string"), F.lit("9")))

    samples = F.transform(F.sequence(F.lit(0), F.floor((F.size("alleles") - 1) / 2).cast("int")), sample)
    info = F.concat(F.lit("AN=5;DP="), F.col("m"), F.lit(";AC=1;END="), 1000 * F.col("m") + 1010)
    fixed = [F.lit("1"), (1000 * (F.col("m") + 1)).cast("string"), F.concat(F.lit("rs"), F.col("m")), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), info, F.lit("GT:DP:GQ")]
    return wide.select(F.concat_ws("\t", *fixed, F.array_join(samples, "\t")).alias("value"))


_SAMPLES = f"""{base.PANEL}, h as (select *, dense_rank() over (order by hap) - 1 i from panel),
 g as (select m, pos, i // 2 s, max(case when i % 2 = 0 then allele end) a, max(case when i % 2 = 1 then allele end) b from h group by all),
 v as (select *, b is null haploid, (s + m) % 11 = 0 and b is not null half, (s + m) % 5 = 0 and b is not null slash from g)"""


def vcf_any_genotypes(spark, sf):
    rows = records.genotypes(records.split(_lines(spark, sf)))
    called, ones = F.filter("alleles", lambda a: a.isNotNull()), F.filter("alleles", lambda a: a == 1)
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), "id", F.size(called).cast("long").alias("called"), F.size(ones).cast("long").alias("ones"), F.size(F.filter("phased", lambda p: p)).cast("long").alias("phased"))


def format_field(spark, sf):
    rows = records.sample_data(records.split(_lines(spark, sf)), "DP")
    values = F.filter("data", lambda x: x.isNotNull())
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), F.size(values).cast("long").alias("n"), F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"))


def sample_ploidy(spark, sf):
    rows = records.ploidy(records.split(_lines(spark, sf)))
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), F.size(F.filter("diploid", lambda d: d)).cast("long").alias("diploid"), F.size("diploid").cast("long").alias("samples"))


def info_counts(spark, sf):
    rows = records.genotypes(records.split(_lines(spark, sf)).withColumn("info", F.col("f")[7]), "info")
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), records.with_counts(F.col("info"), F.col("alleles"), F.col("n_alleles")).alias("info"), records.info_end(F.col("info")).cast("long").alias("end_pos"))


def _variants(spark, sf):
    """Markers of ``part``: up to four alleles by size."""
    rows = base._read(spark, sf, "part")
    alt = F.when(F.col("p_size") % 4 == 0, ".").when(F.col("p_size") % 4 == 1, "C").when(F.col("p_size") % 4 == 2, "C,G").otherwise("C,G,T")
    return rows.select(F.concat(F.lit("c"), F.col("p_size") % 5).alias("chrom"), F.col("p_partkey").alias("m"), (F.col("p_partkey") * 10).alias("pos"), F.concat_ws(";", "p_name", "p_brand").alias("id"), F.lit("A").alias("ref"), alt.alias("alt"))


_VARIANTS = "variants as (select 'c' || (p_size % 5) chrom, p_partkey m, p_partkey * 10 pos, p_name || ';' || p_brand id, 'A' as ref, case p_size % 4 when 0 then '.' when 1 then 'C' when 2 then 'C,G' else 'C,G,T' end alt, case p_size % 4 when 0 then 1 else p_size % 4 + 1 end n_alleles from part)"


def marker_fields(spark, sf):
    rows = _variants(spark, sf).select(F.array(F.col("chrom"), F.col("pos").cast("string"), F.col("id"), F.col("ref"), F.col("alt")).alias("f"))
    rows = records.marker_fields(rows)
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), "n_alleles", records.coordinate(F.col("chrom"), F.col("pos")).alias("place"), records.coordinate_and_alleles(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("name"))


def marker_order(spark, sf):
    rows = _variants(spark, sf).withColumn("pos", F.col("pos") % 500)
    by = Window.partitionBy("chrom").orderBy("pos", "ref", "alt", "m")
    return rows.select("chrom", "m", (F.row_number().over(by) - 1).cast("long").alias("place"))


def running_totals(spark, sf):
    return panel.running_totals(_variants(spark, sf).withColumn("n_alleles", records.n_alleles(F.col("alt"))))


def include_exclude(spark, sf):
    names = base._read(spark, sf, "part").select(F.col("p_brand").alias("name"))
    return panel.included(base._markers(spark, sf), names.where("name like '%1' or name like '%2'"), names.where("name like '%#1%'")).select("chrom", "m", "pos")


def marker_restrict(spark, sf):
    rows = base._panel(spark, sf)
    return panel.restricted(rows, 8, 20).unionByName(panel.restricted(rows, only=[1, 40, 63])).groupBy("chrom", "m").agg(F.count("*").alias("n"), F.sum("allele").alias("ones"))


def interval_scan(spark, sf):
    return panel.some_in_interval(base._markers(spark, sf).select("chrom", "m", "pos"), parse_interval("c1:100-"))


def monomorphic_markers(spark, sf):
    return panel.monomorphic(base._panel(spark, sf).withColumn("allele", F.when(F.col("m") % 3 == 0, 0).otherwise(F.col("allele")))).select("chrom", "m", "monomorphic")


def chromosome_runs(spark, sf):
    rows = base._read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.floor(F.sqrt(F.col("o_orderkey"))) % 7).alias("chrom"))
    return records.reappearing(rows, "o_orderkey").select("chrom", F.col("runs").cast("long").alias("runs"))


def identity_map(spark, sf):
    return gmap.identity(base._places(spark, sf)).select("chrom", "k", "line", F.round("cm", 9).alias("cm"))


def map_chromosome(spark, sf):
    return gmap.of_chromosome(base._gmap(spark, sf), "c2").select("chrom", "bp", F.round("cm", 6).alias("cm"))


def map_file_roundtrip(spark, sf):
    """The map written in its four-column text form and read again."""
    path = f"{Scratch(spark).root}/plink.map"
    base._gmap(spark, sf).select(F.concat_ws(" ", "chrom", F.lit("."), F.round("cm", 6), "bp")).write.text(path, compression="gzip")
    return text.read_map(spark, path).select("chrom", F.col("bp").cast("long").alias("bp"), F.round("cm", 6).alias("cm"))


def id_list_roundtrip(spark, sf):
    """Names one to a line, with blanks and repeats, read as a set."""
    path = f"{Scratch(spark).root}/ids"
    base._read(spark, sf, "part").select(F.concat(F.lit("  "), F.replace("p_brand", F.lit(" "), F.lit("_")), F.lit(" "))).write.text(path)
    return text.read_ids(spark, path)


def variant_lines_roundtrip(spark, sf):
    """Lines written compressed and read again: how many there are and what they hold."""
    path = f"{Scratch(spark).root}/lines"
    _lines(spark, sf).write.text(path, compression="gzip")
    return text.lines(spark, path).agg(F.count("*").alias("n"), F.sum(F.length(F.substring_index("value", "GT:DP:GQ", 1))).alias("chars"))


def _ends(spark, sf):
    points = base._gmap(spark, sf).groupBy("chrom").agg(F.min("cm").alias("a"), F.max("cm").alias("b"))
    step = 0.0002
    low, high = F.ceil(F.col("a") * 0.01 / step).cast("long"), F.ceil(F.col("b") * 0.01 / step).cast("long") - 1
    return points.where("b > a + 0.1").select("chrom", low.alias("low"), high.alias("high"))


def output_windows(spark, sf):
    """Output positions every 0.02 cM by windows of 500 steps."""
    return gmap.output_windows(_ends(spark, sf), 500, 0)


def backward_order(spark, sf):
    last = base._last(spark, sf).first()["last"]
    order = segments.backward_order(background.wide(base._panel(spark, sf)), last)
    return base._named(spark, sf, order, "hap").select("chrom", "m", "rank", "hap")


def interval_order(spark, sf):
    rows = base._read(spark, sf, "events").select("event_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start_pos"), F.col("user_id").alias("width"))
    rows = rows.withColumn("start_pos", F.floor(F.col("start_pos") / 3600)).withColumn("end_pos", F.col("start_pos") + F.col("width"))
    up, down = (Window.partitionBy("event_type").orderBy("start_pos", end, "event_id") for end in (F.asc("end_pos"), F.desc("end_pos")))
    return rows.select("event_type", "event_id", F.row_number().over(up).cast("long").alias("short_first"), F.row_number().over(down).cast("long").alias("long_first"))


def interval_overlaps(spark, sf):
    """Each user's intervals with the ones before: whether they overlap and what they span."""
    rows = base._intervals(spark, sf)
    by = Window.partitionBy("user_id").orderBy("start_pos", "end_pos", "event_type")
    rows = rows.withColumns({"a": F.lag("start_pos").over(by), "b": F.lag("end_pos").over(by)}).where("a is not null")
    met = records.span(F.col("start_pos"), F.col("end_pos"), F.col("a"), F.col("b"))
    rows = rows.withColumn("met", met)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count("met").alias("met"), F.sum(F.col("met.end") - F.col("met.start")).alias("spanned"))


def _names(spark, sf, table: str, key: str):
    rows = base._read(spark, sf, table).select(F.col(key).cast("long").alias("k"))
    return panel.numbered(rows, "k", "i").select(F.concat(F.lit("s"), "k").alias("name"), F.col("i").cast("long").alias("i"))


def common_samples(spark, sf):
    """Samples of two files, with their places in both."""
    return panel.common(_names(spark, sf, "customer", "c_custkey"), _names(spark, sf, "supplier", "s_suppkey"), "name")


def sample_concat(spark, sf):
    first = _names(spark, sf, "customer", "c_custkey")
    return panel.concatenated(first, _names(spark, sf, "supplier", "s_suppkey"), first.count())


def genotype_numbers(spark, sf):
    rows = base._read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4).cast("long").alias("a"), (F.col("l_quantity").cast("long") % 5).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", records.genotype_index(F.col("a"), F.col("b")).alias("place"), genotype_count(F.greatest("a", "b") + 1).cast("long").alias("n"))


def roundings(spark, sf):
    x = F.col("l_quantity") / 4 - 3
    rows = base._read(spark, sf, "lineitem")
    found = {"half_up": half_up(x), "even": F.rint(x), "up": F.ceil(x), "down": F.floor(x)}
    return rows.select("l_orderkey", "l_linenumber", *(v.cast("long").alias(k) for k, v in found.items()))


def log_numbers(spark, sf):
    rows = base._read(spark, sf, "lineitem")
    x = F.col("l_quantity") * 1.0625 + F.col("l_linenumber") * 0.03125
    return rows.select("l_orderkey", "l_linenumber", F.format_number(x, 4).alias("four"), records.elapsed(F.col("l_quantity") * 173).alias("elapsed"))


def array_maps(spark, sf):
    """Line numbers of each order as keys of a map of quantities; a repeated key is an error."""
    rows = base._read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("double")).alias("q"))
    rows = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "q"))).alias("x"))
    held = F.map_from_arrays(F.transform("x", lambda v: v["l_linenumber"]), F.transform("x", lambda v: v["q"]))
    return rows.select("l_orderkey", F.try_element_at(held, F.lit(2)).alias("second"), F.size(held).cast("long").alias("n"))


def reflected(spark, sf):
    """Coordinates seen from the other end: reversed and negated."""
    rows = base._read(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    back = F.transform(F.reverse("v"), lambda x: -x)
    return rows.select("vec_id", F.round(back[0], 6).alias("first"), F.round(F.element_at(back, -1), 6).alias("last"), F.round(F.aggregate(F.slice(back, 1, 3), F.lit(0.0), lambda a, x: a + x), 5).alias("three"))


def word_fields(spark, sf):
    rows = base._read(spark, sf, "part")
    parts, two = F.split(F.trim("p_name"), r"\s+"), F.split(F.trim("p_name"), r"\s+", 2)
    return rows.select("p_partkey", F.size(parts).cast("long").alias("n"), parts[0].alias("first"), F.get(two, F.lit(1)).alias("rest"))


def run_counters(spark, sf):
    sets = base._clusters(spark, sf).groupBy("chrom", "pos").agg(F.countDistinct("cluster").alias("n"))
    return sets.agg(F.count("*").alias("positions"), F.sum("n").alias("sets"), F.rint(F.sum("n") / F.count("*")).cast("long").alias("per_position"))


QUERIES = {
    f.__name__: f
    for f in (
        vcf_any_genotypes, format_field, sample_ploidy, info_counts, marker_fields, marker_order, running_totals, include_exclude, marker_restrict, interval_scan,
        monomorphic_markers, chromosome_runs, identity_map, map_chromosome, map_file_roundtrip, id_list_roundtrip, variant_lines_roundtrip, output_windows,
        backward_order, interval_order, interval_overlaps, common_samples, sample_concat, genotype_numbers, roundings, log_numbers, array_maps, reflected, word_fields, run_counters,
    )
}

_EVENTS = "e as (select event_id, event_type, floor(floor(epoch(ts)) / 3600)::bigint start_pos, user_id width from events)"
_LISTS = """one as (select 's' || c_custkey name, row_number() over (order by c_custkey) - 1 i from customer),
 two as (select 's' || s_suppkey name, row_number() over (order by s_suppkey) - 1 i from supplier)"""
ORACLE_SQL = {
    "vcf_any_genotypes": f"with {_SAMPLES} select '1' chrom, pos, 'rs' || m id, 2 * count(*) filter (not half) called, coalesce(sum(a + coalesce(b, a)) filter (not half), 0)::bigint ones, count(*) filter (not slash) phased from v group by m, pos",
    "format_field": f"with {_SAMPLES} select '1' chrom, pos, count(*) filter ((s + m) % 13 <> 0) n, coalesce(sum((s * 7 + m) % 50) filter ((s + m) % 13 <> 0), 0)::bigint total from v group by pos",
    "sample_ploidy": f"with {_SAMPLES} select '1' chrom, pos, count(*) filter (not haploid) diploid, count(*) samples from v group by pos",
    "info_counts": f"with {_SAMPLES} select '1' chrom, pos, 'DP=' || m || ';END=' || (1000 * m + 1010) || ';AN=' || (2 * count(*) filter (not half)) || ';AC=' || coalesce(sum(a + coalesce(b, a)) filter (not half), 0)::bigint info, 1000 * m + 1010 end_pos from v group by m, pos",
    "marker_fields": f"with {_VARIANTS} select chrom, pos, n_alleles::int n_alleles, chrom || ':' || pos place, chrom || ':' || pos || '_A' || case when alt = '.' then '' else '_' || replace(alt, ',', '_') end as name from variants",
    "marker_order": f"with {_VARIANTS} select chrom, m, row_number() over (partition by chrom order by pos % 500, ref, alt, m) - 1 place from variants",
    "running_totals": f"with {_VARIANTS}, b as (select *, case n_alleles when 1 then 0 when 2 then 1 else 2 end bits from variants) select chrom, m, coalesce(sum(n_alleles) over w, 0)::bigint alleles_before, coalesce(sum(n_alleles * (n_alleles + 1) // 2) over w, 0)::bigint genotypes_before, coalesce(sum(bits) over w, 0)::bigint bits_before from b window w as (partition by chrom order by m rows between unbounded preceding and 1 preceding)",
    "include_exclude": "select 'c' || (p_size % 5) chrom, p_partkey m, p_partkey * 10 pos from part where (p_brand like '%1' or p_brand like '%2') and p_brand not like '%#1%'",
    "marker_restrict": f"with {base.PANEL} select chrom, m, count(*) n, sum(allele)::bigint ones from panel where m between 8 and 19 or m in (1, 40, 63) group by all",
    "interval_scan": "select 'c' || (p_size % 5) chrom, p_partkey m, p_partkey * 10 pos from part where p_size % 5 = 1 and p_partkey * 10 >= 100",
    "monomorphic_markers": f"with {base.PANEL} select chrom, m, count(distinct case when m % 3 = 0 then 0 else allele end) = 1 monomorphic from panel group by all",
    "chromosome_runs": "select chrom, count(*) runs from (select chrom, lag(chrom) over (order by o_orderkey) before from (select o_orderkey, 'c' || (floor(sqrt(o_orderkey))::bigint % 7) chrom from orders)) where before is distinct from chrom group by chrom having count(*) > 1",
    "identity_map": f"with {base.PLACES} select chrom, k, line, round(pos * 1e-6::double, 9) cm from places",
    "map_chromosome": f"with {base.GMAP} select chrom, bp, round(cm, 6) cm from gmap where chrom = 'c2'",
    "map_file_roundtrip": f"with {base.GMAP} select chrom, bp, round(cm, 6) cm from gmap",
    "id_list_roundtrip": "select distinct replace(p_brand, ' ', '_') as name from part",
    "variant_lines_roundtrip": f"with {base.PANEL}, v as (select distinct m from panel) select count(*) n, sum(length('1' || (1000 * (m + 1)) || 'rs' || m || 'AC.PASSAN=5;DP=' || m || ';AC=1;END=' || (1000 * m + 1010)) + 8)::bigint chars from v",
    "output_windows": f"with {base.GMAP}, e as (select chrom, min(cm) a, max(cm) b from gmap group by chrom), s as (select chrom, unnest(range(ceil(a * 0.01::double / 0.0002::double)::bigint, ceil(b * 0.01::double / 0.0002::double)::bigint)) step from e where b > a + 0.1) select chrom, floor(step / 500)::bigint as window, count(*) n, min(step) as first, max(step) as last from s group by all",
    "backward_order": base._ORDER.replace("STEP", "1").replace("i - 1 as m", "64 - i as m") + " select chrom, 63 - m as m, rank, hap from ranked",
    "interval_order": f"with {_EVENTS} select event_type, event_id, row_number() over (partition by event_type order by start_pos, start_pos + width, event_id) short_first, row_number() over (partition by event_type order by start_pos, start_pos + width desc, event_id) long_first from e",
    "interval_overlaps": f"with {base.INTERVALS}, p as (select *, lag(start_pos) over w a, lag(end_pos) over w b from intervals window w as (partition by user_id order by start_pos, end_pos, event_type)) select user_id, count(*) n, count(*) filter (start_pos <= b and a <= end_pos) met, sum(greatest(end_pos, b) - least(start_pos, a)) filter (start_pos <= b and a <= end_pos)::bigint spanned from p where a is not null group by user_id",
    "common_samples": f"with {_LISTS} select name, one.i, two.i as j from one join two using (name)",
    "sample_concat": f"with {_LISTS} select name, i from one union all select name, i + (select count(*) from one) from two",
    "genotype_numbers": "select l_orderkey, l_linenumber, greatest(a, b) * (greatest(a, b) + 1) // 2 + least(a, b) place, (greatest(a, b) + 1) * (greatest(a, b) + 2) // 2 n from (select l_orderkey, l_linenumber, (l_linenumber % 4)::bigint a, l_quantity::bigint % 5 b from lineitem)",
    "roundings": "select l_orderkey, l_linenumber, floor(x + 0.5)::bigint half_up, round_even(x, 0)::bigint as even, ceil(x)::bigint up, floor(x)::bigint down from (select l_orderkey, l_linenumber, l_quantity::double / 4 - 3 x from lineitem)",
    "log_numbers": "select l_orderkey, l_linenumber, printf('%.4f', l_quantity::double * 1.0625 + l_linenumber * 0.03125) four, case when s >= 3600 then (s // 3600) || case when s // 3600 = 1 then ' hour ' else ' hours ' end else '' end || case when s % 3600 >= 60 then (s % 3600 // 60) || case when s % 3600 // 60 = 1 then ' minute ' else ' minutes ' end else '' end || (s % 60) || case when s % 60 = 1 then ' second' else ' seconds' end elapsed from (select *, floor(l_quantity::double * 173 + 0.5)::bigint s from lineitem)",
    "array_maps": "select l_orderkey, sum(case when l_linenumber = 2 then l_quantity::double end) as second, count(distinct l_linenumber) n from lineitem group by l_orderkey",
    "reflected": "select vec_id, round(-embedding[64]::double, 6) as first, round(-embedding[1]::double, 6) as last, round(-embedding[64]::double - embedding[63]::double - embedding[62]::double, 5) three from embeddings where embedding is not null",
    "word_fields": "select p_partkey, len(string_split_regex(trim(p_name), '\\s+')) n, split_part(trim(p_name), ' ', 1) as first, case when contains(trim(p_name), ' ') then substr(trim(p_name), instr(trim(p_name), ' ') + 1) end rest from part",
    "run_counters": base._COMPONENTS + ", k as (select pos, count(distinct cluster) n from labels group by pos) select count(*) positions, sum(n)::bigint as sets, round_even(sum(n) / count(*), 0)::bigint per_position from k",
}
