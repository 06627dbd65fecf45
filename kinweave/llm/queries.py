"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import licenses
from kinweave.llm.labelled import fold
from kinweave.llm.langid import language
from kinweave.llm.merge_dropout import encode
from kinweave.llm.minhash import near_duplicates
from kinweave.llm.nearest import neighbours
from kinweave.llm.ngram_join import jaccard_components
from kinweave.llm.packing import pack
from kinweave.llm.pii import pseudonyms
from kinweave.llm.prefix_trie import prefix_trie, rebuilt, turns
from kinweave.llm.quality import quality
from kinweave.llm.ranked_search import search
from kinweave.llm.secrets import KINDS, listed, secrets
from kinweave.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")  # whole texts: bounded batches
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), where=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_table(spark, sf_dir, "embeddings"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.kinweave.pseudonymKey``; without one, pseudonyms are repeatable but no secret."""
    return pseudonyms(_table(spark, sf_dir, "documents"), key=spark.conf.get("spark.kinweave.pseudonymKey", "unkeyed"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "lossless")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(_table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.sha2(listed(F.col("spans"), KINDS[:3]).cast("binary"), 256)
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), base.alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    found = language(_table(spark, sf_dir, "documents"), where=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turns(_table(spark, sf_dir, "conversations"))))


def op12_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_jaccard_components": op7_jaccard_components,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_minhash_components": op12_minhash_components,
    "op13_ranked_search": op13_ranked_search,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[\x09-\x0D\x20!-/:-@\[-`{{-~]+'), lambda x: x <> '')"
_TEMPLATES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.TEMPLATES.items()))


def _components_sql(width: int, percent: int, more: str = "") -> str:
    return f"""with recursive w as (select doc_id, {_WORDS} w from documents),
        s as (select distinct doc_id, array_to_string(w[i:i + {width - 1}], ' ') g from w, unnest(range(1, len(w) - {width - 2})) t(i) where len(w) >= {width}
              union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and {width - 1}),
        n as (select doc_id, count(*) n from s group by doc_id),
        common as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
        link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
        reach as (select a as d, a as lab from link union select k.b, r.lab from reach r join link k on k.a = r.d and k.b > r.lab),
        found as (select w.doc_id, coalesce(n.n, 0) n_shingles, least(w.doc_id, coalesce(m.lab, w.doc_id)) component_id
                  from w left join n using (doc_id) left join (select d, min(lab) lab from reach group by d) m on m.d = w.doc_id)
        select *{more} from found"""


#: The others score with learned models, encode, or seal with keys, and are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op7_jaccard_components": _components_sql(5, 80),
    "op12_minhash_components": _components_sql(3, 85, ", doc_id = component_id as kept"),
    "op11_prefix_trie": """with own as (select conv_id, list(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) order by turn nulls first) p,
                 list(length(coalesce(text, '')) order by turn nulls first) c from conversations where conv_id is not null group by conv_id),
        bytes as (select *, list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)) b from own),
        h as (select conv_id, p, c, xor(4294967295::bigint, list_reduce(b, lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0],
                 lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 6 h from bytes),
        built as (select o.conv_id, list_concat(coalesce(b.p, [])[1:o.h], o.p[o.h + 1:]) p, list_concat(coalesce(b.c, [])[1:o.h], o.c[o.h + 1:]) c
                 from h o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
        part as (select conv_id, len(p) size, d, array_to_string(p[1:d], '') k, coalesce(c[d], 0) chars from built, unnest(range(0, len(p) + 1)) u(d)),
        node as (select d, k, min(conv_id) conv_id, count(*) n, max(chars) chars, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = d), '') ends from part group by d, k),
        child as (select left(k, 32 * (d - 1)::bigint) k, count(*) n from node where d > 0 group by 1),
        one as (select node.*, coalesce(child.n, 0) children from node left join child using (k)),
        sums as (select a.k, sum((b.children = 0)::bigint)::bigint leaves, sum((b.n - 1) * b.chars)::bigint saved from one a join one b on starts_with(b.k, a.k) group by a.k)
        select a.conv_id, a.d as depth, up.conv_id parent_conv_id, a.n as n_convs, a.children n_children, s.leaves n_leaves, s.saved saved_tokens, sha256(a.ends) ends_sha256
        from one a join sums s using (k) left join one up on up.k = left(a.k, 32 * (a.d - 1)::bigint) and a.d > 0""",
    "op13_ranked_search": f"""with d as (select doc_id, row_number() over () place, {_TERMS} w from documents),
        long as (select place, doc_id, len(w) n from d where len(w) > 0),
        total as (select count(*) docs, sum(n)::bigint terms from long),
        q as (select item_id, t, count(*) times from (select item_id, unnest({_TERMS}) t from benchmark where item_id is not null) group by all),
        p as (select place, t, count(*) tf from (select place, unnest(w) t from d) where t in (select t from q) group by all),
        df as (select t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint w from p, total group by t, docs),
        score as (select item_id, place, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))))::bigint score
                  from q join df using (t) join p using (t) join long using (place), total group by all),
        ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from score join long using (place) where score > 0)
        select * from ranked where rank <= 10""",
    "op10_license_scan": f"""with d as (select doc_id, {_TOKENS.format("text")} w from documents where text is not null),
        t as (select license_id, {_TOKENS.format("notice")} w from (values {_TEMPLATES}) v(license_id, notice)),
        ds as (select distinct doc_id, array_to_string(w[i:i + 2], ' ') g from d, unnest(range(1, len(w) - 1)) u(i)),
        ts as (select distinct license_id, array_to_string(w[i:i + 2], ' ') g from t, unnest(range(1, len(w) - 1)) u(i)),
        n as (select license_id, count(*) n_shingles from ts group by license_id)
        select doc_id, license_id, n_shingles, count(*) n_found from ds join ts using (g) join n using (license_id)
        group by all having count(*) >= 0.8 * n_shingles""",
}
