"""A training corpus in five stages: quality, language, near duplicates, secrets, packing.

Each stage takes the rows that the one before kept. The first four return the columns of
``documents``; the last returns the packed pieces. Stages make whole tables; nothing is sampled except
the bounded labelled rows that the classifiers learn from.

Rows of any kind pass or go by these rules, and a stage keeps all columns, whatever their names: null, empty and
word-free texts fail the base quality rules; texts are read whole, whatever their length; rows that repeat an id or
each other are rows of their own until near duplicates are told apart, where one of each group stays; rows without an
id are rows like any other. Empty tables give empty tables. Without labels the quality classifier accepts what passes
the rules, and without languages the language stage keeps all rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.langid import told_apart
from kinweave.llm.ngram_join import jaccard_components
from kinweave.llm.packing import pack
from kinweave.llm.quality import good_documents
from kinweave.llm.secrets import redact
from kinweave.plans.storage import Scratch

#: A text whose best language explains it no better than this posterior is rejected.
SURE = 0.5


def _sized(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")  # whole texts: bounded batches


def _free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it (names compare without case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality classifier."""
    _sized(spark)
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells apart; ``lang`` becomes the prediction."""
    _sized(spark)
    return told_apart(docs, SURE)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the least doc_id, of each group of near duplicates; rows without an id count last.

    Rows are told apart by a key of their own, so repeated and null ids are rows like any other. The key
    is written with the rows before anything reads it twice.
    """
    _sized(spark)
    scratch = Scratch(spark)
    key = _free("row_key", docs.columns)
    keyed = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = jaccard_components(keyed, id_col=key).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    places = keyed.select(F.col(key).alias("_row"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("row")).alias("_place"))
    chosen = found.join(places, "_row").groupBy("_group").agg(F.min("_place").alias("_least")).select(F.col("_least.row").alias("_chosen_row"))
    return keyed.join(chosen, F.col(key) == F.col("_chosen_row"), "left_semi").drop(key)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in ``text`` replaced by a mark and ``n_chars`` brought up to date."""
    _sized(spark)
    out = redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in the packed sequences."""
    _sized(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned stages are not expressible in SQL; tests hold the rows that follow from their verdicts against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder for the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
