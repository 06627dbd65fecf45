import random

import corpus_pipeline
from kinweave.llm.ngram_join import jaccard_components
from kinweave.plans.storage import Scratch


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = scratch.keep(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[1] < sizes[0] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    left = jaccard_components(docs.where("text not like '%[SECRET]%'"))
    assert left.where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, `score` int"
    for rows in ([], [(1, None, None, None, None, None, None), (2, "", "en", None, 1, None, None), (None, "a b c", None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).count() <= len(rows)
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_near_duplicates_of_rows_with_repeated_and_null_ids(spark):
    one, two, three, four = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(7, one), (7, one), (8, two), (8, three), (None, four), (None, one), (9, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Row_Key string").repartition(3)
    got = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted([(r.doc_id, r.text) for r in got.collect()], key=str)
    assert left == sorted([(7, one), (8, two), (8, three), (None, four), (9, None), (None, None), (None, "")], key=str)


def test_language_stage_rejects_texts_of_no_learned_language(spark):
    r = random.Random(4)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(40))
    syllables = {"aa": ["ba", "do", "ki", "lu"], "bb": ["schön", "über", "tz", "en"]}
    rows = [(i, make(syllables[x]), x) for i, x in enumerate(list(syllables) * 200)]
    alien = [make(["qua", "xim", "wex", "jyp"]), make(["при", "вет", "мир", "да"]), make(["του", "και", "ναι"]), make("qwertyuiopasdfghjklzxcvbnm")]
    docs = spark.createDataFrame([*rows, *((1000 + i, t, None) for i, t in enumerate(alien))], "doc_id long, text string, lang string")
    got = {x.doc_id: x.lang for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == {i: x for i, _, x in rows}
    unlabelled = spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, lang string")
    assert corpus_pipeline.language_id(spark, unlabelled, "").count() == len(rows)
