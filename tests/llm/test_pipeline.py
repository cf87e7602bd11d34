"""Each stage of the corpus pipeline on its own input, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.llm import catalogue

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, None, None, None), (900_001, None, "en", "src0", 0), (900_002, "", "en", None, 0), (900_003, "12 34", None, "src1", 5)]
    return plain.unionByName(spark.createDataFrame(odd, plain.schema))


STAGES = dict(corpus_pipeline.STAGES)


def test_language_drops_what_has_no_letter(spark, docs, sf):
    kept = STAGES["language"](spark, docs, sf)
    assert kept.columns == docs.columns
    gone = docs.select("doc_id").subtract(kept.select("doc_id")).collect()
    assert {r[0] for r in gone} == {None, 900_001, 900_002, 900_003}


def test_lines_follow_the_query(spark, docs, sf):
    kept = STAGES["lines"](spark, docs, sf)
    assert kept.columns == docs.columns
    want = catalogue.QUERIES["op7_linededup"](spark, sf).toPandas().set_index("doc_id")
    got = kept.filter("doc_id < 900000").select("doc_id", F.sha2("text", 256).alias("h"), "n_chars", F.length("text").alias("n")).toPandas().set_index("doc_id")
    assert (got["h"] == want.loc[got.index, "kept_sha256"]).all()
    gone = want.drop(got.index)
    assert (gone["n_removed"] > 0).all() and (gone["n_lines"] == gone["n_removed"]).all()


def test_one_document_of_each_class_stays(spark, docs, sf):
    kept = STAGES["near_duplicates"](spark, docs, sf)
    assert kept.columns == docs.columns
    classes = catalogue.QUERIES["op5_neardup"](spark, sf).toPandas()
    want = set(classes["class_id"])
    got = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(x for x in got if x is not None and x < 900_000) == sorted(want)
    assert {x for x in got if x is None or x >= 900_000} == {None, 900_001, 900_002, 900_003}


def test_contaminated_documents_go(spark, docs, sf):
    kept = {r[0] for r in STAGES["benchmarks"](spark, docs, sf).select("doc_id").collect()}
    verdict = catalogue.QUERIES["op8_decontaminate"](spark, sf).toPandas()
    assert set(verdict.loc[verdict["contaminated"], "doc_id"]).isdisjoint(kept)
    assert set(verdict.loc[~verdict["contaminated"], "doc_id"]) <= kept


def test_mix_emits_each_copy(spark, docs, sf):
    mixed = STAGES["mix"](spark, docs, sf)
    assert mixed.columns[:5] == COLUMNS
    got = mixed.filter("doc_id < 900000").groupBy("doc_id").agg(F.sum("size").alias("n"), F.count("*").alias("k"), F.max("copies").alias("c")).toPandas()
    assert (got["k"] == got["c"]).all() and got["k"].max() <= 2


def test_whole_run_and_empty_input(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.columns[:5] == COLUMNS
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
