"""From raw documents to a training mix: five stages, each over all that the one before kept.

1. language: documents whose language can't be told (no letter, or a posterior below 0.5) go.
2. lines: runs of lines that occurred before are cut out; a document left without a word goes.
3. near-duplicates: one document of each class stays.
4. decontamination: documents that contain a window of a benchmark item go.
5. mix: sources are sampled to their target weights; a document is emitted once per copy.

Defined cases: a null or empty text has no letter, so stage 1 drops it (the later stages would keep it, as they find nothing in it);
texts of any length are read whole; null ids are kept and count as last; rows of equal id and text are one document in stages 2 and 4,
copies in stage 3, where the smallest id of a class stays (of equal ids, one row), and rows of their own in stage 5; null sources are
a source; an empty table gives an empty table; other columns pass unchanged, but for those named like a count of stages 2, 4 or 5,
which then hold that count. Stage 5 adds the columns of ``mixing``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import decontaminate, langid, linededup, mixing, neardup
from labelloom.session import materialise

LEAST_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.filter("text is not null"))
    told = langid.predict(docs.withColumnsRenamed({c: f"_{c}" for c in ("lang_pred", "score") if c in docs.columns}), model)
    kept = told.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_POSTERIOR)).drop("lang_pred", "score")
    return kept.toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = linededup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    left = left.filter(~emptied)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each_class(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminate(docs, items).filter(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.expand(mixing.mix(mixing.with_size(docs)))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("mix", mix),
]

#: Language models and consistent samples can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
