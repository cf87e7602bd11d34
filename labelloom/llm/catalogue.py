"""One query per operator over the given tables, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import ctw, decontaminate, filteraudit, langid, linededup, merkle, mixing, neardup, qualityrules, substring, topk, toxicity, warc
from labelloom.session import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ctw.score(docs, _remainder(7) != 2)
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    return scored.select("doc_id", (_remainder(7) == 2).alias("held_out"), *columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(materialise(mixing.with_size(docs).drop("text")))
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.captures(warc.read_archives(spark, warc.write_archives(pages), payloads=False))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("text")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _remainder(4) == 2
    model = langid.train(docs.filter(~held_out & F.col("text").isNotNull()))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _remainder(4) == 2
    model = toxicity.train(docs.filter(~held_out), _table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return filteraudit.audit(filteraudit.mask_counts(docs, labels), "ABCDE")


def op12_qualityrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counted = materialise(qualityrules.with_statistics(docs))
    certs = qualityrules.calibrate(counted, _table(spark, sf_dir, "labels"))
    return qualityrules.judge(counted, certs).drop("lang", "n_lines")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    changed = F.coalesce(_remainder(7) == 0, F.lit(False)) & F.col("doc_id").isNotNull()
    rows = merkle.manifest(docs.withColumn("other", F.when(changed, merkle.leaf_hash(*more))), keep=["other"])
    shown = rows.withColumn("folded_root", merkle.folded(F.coalesce("other", "leaf"), F.col("witness")))
    columns = ["doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("witness")).alias("proof_sha256"), "folded_root"]
    return shown.select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_ctw": op1_ctw,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_substring": op4_substring,
    "op5_neardup": op5_neardup,
    "op6_topk": op6_topk,
    "op7_linededup": op7_linededup,
    "op8_decontaminate": op8_decontaminate,
    "op9_langid": op9_langid,
    "op10_toxicity": op10_toxicity,
    "op11_filteraudit": op11_filteraudit,
    "op12_qualityrules": op12_qualityrules,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_substring": substring.ORACLE,
    "op6_topk": topk.ORACLE,
    "op7_linededup": linededup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op11_filteraudit": filteraudit.ORACLE,
    "op12_qualityrules": qualityrules.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
