"""Nearest-template classification of a table or CSV, without a trained head."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.operators.prepare import template_texts
from labelloom.operators.similarity import nearest_template
from labelloom.sources.readers import read_csv, require_columns, with_row_id
from labelloom.sources.writers import write_csv

Encoder = Callable[[DataFrame, str, str], DataFrame]


def hashed_encoder(dimensions: int = 256) -> Encoder:
    """Spark-only text encoder: word counts hashed to a fixed number of slots.

    Stands in where no pretrained encoder is given; any function (frame, text column, vector column)
    -> frame can replace it.
    """

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\\W+"), lambda w: w != "")
        counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dimensions).transform(
            df.withColumn("__words", words)
        )
        return counted.withColumn(out, vector_to_array("__tf")).drop("__words", "__tf")

    return encode


def predict_templates(
    df: DataFrame,
    templates: DataFrame,
    *,
    encoder: Encoder | None = None,
    text: str = S.DESCRIPTION,
    k: int = S.TEMPLATE_TOP_K,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """Ranked (domain, topic, confidence) per row: rows (id, rank, predicted_*, confidence)."""
    encode = encoder or hashed_encoder()
    named = template_texts(templates).withColumn("template_id", F.xxhash64(*S.CLASS, "template"))
    encoded = encode(named, "template", "vector")
    ranked = nearest_template(encode(df.select(id_col, text), text, "vector"), encoded, k, id_col=id_col)
    labels = named.select(
        "template_id", F.col(S.DOMAIN).alias("predicted_domain"), F.col(S.TOPIC).alias("predicted_topic")
    )
    return ranked.join(labels, "template_id").drop("template_id")


def predict_templates_csv(
    spark: SparkSession, path: str, out: str, text: str, templates: DataFrame, *, encoder: Encoder | None = None
) -> str:
    """CSV in; the three prediction columns of the best template added; CSV out."""
    rows = with_row_id(read_csv(spark, path))
    require_columns(rows, [text])
    best = predict_templates(rows, templates, encoder=encoder, text=text, k=1).drop("rank")
    return write_csv(rows.join(best, S.ROW_ID, "left"), out)
