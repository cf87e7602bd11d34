"""Building and shaping the labelled table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.hashing import uniform
from labelloom.functions.joins import join_hot
from labelloom.functions.ranking import order_rank
from labelloom.functions.text import render_template, text_spec
from labelloom.session import materialise
from labelloom.sources.readers import require_columns


def build_labelled(taxonomy: DataFrame, master: DataFrame) -> DataFrame:
    """Taxonomy joined to its definitions on the attribute name (many-to-many, inner).

    No broadcast hint: Spark broadcasts the definition side when its size allows, otherwise it
    sort-merges. Names that hold a large share of the taxonomy are salted when it has row ids.
    """
    require_columns(taxonomy, S.TAXONOMY_COLUMNS)
    require_columns(master, S.MASTER_COLUMNS)
    keep = [c for c in (S.ROW_ID,) if c in taxonomy.columns]
    left = taxonomy.select(*keep, *S.TAXONOMY_COLUMNS)
    right = master.select(*S.MASTER_COLUMNS)
    joined = join_hot(left, right, S.NAME) if keep else left.join(right, S.NAME, "inner")
    return joined.select(*keep, *S.LABELLED_COLUMNS)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any", subset=[c for c in S.LABELLED_COLUMNS if c in df.columns])


def incomplete_counts(df: DataFrame) -> DataFrame:
    """Rows before, dropped and kept, in one pass."""
    columns = [c for c in S.LABELLED_COLUMNS if c in df.columns]
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(missing, 1)).alias("dropped"),
        F.count(F.when(~missing, 1)).alias("kept"),
    )


def with_attribute_name(df: DataFrame, order_by: str = S.ROW_ID) -> DataFrame:
    """Where the name column is missing, the row index (from 0) becomes the name."""
    if S.NAME in df.columns:
        return df
    return order_rank(df, [], order_by, out="__index").withColumn(
        S.NAME, F.col("__index").cast("string")
    ).drop("__index")


def parse_text_spec(df: DataFrame, column: str) -> DataFrame:
    """Single texts given as ``name: text``."""
    name, text = text_spec(F.col(column))
    return df.withColumn(S.NAME, name).withColumn(S.DESCRIPTION, text)


def mask_labels(
    df: DataFrame,
    shares: tuple[float, float, float] = S.MASK_SHARES,
    *,
    seed: int = S.SEED,
    id_col: Column | str = S.ROW_ID,
) -> DataFrame:
    """Blank the domain, the topic or both of each row; rows beyond the shares stay intact.

    Adds ``mask`` with the kind of blanking.
    """
    u = uniform(seed, "mask", id_col)
    d, c, b = shares
    mask = (
        F.when(u < d, "domain").when(u < d + c, "topic").when(u < d + c + b, "both").otherwise("none")
    )
    rows = df.withColumn("mask", mask)
    return rows.withColumn(
        S.DOMAIN, F.when(F.col("mask").isin("domain", "both"), F.lit("")).otherwise(F.col(S.DOMAIN))
    ).withColumn(
        S.TOPIC, F.when(F.col("mask").isin("topic", "both"), F.lit("")).otherwise(F.col(S.TOPIC))
    )


def mask_counts(masked: DataFrame) -> DataFrame:
    return masked.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def assign_batches(df: DataFrame, size: int, order_by: str = S.ROW_ID) -> DataFrame:
    """Consecutive batches of a fixed size, in row order."""
    if size < 1:
        raise ValueError("batch size must be positive")
    return order_rank(df, [], order_by, out="__index").withColumn(
        "batch_id", F.floor(F.col("__index") / F.lit(size)).cast("bigint")
    ).drop("__index")


def template_texts(templates: DataFrame) -> DataFrame:
    """One rendered template per class. Of repeated classes the last row wins; where the table has no
    ``row_id`` to tell the order, the one with the largest definition."""
    require_columns(templates, S.TEMPLATE_COLUMNS)
    order = [F.col(c) for c in (S.ROW_ID,) if c in templates.columns] + [F.coalesce("topic_definition", F.lit(""))]
    return (
        templates.groupBy("domain_name", "topic_name")
        .agg(F.max_by("topic_definition", F.struct(*order)).alias("topic_definition"))
        .select(
            F.col("domain_name").alias(S.DOMAIN),
            F.col("topic_name").alias(S.TOPIC),
            render_template(F.col("domain_name"), F.col("topic_name"), F.col("topic_definition")).alias("template"),
        )
    )


def with_definition(df: DataFrame, definitions: DataFrame) -> DataFrame:
    """Left lookup of the class definition; an empty text where there is none.

    Of repeated classes the last row (by ``line_no`` or ``row_id``, else the largest text) wins.
    """
    order = [F.col(c) for c in ("line_no", S.ROW_ID) if c in definitions.columns] + [F.coalesce("definition", F.lit(""))]
    one = definitions.groupBy(*S.CLASS).agg(F.max_by("definition", F.struct(*order)).alias("definition"))
    return df.join(one, S.CLASS, "left").withColumn(
        "definition", F.coalesce(F.col("definition"), F.lit(""))
    )


def with_template(df: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their template text, rows whose class has no template)."""
    texts = template_texts(templates)
    return df.join(texts, S.CLASS, "inner"), df.join(texts.select(*S.CLASS), S.CLASS, "left_anti")


def known_pairs_only(
    predictions: DataFrame, observed: DataFrame, domain: str = "predicted_domain", topic: str = "predicted_topic"
) -> DataFrame:
    """Predictions whose (domain, topic) pair was observed in training."""
    pairs = observed.select(F.col(S.DOMAIN).alias(domain), F.col(S.TOPIC).alias(topic)).distinct()
    return predictions.join(materialise(pairs), [domain, topic], "left_semi")
