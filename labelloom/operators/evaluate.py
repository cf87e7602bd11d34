"""Accuracy, confusion counts and per-class reports for both label levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S

LEVELS = (S.DOMAIN, S.TOPIC)


def _levels(df: DataFrame) -> DataFrame:
    """(level, true, predicted): one record per row and label level."""
    both = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                F.col(level).cast("string").alias("true"),
                F.col(f"predicted_{level}").cast("string").alias("predicted"),
            )
            for level in LEVELS
        ]
    )
    return df.select(F.explode(both).alias("e")).select("e.level", "e.true", "e.predicted")


def confusion(df: DataFrame) -> DataFrame:
    """Rows per (level, true, predicted): the only pass over the data; all metrics derive from it."""
    return _levels(df).groupBy("level", "true", "predicted").agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame) -> DataFrame:
    """Share of right rows per level."""
    right = F.col("true") == F.col("predicted")
    return (
        confusion(df)
        .groupBy("level")
        .agg(
            F.sum("n").alias("rows"),
            F.round(F.sum(F.when(right, F.col("n")).otherwise(0)) / F.sum("n").cast("double"), 6).alias("accuracy"),
        )
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Per level and label: precision, recall, f1, support; plus accuracy, macro and weighted averages.

    Labels are those that occur as true or predicted; a division by zero gives 0.
    """
    cells = confusion(df)
    hit = F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(
        "level",
        F.explode(
            F.array(
                F.struct(F.col("true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
            )
        ).alias("e"),
    ).select("level", "e.*")
    sums = sides.groupBy("level", "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called")
    )

    def ratio(a, b):
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    scored = (
        sums.withColumn("precision", ratio(F.col("tp"), F.col("called")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn(
            "f1",
            F.when(
                F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
            ).otherwise(0.0),
        )
    )
    metrics = ("precision", "recall", "f1")
    per_label = scored.select("level", F.lit("label").alias("kind"), "label", *[F.round(m, 6).alias(m) for m in metrics], "support")
    overall = scored.groupBy("level").agg(
        F.sum("support").alias("support"),
        (F.sum("tp") / F.sum("support").cast("double")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in metrics],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                *[F.round(F.col(source.format(m)), 6).alias(m) for m in metrics],
            )
            for kind, source in (("accuracy", "accuracy"), ("macro avg", "macro_{}"), ("weighted avg", "weighted_{}"))
        ]
    )
    averages = overall.select("level", "support", F.explode(lines).alias("e")).select(
        "level", "e.kind", F.lit(None).cast("string").alias("label"), *[f"e.{m}" for m in metrics], "support"
    )
    return per_label.unionByName(averages)
