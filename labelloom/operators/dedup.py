"""Duplicate analysis and keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.ranking import head_per_group


def _name_class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*S.DEDUP_COLUMNS).agg(F.count(F.lit(1)).alias("n"))


def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row: total rows, rows in exact duplicate groups, rows removed, rows of ambiguous names.

    Everything is derived from one combinable count per (name, domain, topic), so a name held by a
    third of all rows costs one partial count per task. A class with a null member is a class of its
    own; a null name is never ambiguous.
    """
    groups = _name_class_counts(df)
    per_name = groups.groupBy(S.NAME).agg(
        F.count(F.lit(1)).alias("variants"),
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup_rows"),
        F.sum(F.col("n") - 1).alias("removed"),
    )
    ambiguous = (F.col("variants") > 1) & F.col(S.NAME).isNotNull()
    return per_name.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("dup_rows"), F.lit(0)).alias("rows_in_dup_groups"),
        F.coalesce(F.sum("removed"), F.lit(0)).alias("rows_removed"),
        F.coalesce(F.sum(F.when(ambiguous, F.col("rows"))), F.lit(0)).alias("partial_duplicate_rows"),
    )


def partial_duplicates(df: DataFrame) -> DataFrame:
    """Names that occur with more than one (domain, topic): variants and rows."""
    return (
        _name_class_counts(df.filter(F.col(S.NAME).isNotNull()))
        .groupBy(S.NAME)
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("rows"))
        .filter("variants > 1")
    )


def keep_first(df: DataFrame, order_by: str = S.ROW_ID) -> DataFrame:
    """First row of each (name, domain, topic). Null members are equal.

    The rank bound of 1 is applied on the map side too, so copies of a hot key shrink to one row per
    map task before the shuffle.
    """
    return head_per_group(df, S.DEDUP_COLUMNS, order_by, 1)


def full_row_dedup(df: DataFrame, ignore: tuple[str, ...] = (S.ROW_ID,)) -> DataFrame:
    """Distinct rows over the data columns (the technical row id does not make a row different)."""
    return df.select(*[c for c in df.columns if c not in ignore]).distinct()


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
