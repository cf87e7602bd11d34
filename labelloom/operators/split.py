"""Exact splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.hashing import uniform
from labelloom.functions.ranking import mark_first
from labelloom.operators.profile import with_class


def cap_split(df: DataFrame, cap: int = S.CLASS_CAP, *, seed: int = S.SEED, id_col: str = S.ROW_ID) -> DataFrame:
    """At most ``cap`` random rows per class go to ``train``, the overflow to ``eval``.

    Adds ``split``. The rows themselves are joined to one cut per class; they are not sorted.
    """
    marked = mark_first(
        with_class(df), S.CLASS, lambda n: F.least(n, F.lit(cap).cast("bigint")), seed=seed, salt="cap", id_col=id_col
    )
    return marked.withColumn("split", F.when(F.col("chosen"), "train").otherwise("eval")).drop("chosen")


def training_part(split_df: DataFrame) -> DataFrame:
    return split_df.filter(F.col("split") == "train").drop("split")


def evaluation_part(split_df: DataFrame) -> DataFrame:
    return split_df.filter(F.col("split") == "eval").drop("split")


def train_test_split(
    df: DataFrame,
    share: float = S.TEST_SHARE,
    *,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
    exact: bool = True,
) -> DataFrame:
    """Adds ``split``: exactly ceil(share * n) test rows, or one hash filter when ``exact=False``."""
    if not exact:
        test = uniform(seed, "split", id_col) < F.lit(share)
        return df.withColumn("split", F.when(test, "test").otherwise("train"))
    marked = mark_first(
        df, [], lambda n: F.ceil(n.cast("double") * F.lit(share)), seed=seed, salt="split", id_col=id_col
    )
    return marked.withColumn("split", F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen")


def split_per_label(
    df: DataFrame, share: float = S.VALIDATION_SHARE, *, seed: int = S.SEED, id_col: str = S.ROW_ID
) -> DataFrame:
    """Per class, ceil(share * n) rows to ``val``, the rest to ``train``; a one-row class to both."""
    marked = mark_first(
        with_class(df),
        S.CLASS,
        lambda n: F.ceil(n.cast("double") * F.lit(share)),
        seed=seed,
        salt="val",
        id_col=id_col,
        size_out="__n",
    )
    sides = (
        F.when(F.col("__n") == 1, F.array(F.lit("train"), F.lit("val")))
        .when(F.col("chosen"), F.array(F.lit("val")))
        .otherwise(F.array(F.lit("train")))
    )
    return marked.withColumn("split", F.explode(sides)).drop("chosen", "__n")
