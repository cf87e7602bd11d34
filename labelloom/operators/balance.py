"""Class balancing without an external generator: replication, variation, SMOTE text; and ``balance``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.hashing import hash_mod
from labelloom.functions.ranking import order_rank
from labelloom.operators.profile import class_counts, with_class
from labelloom.operators.split import cap_split
from labelloom.session import materialise

CHUNK = 4096  # copies made by one record before the work is spread again


def explode_copies(df: DataFrame, count: Column, spread_by: list[str], out: str) -> DataFrame:
    """Repeat each row ``count`` times with a counter ``out`` from 0.

    The counter is opened in two steps: chunk numbers first, which are then spread over the cluster,
    so neither one huge array nor one task holds all copies of a single row.
    """
    chunks = (
        df.withColumn("__count", count.cast("bigint"))
        .filter("__count > 0")
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__count") - 1) / CHUNK))))
        .repartition(*spread_by, "__chunk")
    )
    first = F.col("__chunk") * CHUNK
    last = F.least(first + CHUNK, F.col("__count")) - 1
    return chunks.withColumn(out, F.explode(F.sequence(first, last))).drop("__count", "__chunk")


def short_classes(df: DataFrame, target: int | None = None) -> DataFrame:
    """Rows of the classes below the target (default: size of the largest class), with ``n``, ``need``."""
    counts = materialise(class_counts(df))
    goal = F.lit(target).cast("bigint") if target is not None else counts.agg(F.max("n")).scalar()
    # one record per short class, of known size: the rows need no shuffle to find theirs
    needs = counts.withColumn("need", goal - F.col("n")).filter("need > 0")
    return with_class(df).join(needs, S.CLASS)


def _synthetic_name(i: Column) -> Column:
    return F.concat(
        F.lit("synthetic_"), F.col(S.DOMAIN), F.lit("_"), F.col(S.TOPIC), F.lit("_"), i.cast("string")
    )


def replicate(df: DataFrame, target: int | None = None, *, id_col: str = S.ROW_ID, min_size: int = 1) -> DataFrame:
    """Copies that fill each short class up to the target: copy i repeats row ``i % n`` of its class.

    A row that stands at place p of its class makes the copies p, p + n, p + 2n, ... itself, so no
    join from copies to rows is needed.
    """
    short = short_classes(df, target).filter(F.col("n") >= min_size)
    placed = order_rank(short, S.CLASS, id_col, out="__place", bounds_from=df)
    made = F.when(
        F.col("__place") < F.col("need"), F.floor((F.col("need") - 1 - F.col("__place")) / F.col("n")) + 1
    ).otherwise(0)
    copies = explode_copies(placed, made, [id_col], "__t")
    i = F.col("__place") + F.col("__t") * F.col("n")
    return copies.withColumn("i", i).select(
        F.col(id_col).alias("source_id"),
        "i",
        _synthetic_name(F.col("i")).alias(S.NAME),
        F.concat(F.lit("Replicated ("), (F.col("i") + 1).cast("string"), F.lit("): "), F.col(S.DESCRIPTION)).alias(
            S.DESCRIPTION
        ),
        *S.CLASS,
    )


def augment_single(
    df: DataFrame, target: int | None = None, *, seed: int = S.SEED, id_col: str = S.ROW_ID
) -> DataFrame:
    """A one-row class gets target - 1 variations, each in one of three phrasings."""
    single = short_classes(df, target).filter("n = 1")
    rows = explode_copies(single, F.col("need"), [id_col], "i")
    number = (F.col("i") + 1).cast("string")
    text = F.col(S.DESCRIPTION)
    pick = hash_mod(3, seed, "variant", id_col, "i")
    # The three phrasings.
    phrasing = (
        F.when(pick == 0, F.concat(F.lit("Alternative "), number, F.lit(": "), text))
        .when(pick == 1, F.concat(F.lit("Variant "), number, F.lit(" of: "), text))
        .otherwise(F.concat(F.lit("Similar to: "), text))
    )
    return rows.select(
        F.col(id_col).alias("source_id"),
        "i",
        _synthetic_name(F.col("i")).alias(S.NAME),
        phrasing.alias(S.DESCRIPTION),
        *S.CLASS,
    )


def _original(df: DataFrame, id_col: str) -> DataFrame:
    return with_class(df).select(
        F.col(id_col).alias("source_id"),
        *S.LABELLED_COLUMNS,
        F.lit("original").alias("origin"),
    )


def dynamic_balance(
    df: DataFrame,
    target: int | None = None,
    *,
    vectors: DataFrame | None = None,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """Every class up to the target: variations for one-row classes, else SMOTE text or replication.

    With ``vectors`` (id, vector) the larger short classes get SMOTE points turned into text; without
    them they are replicated.
    """
    from labelloom.operators.smote import smote_texts

    singles = augment_single(df, target, seed=seed, id_col=id_col).withColumn("origin", F.lit("variation"))
    if vectors is None:
        others = replicate(df, target, id_col=id_col, min_size=2).withColumn("origin", F.lit("replicated"))
    else:
        others = smote_texts(df, vectors, target, seed=seed, id_col=id_col).withColumn("origin", F.lit("smote"))
    columns = ["source_id", *S.LABELLED_COLUMNS, "origin"]
    return (
        _original(df, id_col)
        .select(*columns)
        .unionByName(singles.select(*columns))
        .unionByName(others.select(*columns))
    )


def balance(
    df: DataFrame,
    responses: DataFrame | None = None,
    cap: int = S.CLASS_CAP,
    *,
    mode: str = "all_or_nothing",
    batch_size: int = S.GENERATION_BATCH,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """Capped training set, evaluation overflow and accepted generated rows in one typed frame.

    ``split`` is train or eval, ``origin`` is original or generated. ``responses`` is the table of
    generator answers; without it short classes stay short.
    """
    from labelloom.operators.generate import accept_generated

    rows = cap_split(df, cap, seed=seed, id_col=id_col).select(
        *S.LABELLED_COLUMNS, "split", F.lit("original").alias("origin")
    )
    if responses is None:
        return rows
    accepted = accept_generated(df, responses, cap=cap, mode=mode, batch_size=batch_size)
    generated = accepted.select(*S.LABELLED_COLUMNS, F.lit("train").alias("split"), F.lit("generated").alias("origin"))
    return rows.unionByName(generated)
