"""Synthetic vectors by interpolation between neighbours of a class, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.hashing import hash_mod, uniform
from labelloom.functions.ranking import hex_bucket, order_rank, running_total
from labelloom.operators.balance import explode_copies
from labelloom.operators.similarity import nearest_original, neighbours_of
from labelloom.session import materialise


def smote_plan(
    df: DataFrame,
    target: int | None = None,
    *,
    keys: list[str],
    neighbours: int | None = None,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
    vector: str = "vector",
) -> DataFrame:
    """(keys, n, i, base_id, neighbour_id, lambda) for every synthetic point of the short classes.

    ``neighbours=None`` means n - 1: every other row of the class is a neighbour, so the neighbour is
    a seeded place among them and no distances are needed. Otherwise the k nearest rows are found
    first (k = min(neighbours, n - 1)). Classes of one row have no neighbour and are left out.
    """
    counts = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    goal = F.lit(target).cast("bigint") if target is not None else counts.agg(F.max("n")).scalar()
    short = counts.withColumn("need", goal - F.col("n")).filter("need > 0 AND n > 1")
    points = explode_copies(short, F.col("need"), keys, "t").withColumn("i", F.col("n") + F.col("t"))
    points = points.withColumn("place", hash_mod(F.col("n"), seed, "smote_base", *keys, "i"))
    placed = order_rank(
        df.join(short.select(*keys), keys, "left_semi").select(*keys, id_col), keys, id_col, out="place"
    )
    based = points.join(placed, [*keys, "place"]).withColumnRenamed(id_col, "base_id")
    lam = uniform(seed, "smote_lambda", *keys, "i").alias("lambda")
    if neighbours is None:
        step = hash_mod(F.col("n") - 1, seed, "smote_neighbour", *keys, "i") + 1
        other = placed.withColumnRenamed(id_col, "neighbour_id").withColumnRenamed("place", "other")
        return (
            based.withColumn("other", (F.col("place") + step) % F.col("n"))
            .join(other, [*keys, "other"])
            .select(*keys, "n", "i", "base_id", "neighbour_id", lam)
        )
    based = materialise(based)
    in_short = df.join(short.select(*keys), keys, "left_semi").select(*keys, id_col, vector)
    # only rows drawn as a base need neighbours
    bases = in_short.join(based.select(F.col("base_id").alias(id_col)).distinct(), id_col, "left_semi")
    near = neighbours_of(bases, in_short, neighbours, keys=keys, id_col=id_col, vector=vector).select(
        F.col(id_col).alias("base_id"), "neighbour_id", "rank"
    )
    pick = hash_mod(F.least(F.lit(neighbours).cast("bigint"), F.col("n") - 1), seed, "smote_neighbour", *keys, "i") + 1
    return based.withColumn("rank", pick).join(near, ["base_id", "rank"]).select(
        *keys, "n", "i", "base_id", "neighbour_id", lam
    )


def smote_vectors(
    df: DataFrame,
    target: int | None = None,
    *,
    keys: list[str],
    neighbours: int | None = None,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
    vector: str = "vector",
) -> DataFrame:
    """The synthetic points ``x + lambda * (neighbour - x)``; number i continues after the originals."""
    plan = smote_plan(df, target, keys=keys, neighbours=neighbours, seed=seed, id_col=id_col, vector=vector)
    values = df.select(F.col(id_col).alias("__id"), F.col(vector).cast("array<double>").alias("__v"))
    base = values.select(F.col("__id").alias("base_id"), F.col("__v").alias("__x"))
    near = values.select(F.col("__id").alias("neighbour_id"), F.col("__v").alias("__y"))
    lam = F.col("lambda")
    return (
        plan.join(base, "base_id")
        .join(near, "neighbour_id")
        .withColumn("vector", F.zip_with("__x", "__y", lambda x, y: x + lam * (y - x)))
        .drop("__x", "__y")
    )


def _class_vectors(df: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
    known = df.filter(F.col(S.DOMAIN).isNotNull() & F.col(S.TOPIC).isNotNull())
    return materialise(known.select(id_col, *S.CLASS).join(vectors.select(id_col, "vector"), id_col))


def _with_nearest(points: DataFrame, vectors: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    named = points.withColumn("synthetic_id", F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("i").cast("string")))
    best = nearest_original(named, vectors, keys=keys, id_col=id_col)
    return named.join(best, "synthetic_id")


def smote_texts(
    df: DataFrame,
    vectors: DataFrame,
    target: int | None = None,
    *,
    neighbours: int | None = None,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """Synthetic rows: each point takes the text of the nearest original of its class.

    ``vectors`` holds (id, vector) of every row.
    """
    keys = S.CLASS
    known = df.filter(F.col(S.DOMAIN).isNotNull() & F.col(S.TOPIC).isNotNull())
    placed = _class_vectors(df, vectors, id_col)
    points = materialise(smote_vectors(placed, target, keys=keys, neighbours=neighbours, seed=seed, id_col=id_col))
    near = _with_nearest(points, placed, keys, id_col)
    texts = known.select(id_col, S.DESCRIPTION)
    number = (F.col("i") - F.col("n") + 1).cast("string")
    return near.join(texts, id_col).select(
        F.col(id_col).alias("source_id"),
        "i",
        F.concat(F.lit("synthetic_"), F.col(S.DOMAIN), F.lit("_"), F.col(S.TOPIC), F.lit("_"), F.col("i").cast("string")).alias(S.NAME),
        F.concat(F.lit("SMOTE Generated ("), number, F.lit("): Based on "), F.col(S.DESCRIPTION)).alias(S.DESCRIPTION),
        *keys,
    )


def simple_smote_texts(
    df: DataFrame,
    vectors: DataFrame,
    *,
    neighbours: int = 5,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """The plain form: nearest original over all rows, fixed text prefix.

    Names are numbered through after the originals, class by class.
    """
    keys = S.CLASS
    known = df.filter(F.col(S.DOMAIN).isNotNull() & F.col(S.TOPIC).isNotNull())
    placed = _class_vectors(df, vectors, id_col)
    points = materialise(smote_vectors(placed, None, keys=keys, neighbours=neighbours, seed=seed, id_col=id_col))
    named = points.withColumn("synthetic_id", F.concat_ws("|", *keys, F.col("i").cast("string")))
    best = nearest_original(named, placed, id_col=id_col)
    counts = materialise(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    made = F.when(F.col("__n") > 1, counts.agg(F.max("__n")).scalar() - F.col("__n")).otherwise(0)
    marked = counts.withColumns({"__made": made, "__md5": F.md5(F.concat_ws("|", *keys))})
    started = running_total(marked, [], hex_bucket("__md5"), ["__md5", *keys], "__made", out="__first").select(*keys, "__first")
    number = counts.agg(F.sum("__n")).scalar() + F.col("__first") + F.col("i") - F.col("n")
    return (
        named.join(best, "synthetic_id")
        .join(started, keys)
        .join(known.select(id_col, S.DESCRIPTION), id_col)
        .select(
            F.col(id_col).alias("source_id"),
            F.concat(F.lit("synthetic_"), number.cast("string")).alias(S.NAME),
            F.concat(F.lit("SYNTHETIC - Based on: "), F.col(S.DESCRIPTION)).alias(S.DESCRIPTION),
            *keys,
        )
    )
