"""Equi-joins in which a few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom import schema as S
from labelloom.functions.hashing import hash_mod
from labelloom.functions.ranking import bucket_count
from labelloom.session import materialise

HOT_SHARE = 0.01
MAX_SALTS = 64


def join_hot(
    left: DataFrame, right: DataFrame, on: str, how: str = "inner", *, id_col: str = S.ROW_ID, share: float = HOT_SHARE
) -> DataFrame:
    """Join on one key; keys that may hold more than ``share`` of the left rows are salted.

    One narrow pass finds every such key, and at most 1 / share in all, so the list is bounded. Left rows
    of a hot key are spread over the salts, right rows of a hot key are repeated for each salt; all
    other rows keep salt 0. The result is the plain join.
    """
    salts = min(MAX_SALTS, bucket_count(left))
    hot = left.select(on).freqItems([on], share).scalar()
    is_hot = F.coalesce(F.array_contains(hot, F.col(on)), F.lit(False))
    zero = F.lit(0).cast("bigint")
    spread = left.withColumn("__salt", F.when(is_hot, hash_mod(salts, S.SEED, "salt", id_col)).otherwise(zero))
    every = F.sequence(zero, F.lit(salts - 1).cast("bigint"))
    repeated = right.withColumn("__salt", F.explode(F.when(is_hot, every).otherwise(F.array(zero))))
    return spread.join(repeated, [on, "__salt"], how).drop("__salt")


def as_of_join(left: DataFrame, right: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row of equal ``key`` whose ``on`` is not larger; null where there is none.
    Of several right rows at one place the largest value counts.

    Both sides are sorted together by (key, on) into ranges, so a hot key spans many tasks. Inside a range the last
    value is carried along; into a range it comes from a table of at most one row per range and key. Null keys have no match.
    """
    columns = left.columns
    rows = left.select(F.struct(*columns).alias("__row"), F.col(key).alias("__k"), F.col(on).alias("__on"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    marks = right.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).select(
        F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.col(key).alias("__k"), F.col(on).alias("__on"), F.col(value).alias("__v")
    )
    # of equal places the right side comes first
    both = rows.unionByName(marks).withColumn("__left", F.col("__row").isNotNull())
    salt = F.xxhash64("__row")  # many rows at one place of one key still part into ranges
    order = ["__k", "__on", "__left", "__v", "__salt"]
    ranged = both.withColumn("__salt", salt).repartitionByRange(max(2, bucket_count(left)), *order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()).drop("__salt"))
    part = F.shiftright("__at", 33)
    last = placed.filter("__v is not null").groupBy("__k", part.alias("__part")).agg(F.max_by("__v", "__at").alias("__last"))
    parts = placed.groupBy("__k", part.alias("__part")).agg(F.lit(1).alias("__one")).drop("__one").join(last, ["__k", "__part"], "left")
    before = Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialise(parts.select("__k", "__part", F.last("__last", ignorenulls=True).over(before).alias("__carried")).filter("__carried is not null"))
    inside = Window.partitionBy("__part", "__k").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = placed.withColumn("__part", part).withColumn("__seen", F.last("__v", ignorenulls=True).over(inside)).filter("__row is not null")
    return seen.join(carried, ["__k", "__part"], "left").select("__row.*", F.coalesce("__seen", "__carried").alias(value))
