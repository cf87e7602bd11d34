"""Exact ranks, cuts and samples that stay parallel when one group holds most of the rows.

A plain ``row_number() over (partition by group)`` sorts a whole group in one task. Here the order
key is first mapped to a monotone bucket; a small histogram of (group, bucket) counts gives each
bucket its offset, so only rows of one bucket are ever sorted together. The histogram is a
map-side-combined aggregate with at most ``groups x buckets`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.functions.hashing import HASH_BITS, hash_int
from labelloom.session import materialise

MAX_BUCKETS = 1 << 24  # bits of a hash that tell buckets apart
MAX_QUANTILES = 2048  # bounds that a row is compared with in two steps
LEVEL_BITS = 16  # bits of a hash that tell a task which rows can still be among the first


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions: a hot group then fills the cluster."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, min(MAX_BUCKETS, configured))


def _hash_bucket(h: Column, buckets: int) -> Column:
    return F.shiftright(F.shiftright(h, HASH_BITS - 32) * F.lit(buckets).cast("bigint"), 32).cast("int")


def _quantile_bucket(df: DataFrame, column: str, buckets: int) -> Column:
    """Monotone bucket of a numeric column: the number of its approximate quantiles below the value.

    Quantiles follow the rows, so that outlying values and gaps don't leave the rest in one bucket. They
    are read first (at most MAX_QUANTILES numbers) and searched in two steps.
    """
    buckets = min(buckets, MAX_QUANTILES)
    if buckets < 2:
        return F.lit(0)
    value = F.col(column).cast("double")
    shares = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(df.agg(F.percentile_approx(value, shares, 20 * MAX_QUANTILES)).first()[0] or []))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(x) for x in bounds])
    some = F.array(*[F.lit(x) for x in bounds[step - 1 :: step]])
    below = F.size(F.filter(some, lambda x: x < value)) * step
    inside = F.size(F.filter(F.slice(every, below + 1, F.lit(step)), lambda x: x < value))
    return F.coalesce(below + inside, F.lit(0)).cast("int")


def _bucketed_rank(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str, size_out: str | None
) -> DataFrame:
    rows = df.withColumn("__bucket", bucket)
    if not keys:
        rows = rows.withColumn("__group", F.lit(0))
    group = keys or ["__group"]
    counted = rows.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__count"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counted.select(
        *group,
        "__bucket",
        (F.sum("__count").over(upto) - F.col("__count")).alias("__offset"),
        F.sum("__count").over(whole).alias("__size"),
    )
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    ranked = rows.join(offsets, [*group, "__bucket"]).withColumn(
        out, (F.col("__offset") + F.row_number().over(inside) - F.lit(1)).cast("bigint")
    )
    if size_out:
        ranked = ranked.withColumn(size_out, F.col("__size").cast("bigint"))
    return ranked.select(*df.columns, out, *([size_out] if size_out else []))


def hash_rank(
    df: DataFrame,
    keys: list[str],
    *,
    seed: int,
    salt: str,
    id_col: str,
    out: str = "rank",
    size_out: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group's seeded random order."""
    rows = df.withColumn("__h", hash_int(seed, salt, id_col))
    ranked = _bucketed_rank(
        rows, keys, _hash_bucket(F.col("__h"), bucket_count(df)), [F.col("__h"), F.col(id_col)], out, size_out
    )
    return ranked.drop("__h")


def order_rank(
    df: DataFrame,
    keys: list[str],
    order_col: str,
    *,
    out: str = "rank",
    size_out: str | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, ordered by a unique numeric column.

    With no keys this is a global row index. ``bounds_from`` names a cheaper frame (a bare scan) that
    has the same distribution of the order column.
    """
    bucket = _quantile_bucket(df if bounds_from is None else bounds_from, order_col, bucket_count(df))
    return _bucketed_rank(df, keys, bucket, [F.col(order_col)], out, size_out)


def hash_cuts(
    df: DataFrame,
    keys: list[str],
    want: Callable[[Column], Column],
    *,
    seed: int,
    salt: str,
    id_col: str,
) -> DataFrame:
    """One row per group: the (hash, id) of the last row among the first ``want(group size)``.

    Reads only keys and id. Of each group, only the bucket in which the cut falls is sorted, so the
    wide rows never need a shuffle to be split or sampled.
    """
    buckets = bucket_count(df)
    narrow = df.select(*keys, F.col(id_col), hash_int(seed, salt, id_col).alias("__h"))
    narrow = narrow.withColumn("__bucket", _hash_bucket(F.col("__h"), buckets))
    if not keys:
        narrow = narrow.withColumn("__group", F.lit(0))
    group = keys or ["__group"]
    counted = narrow.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__count"))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        counted.withColumn("__before", F.sum("__count").over(upto) - F.col("__count"))
        .withColumn("__size", F.sum("__count").over(whole))
        .withColumn("__need", want(F.col("__size")).cast("bigint") - F.col("__before"))
        .filter((F.col("__need") > 0) & (F.col("__need") <= F.col("__count")))
        .select(*group, "__bucket", "__need", "__size")
    )
    inside = Window.partitionBy(*group).orderBy("__h", id_col)
    return (
        narrow.join(edge, [*group, "__bucket"])
        .withColumn("__rn", F.row_number().over(inside))
        .filter(F.col("__rn") == F.col("__need"))
        .select(*keys, F.col("__h").alias("cut_hash"), F.col(id_col).alias("cut_id"), F.col("__size").alias("cut_size"))
    )


def mark_first(
    df: DataFrame,
    keys: list[str],
    want: Callable[[Column], Column],
    *,
    seed: int,
    salt: str,
    id_col: str,
    out: str = "chosen",
    size_out: str | None = None,
) -> DataFrame:
    """Flag, per group, exactly the first ``want(n)`` rows of the seeded random order.

    The cuts (one record per group) are written first: their known size lets Spark broadcast them,
    so the wide rows are flagged where they are read; a larger table is sort-merged, with hot groups
    split by adaptive execution.
    """
    cuts = hash_cuts(df, keys, want, seed=seed, salt=salt, id_col=id_col)
    rows = df.withColumn("__h", hash_int(seed, salt, id_col))
    h = F.col("__h")
    if keys:
        joined = rows.join(materialise(cuts), keys, "left")
        cut_hash, cut_id = F.col("cut_hash"), F.col("cut_id")
    else:
        joined = rows
        cut = cuts.select(F.struct("cut_hash", "cut_id").alias("cut")).scalar()
        cut_hash, cut_id = cut["cut_hash"], cut["cut_id"]
    first = (h < cut_hash) | ((h == cut_hash) & (F.col(id_col) <= cut_id))
    sizes = [F.col("cut_size").alias(size_out)] if size_out else []
    return joined.select(*df.columns, F.coalesce(first, F.lit(False)).alias(out), *sizes)


def running_total(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], weight: str, *, out: str = "before"
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the group, in the order given.

    ``bucket`` must not decrease along the order. Bucket sums are prefix-summed first, so that one
    task only ever sees the bucket sums of a group, or the rows of one bucket.
    """
    rows = df.withColumn("__bucket", bucket)
    if not keys:
        rows = rows.withColumn("__group", F.lit(0))
    group = keys or ["__group"]
    sums = rows.groupBy(*group, "__bucket").agg(F.sum(weight).alias("__sum"))
    upto = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select(*group, "__bucket", (F.sum("__sum").over(upto) - F.col("__sum")).alias("__offset"))
    inside = (
        Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.join(offsets, [*group, "__bucket"]).select(
        *df.columns, (F.col("__offset") + F.sum(weight).over(inside) - F.col(weight)).alias(out)
    )


def hex_bucket(column: str) -> Column:
    """First three digits of a hex string: 4096 buckets in its order."""
    return F.substring(F.col(column), 1, 3)


def sample_n(df: DataFrame, n: int | Column, *, id_col: str, seed: int, salt: str = "sample") -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement. Nothing passes through the driver."""
    limit = F.lit(n) if isinstance(n, int) else n
    marked = mark_first(
        df, [], lambda size: F.least(size, limit.cast("bigint")), seed=seed, salt=salt, id_col=id_col, out="__chosen"
    )
    return marked.filter("__chosen").drop("__chosen")


def first_candidates(df: DataFrame, n: int | Column, *, id_col: str, seed: int, salt: str = "sample") -> DataFrame:
    """The rows of which ``sample_n`` with the same seed and salt can choose, found in one pass without a shuffle.

    Each task counts its rows by the leading bits of their hash. Once ``n`` rows lie at or below a level, rows above it are
    dropped. The memory is one histogram, whatever ``n``; about ``n * (1 + ln(rows / n))`` rows of a task are left. A null ``n`` is 0.
    """
    limit = F.lit(n) if isinstance(n, int) else n
    numbered = df.withColumns({"__h": hash_int(seed, salt, id_col), "__n": F.coalesce(limit.cast("bigint"), F.lit(0).cast("bigint"))})
    kept, shift = df.columns, HASH_BITS - LEVEL_BITS

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, edge = np.zeros(1 << LEVEL_BITS, np.int64), (1 << LEVEL_BITS) - 1
        for batch in batches:
            if not batch.num_rows:
                continue
            level = batch.column("__h").to_numpy() >> shift
            counts += np.bincount(level, minlength=len(counts))
            edge = min(edge, int(np.searchsorted(np.cumsum(counts), batch.column("__n")[0].as_py())))
            yield batch.select(kept).filter(pa.array(level <= edge))

    return numbered.mapInArrow(below, df.schema)


def head_per_group(df: DataFrame, keys: list[str], order_col: str, n: int) -> DataFrame:
    """First n rows of each group. The literal bound lets Spark prune each map task to n rows a group."""
    window = Window.partitionBy(*keys).orderBy(order_col)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")
