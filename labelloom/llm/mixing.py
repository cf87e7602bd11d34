"""Mixing sources to target weights by systematic sampling.

Every source has a target in words. A document of the source is expected target / source size times in
the mix. The expected copies are summed up along the source, in the order of size class and
hash; one random offset per source is added, and a document is emitted once for each integer
boundary that its share of the sum crosses. Neighbours along the sum have like sizes, which keeps
the words taken near the target.

All documents of a source have the same expected copies, so the prefix sum of a document is its rank
times that rate. Ranks come from a histogram over (source, size class, slot): the slots, one per
shuffle partition, split a source or a size that holds most rows, and one task ranks only the
rows of one slot.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a source
without words has target 0 and nothing is taken; a null id is an id of its own; repeated rows are
documents of their own (they are ranked among themselves; being equal, any order gives the same rows);
an empty table gives an empty mix. Columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.functions.hashing import HASH_BITS, hash_int, uniform

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2


def water_fill(sizes: list[int], weights: list[int], budget: float, most: int) -> list[float]:
    """Targets in proportion to the weights, none above ``most`` times its size; the excess goes to the others."""
    targets = [0.0] * len(sizes)
    open_, left = [k for k, s in enumerate(sizes) if s > 0], budget
    while open_:
        share = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if share * weights[k] > most * sizes[k]]
        if not full:
            for k in open_:
                targets[k] = share * weights[k]
            break
        for k in full:
            targets[k] = float(most * sizes[k])
            left -= targets[k]
        open_ = [k for k in open_ if k not in full]
    return targets


def source_targets(docs: DataFrame, *, source: str, size: str, weights=WEIGHTS, budget=BUDGET, most=MAX_REPEATS) -> DataFrame:
    """(source, source_size, target), one row per source. The number of sources is that of a mixing table, not of the data."""
    spark = docs.sparkSession
    sums = docs.groupBy(source).agg(F.sum(size).alias("n")).collect()
    sums = sorted(sums, key=lambda r: (r[source] is None, (r[source] or "").encode()))
    sizes = [int(r["n"] or 0) for r in sums]
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(sums))], budget * sum(sizes), most)
    rows = [(r[source], n, t) for r, n, t in zip(sums, sizes, targets)]
    return spark.createDataFrame(rows, f"`{source}` string, source_size long, target double")


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def mix(
    docs: DataFrame,
    *,
    source: str = "source",
    id_col: str = "doc_id",
    seed: int = 11,
    weights=WEIGHTS,
    budget: float = BUDGET,
    most: int = MAX_REPEATS,
) -> DataFrame:
    """Documents with ``size`` get ``source_size``, ``target`` and ``copies`` (0 to ``most``); one row per document.

    The order along a source is (size class, hash of the id). Slots are monotone in the hash, so
    neither the order nor the result depends on how many there are.
    """
    docs = docs.drop("source_size", "target", "copies").withColumn(source, F.col(source).cast("string"))
    targets = source_targets(docs, source=source, size="size", weights=weights, budget=budget, most=most)
    slots = max(1, min(2048, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    hashed = hash_int(seed, "mix", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = (
        docs.withColumn("__class", F.floor(F.sqrt(F.col("size").cast("double"))))
        .withColumn("__hash", hashed)
        .withColumn("__slot", F.shiftright(F.col("__hash") * F.lit(slots).cast("long"), HASH_BITS))
    )
    group = [source, "__class", "__slot"]
    along = Window.partitionBy(source).orderBy("__class", "__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0)))
        .select(*[F.col(c).alias(f"__b{k}") for k, c in enumerate(group)], "__before")
    )
    inside = Window.partitionBy(*group).orderBy("__hash", "size")
    ranked = rows.withColumn("__rank", F.row_number().over(inside) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"__b{k}")) for k, c in enumerate(group)]
    placed = ranked.join(before, same[0] & same[1] & same[2]).drop(*[f"__b{k}" for k in range(3)])
    targets = targets.withColumnRenamed(source, "__s")
    placed = placed.join(targets, F.col(source).eqNullSafe(F.col("__s"))).drop("__s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = uniform(seed, "offset", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")))
    place = (F.col("__before") + F.col("__rank")).cast("double")
    copies = F.floor((place + 1) * rate + offset) - F.floor(place * rate + offset)
    return placed.withColumn("copies", copies.cast("int")).drop("__class", "__hash", "__slot", "__before", "__rank")


def expand(mixed: DataFrame) -> DataFrame:
    """One row per copy; documents that the mix doesn't take are gone."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def _hash_sql(seed: int, salt: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}|{salt}|' || {key}), 1, 13))::BIGINT"


#: The mix of ``documents`` with the default parameters, in DuckDB.
ORACLE = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT as size,
         {_hash_sql(11, "mix", "coalesce(doc_id::varchar, '')")} as h
  from documents
), sources as (
  select source, sum(size)::BIGINT as n, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w
  from sized group by source
), filled as (
  select *, 1.5 * sum(n) over () as budget, coalesce(sum(2 * n) over (order by 2 * n / w, source rows between unbounded preceding and 1 preceding), 0) as capped,
         sum(w) over (order by 2 * n / w, source rows between current row and unbounded following) as open_w
  from sources where n > 0
), share as (
  select min_by((budget - capped)::DOUBLE / open_w::DOUBLE, 2 * n / w) as s from filled where (budget - capped)::DOUBLE / open_w::DOUBLE * w <= 2 * n
), targets as (
  select source, n, case when n = 0 then 0.0 else least((2 * n)::DOUBLE, coalesce((select s from share), 1e300) * w::DOUBLE) end as target,
         {_hash_sql(11, "offset", "coalesce('s' || source, '')")}::DOUBLE / 4503599627370496.0 as u
  from sources
), placed as (
  select d.doc_id, d.size, t.n as source_size, t.target, t.u, case when t.n > 0 then t.target / t.n::DOUBLE else 0.0 end as rate,
         (row_number() over (partition by d.source order by floor(sqrt(d.size::DOUBLE)), d.h, d.size) - 1)::DOUBLE as place
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target::DOUBLE as target,
       ((floor((place + 1) * rate + u) - floor(place * rate + u))::BIGINT * size)::BIGINT as taken
from placed
"""
