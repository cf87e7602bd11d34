"""Exact nearest neighbours, template matching and similarity joins on dense vectors.

Nothing here forms a cross join or emits candidate pairs. Vectors are shuffled into cells of bounded
size; a task multiplies two small matrices and returns only what belongs to the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelloom import schema as S
from labelloom.functions.hashing import hash_int, hash_mod
from labelloom.functions.ranking import bucket_count, head_per_group
from labelloom.functions.vectors import unit
from labelloom.session import materialise

BLOCK = 2048  # vectors of one side in one task
SENT = 8192  # rows of one batch that a task returns
BROADCAST_FLOATS = 4_000_000  # at most 32 MB of doubles are sent to every executor
MAX_PIVOTS = 2048  # bounds the pivot table on the driver and in each task
ANGLE_SLACK = 1e-6  # covers the rounding of arccos near 1
DIGITS = 9  # similarities are rounded before ranking, so that ties are ties in every engine
CELL_SCORES = 1 << 22  # similarities held at once
MANY_VISITS = 12  # visits a vector, from which on cells are made larger
WIDE_BLOCK = 65_536  # most vectors of one side in one task where bounds exclude few cells
WIDE_FLOATS = 1 << 22  # most numbers of such a side
PIECE = 1 << 15  # pairs tested exactly at once


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in column])


def dense(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow list column, all of one length, as a matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(lengths), lengths[0] if len(lengths) else 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank from 1) of the k best scores of each row, lowest id first on ties."""
    width = scores.shape[1]
    k = min(k, width)
    kth = np.partition(scores, width - k, axis=1)[:, width - k]
    row, column = np.nonzero(scores >= kth[:, None])
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    keep = rank <= k
    return row[keep], column[keep], rank[keep]


def _spec(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


# --- top-k matches -----------------------------------------------------------------------------


def top_k_matches(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    *,
    keys: list[str] | None = None,
    query_id: str = "query_id",
    base_id: str = "base_id",
    vector: str = "vector",
    metric: str = "dot",
    exclude_self: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """The k best base rows of every query row, within equal ``keys``: (query_id, base_id, score, rank).

    ``metric`` is ``dot`` (higher is better) or ``l2`` (squared distance, lower is better). Both
    sides are cut into hash blocks of about ``block`` rows per key; each (key, query block, base
    block) cell is one small matrix product that returns at most k rows per query, and the cell
    answers are merged per query. A key that holds most rows is simply more cells. Null vectors take no part.
    """
    keys = keys or []
    q = queries.filter(F.col(vector).isNotNull()).select(*keys, F.col(query_id).alias("__id"), F.col(vector).alias("__v"))
    b = base.filter(F.col(vector).isNotNull()).select(*keys, F.col(base_id).alias("__id"), F.col(vector).alias("__v"))
    in_blocks = F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("bigint")

    def sized(df: DataFrame) -> DataFrame:
        """Adds the number of query and base blocks of the row's key."""
        if not keys:
            counts = {name: side.agg(in_blocks).scalar() for name, side in (("__qn", q), ("__bn", b))}
            return df.withColumns(counts).filter("__qn > 0 AND __bn > 0")
        per_key = q.groupBy(*keys).agg(in_blocks.alias("__qn")).join(b.groupBy(*keys).agg(in_blocks.alias("__bn")), keys)
        return df.join(per_key, keys)

    one = F.lit(1).cast("bigint")
    cell = F.struct(*keys, "__qb", "__bb").alias("__cell")
    qs = (
        sized(q)
        .withColumn("__qb", hash_mod(F.col("__qn"), S.SEED, "block", "__id"))
        .withColumn("__bb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__bn") - one)))
        .select(cell, "__id", "__v")
    )
    bs = (
        sized(b)
        .withColumn("__bb", hash_mod(F.col("__bn"), S.SEED, "block", "__id"))
        .withColumn("__qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__qn") - one)))
        .select(cell, "__id", "__v")
    )
    schema = T.StructType(
        [
            T.StructField("query_id", _spec(queries, query_id)),
            T.StructField("base_id", _spec(base, base_id)),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": left["__id"].iloc[:0], "base_id": right["__id"].iloc[:0], "score": np.zeros(0)})
        lm, rm = _matrix(left["__v"]), _matrix(right["__v"])
        lid, rid = left["__id"].to_numpy(), right["__id"].to_numpy()
        scores = lm @ rm.T
        if metric == "l2":
            scores = 2 * scores - (lm**2).sum(1)[:, None] - (rm**2).sum(1)[None, :]
        scores = np.round(scores, DIGITS)
        if exclude_self:
            scores[lid[:, None] == rid[None, :]] = -np.inf
        owner, picks, _ = _best(rid, scores, k)
        values = scores[owner, picks]
        known = np.isfinite(values)
        return pd.DataFrame({"query_id": lid[owner[known]], "base_id": rid[picks[known]], "score": values[known]})

    found = qs.groupBy("__cell").cogroup(bs.groupBy("__cell")).applyInPandas(match, schema)
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id")
    ranked = found.withColumn("rank", F.row_number().over(per_query).cast("bigint")).filter(F.col("rank") <= k)
    score = (-F.col("score")) if metric == "l2" else F.col("score")
    return ranked.withColumn("score", score + F.lit(0.0))


def knn_join(
    df: DataFrame, k: int, *, keys: list[str], id_col: str = S.ROW_ID, vector: str = "vector", block: int = BLOCK
) -> DataFrame:
    """k nearest other rows of the same class by squared L2 distance (a flat index per class)."""
    return neighbours_of(df, df, k, keys=keys, id_col=id_col, vector=vector, block=block)


def neighbours_of(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    *,
    keys: list[str],
    id_col: str = S.ROW_ID,
    vector: str = "vector",
    block: int = BLOCK,
) -> DataFrame:
    """``knn_join`` for some rows only."""
    return top_k_matches(
        queries, base, k, keys=keys, query_id=id_col, base_id=id_col, vector=vector, metric="l2", exclude_self=True, block=block
    ).select(
        F.col("query_id").alias(id_col), F.col("base_id").alias("neighbour_id"), F.col("score").alias("distance2"), "rank"
    )


def nearest_original(
    synthetic: DataFrame,
    originals: DataFrame,
    *,
    keys: list[str] | None = None,
    synthetic_id: str = "synthetic_id",
    id_col: str = S.ROW_ID,
    vector: str = "vector",
    cells: int | None = None,
) -> DataFrame:
    """For each synthetic vector the original with the largest dot product (lowest id on ties).

    Without ``keys`` all originals are candidates: a vector then only meets the cells of originals whose bounds can hold its best.
    """
    from labelloom.operators.vectorindex import pruned_top_k

    sides = {"query_id": synthetic_id, "base_id": id_col, "vector": vector}
    found = top_k_matches(synthetic, originals, 1, keys=keys, **sides) if keys else pruned_top_k(synthetic, originals, 1, cells=cells, **sides)
    return found.select(F.col("query_id").alias(synthetic_id), F.col("base_id").alias(id_col), F.col("score").alias("dot"))


def nearest_template(
    df: DataFrame,
    templates: DataFrame,
    k: int = S.TEMPLATE_TOP_K,
    *,
    id_col: str = S.ROW_ID,
    vector: str = "vector",
    template_id: str = "template_id",
    max_floats: int = BROADCAST_FLOATS,
    cells: int | None = None,
) -> DataFrame:
    """Top-k templates of every row by cosine: (id, template_id, confidence, rank).

    Templates whose measured size is within ``max_floats`` are broadcast, and each Arrow batch of rows
    is matched where it was read, without a shuffle. A larger template table goes through
    ``pruned_top_k``, with the same answer. Null vectors take no part on either side.
    """
    from labelloom.operators.vectorindex import pruned_top_k

    templates = templates.filter(F.col(vector).isNotNull())
    size = templates.agg(F.sum(F.size(vector)).alias("floats"), F.count(F.lit(1)).alias("n")).first()
    unit_templates = templates.select(template_id, unit(vector).alias(vector))
    if (size["floats"] or 0) > max_floats:
        rows = df.select(id_col, unit(vector).alias(vector))
        return pruned_top_k(rows, unit_templates, k, query_id=id_col, base_id=template_id, vector=vector, cells=cells).select(
            F.col("query_id").alias(id_col), F.col("base_id").alias(template_id), F.col("score").alias("confidence"), "rank"
        )
    kept = unit_templates.toPandas()  # bounded by the size check above
    ids = kept[template_id].to_numpy()
    matrix = _matrix(kept[vector]) if len(kept) else np.zeros((0, 1))
    shared = df.sparkSession.sparkContext.broadcast((ids, matrix))
    schema = T.StructType(
        [
            T.StructField(id_col, _spec(df, id_col)),
            T.StructField(template_id, _spec(templates, template_id)),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("rank", T.LongType()),
        ]
    )

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, right = shared.value
        for frame in frames:
            frame = frame[frame[vector].notna()]
            if frame.empty or not len(names):
                continue
            left = _matrix(frame[vector])
            lengths = np.linalg.norm(left, axis=1, keepdims=True)
            sims = np.round((left / np.where(lengths > 0, lengths, 1.0)) @ right.T, DIGITS)
            rows = frame[id_col].to_numpy()
            owner, picks, rank = _best(names, sims, k)
            yield pd.DataFrame(
                {id_col: rows[owner], template_id: names[picks], "confidence": sims[owner, picks], "rank": rank}
            )

    return df.select(id_col, vector).mapInPandas(score, schema)


# --- threshold join ----------------------------------------------------------------------------


def pairs_above(left: np.ndarray, right: np.ndarray, threshold: float, *, inclusive: bool = False, one_side: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of (i, j, similarity): every pair of rows above the threshold, of those with i < j where both sides are one block.

    Products in single precision find the candidates, with more slack than they can err; each candidate is then computed in
    double precision. Where many are candidates, their part of the product is computed whole.
    """
    l32, r32 = left.astype("float32"), right.astype("float32")
    longest = [float(np.sqrt(np.max(x, initial=0.0, where=np.isfinite(x)))) for x in (np.einsum("ij,ij->i", m, m) for m in (left, right))]
    low = np.float32(threshold - (left.shape[1] + 8) * 2.0**-22 * max(1.0, longest[0] * longest[1]))
    step = max(1, CELL_SCORES // max(1, len(right)))
    for first in range(0, len(left), step):
        start = first if one_side else 0
        near = l32[first : first + step] @ r32[start:].T
        width = near.shape[1]
        found = np.flatnonzero(near > low)
        whole = (left[first : first + step] @ right[start:].T).ravel() if len(found) > near.size // 16 else None
        for piece in range(0, len(found), PIECE):
            at = found[piece : piece + PIECE]
            i = at // width
            j = at - i * width + start
            i += first
            if one_side:
                at, i, j = (x[i < j] for x in (at, i, j))
            sims = np.round(np.einsum("ij,ij->i", left[i], right[j]) if whole is None else whole[at], DIGITS)
            keep = (sims >= threshold) if inclusive else (sims > threshold)
            yield i[keep], j[keep], sims[keep]


class Sides:
    """The rows of the two sides of a task, and its answer: pairs with the smaller id first and what the rows carry."""

    def __init__(self, batches: Iterator[pa.RecordBatch], one_side: bool, carried: list[str]):
        names = ["__id", "__c", *carried]
        parts = [(b.column("__left").to_numpy(zero_copy_only=False).astype(bool), dense(b.column("__v")), [b.column(c) for c in names]) for b in batches if b.num_rows]
        self.left = self.right = np.zeros((0, 0))
        if not parts:
            return
        side, vectors = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.concatenate([np.flatnonzero(side), np.flatnonzero(~side)])  # the left side comes first
        n = int(side.sum())
        columns = (pa.concat_arrays([p[2][k] for p in parts]).take(pa.array(order)) for k in range(len(names)))
        self.columns = dict(zip(names, columns))
        self.ids = self.columns["__id"].to_numpy(zero_copy_only=False)
        self.classes = pd.factorize(self.columns["__c"].to_numpy(zero_copy_only=False))[0]  # null is one class
        self.carried, self.shift = carried, 0 if one_side else n
        self.left = vectors[side]
        self.right = self.left if one_side else vectors[~side]

    def answer(self, i: np.ndarray, j: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
        j = j + self.shift
        swap = self.ids[i] > self.ids[j]
        first, second = (pa.array(x) for x in (np.where(swap, j, i), np.where(swap, i, j)))
        out = {"id1": self.columns["__id"].take(first), "id2": self.columns["__id"].take(second), "similarity": pa.array(sims)}
        for c in self.carried:
            out |= {f"{c}1": self.columns[c].take(first), f"{c}2": self.columns[c].take(second)}
        return pa.RecordBatch.from_pydict(out)


def pair_schema(df: DataFrame, id_col: str, carry: dict[str, str]) -> T.StructType:
    fields = [("id1", _spec(df, id_col)), ("id2", _spec(df, id_col)), ("similarity", T.DoubleType())]
    return T.StructType([T.StructField(n, t) for n, t in [*fields, *((f"{c}{k}", _spec(df, column)) for c, column in carry.items() for k in (1, 2))]])


def _pivots(df: DataFrame, id_col: str, vector: str, count: int) -> np.ndarray:
    """A bounded seeded sample of distinct vectors: cell centres. Any choice gives the same answer."""
    rows = (
        df.filter(F.col(vector).isNotNull())
        .select(vector, hash_int(S.SEED, "pivot", id_col).alias("__h"))
        .orderBy("__h")
        .limit(count)
        .toPandas()
    )
    if rows.empty:
        return np.zeros((0, 1))
    vectors = np.unique(_matrix(rows[vector]), axis=0)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(lengths > 0, lengths, 1.0))[lengths[:, 0] > 0]


def similarity_pairs(
    df: DataFrame,
    threshold: float,
    *,
    id_col: str = S.ROW_ID,
    vector: str = "vector",
    differ: str | None = None,
    pivots: int | None = None,
    block: int = BLOCK,
    inclusive: bool = False,
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """All pairs (id1 < id2) of unit vectors with cosine above ``threshold``: exact. Null ids and vectors take no part.

    Each vector has the cell of its nearest pivot as its home. By the triangle inequality on angles, a
    vector can only match vectors of another cell j when its angle to pivot j is at most the radius
    of cell j plus the threshold angle, and exceeds the angle to its own pivot by at most twice the
    threshold angle; only there it is sent as a visitor. Cells are cut into blocks of bounded size,
    and every block pair is one task-sized matrix product. There are about as many pivots as blocks,
    so a small table is one product. With ``differ`` only pairs that differ in that column are kept. ``carry`` names columns
    (out: column) that travel with their vectors and come back as ``out1`` and ``out2``, so that pairs need no join.

    The answer is exact, so the work depends on how well the data clusters: high thresholds on
    clustered vectors meet few cells, low thresholds on spread-out vectors meet all of them. Where a vector would visit more
    than MANY_VISITS cells on average, there are fewer and larger ones instead, so that less is sent.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    fewer, carry = None, carry or {}
    if pivots is None:
        size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
        n, most = size["n"], min(WIDE_BLOCK, WIDE_FLOATS // max(1, size["d"] or 1))
        pivots = max(1, min(MAX_PIVOTS, -(-n // block)))
        wide = max(block, min(most, -(-n // MANY_VISITS)))
        fewer = max(1, -(-n // wide))
    centres = _pivots(df, id_col, vector, pivots)
    if not len(centres):
        width = df.filter(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0] or 1
        centres = np.zeros((1, width))
    shared = df.sparkSession.sparkContext.broadcast(centres)
    angle = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + ANGLE_SLACK
    rows = df.select(
        F.col(id_col).alias("__id"),
        unit(vector).alias("__v"),
        (F.col(differ).cast("string") if differ else F.lit(None).cast("string")).alias("__c"),
        *(F.col(column).alias(out) for out, column in carry.items()),
    ).filter(F.col("__v").isNotNull() & F.col("__id").isNotNull())
    radii = np.full(len(centres), np.inf)
    if len(centres) > 1:

        def widest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            middle = shared.value
            reach = np.full(len(middle), -1.0)
            for frame in frames:
                if not frame.empty:
                    angles = np.arccos(np.clip(_matrix(frame["__v"]) @ middle.T, -1.0, 1.0))
                    np.maximum.at(reach, angles.argmin(axis=1), angles.min(axis=1))
            used = np.nonzero(reach >= 0)[0]
            yield pd.DataFrame({"cell": used.astype("int32"), "radius": reach[used]})

        # at most one record per pivot comes back
        per_cell = rows.select("__v").mapInPandas(widest, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius"))
        radii = np.full(len(centres), -np.inf)
        for record in per_cell.collect():
            radii[record["cell"]] = record["radius"]
    cell_schema = T.StructType(
        [
            T.StructField("__id", _spec(df, id_col)),
            T.StructField("__v", T.ArrayType(T.DoubleType())),
            T.StructField("__c", T.StringType()),
            *(T.StructField(out, _spec(df, column)) for out, column in carry.items()),
            T.StructField("__cell", T.IntegerType()),
            T.StructField("__home", T.BooleanType()),
        ]
    )

    def homes_and_visits(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        middle = shared.value
        angles = np.arccos(np.clip(vectors @ middle.T, -1.0, 1.0))
        home = angles.argmin(axis=1)
        own = angles[np.arange(len(home)), home][:, None]
        near = (angles <= own + 2 * angle) & (angles <= radii[None, :] + angle)
        # a pair of two homes meets once, in the cell with the larger number
        later = np.arange(len(middle))[None, :] > home[:, None]
        return home, *np.nonzero(near & later)

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            home, row, cell = homes_and_visits(_matrix(frame["__v"]))
            yield frame.assign(__cell=home.astype("int32"), __home=True)
            # a vector may visit every later cell: a batch's visits leave in pieces
            for first in range(0, len(row), SENT):
                some = slice(first, first + SENT)
                yield frame.iloc[row[some]].assign(__cell=cell[some].astype("int32"), __home=False)

    def count_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stays, visits = np.zeros(len(shared.value), "int64"), np.zeros(len(shared.value), "int64")
        for frame in frames:
            if not frame.empty:
                home, _, cell = homes_and_visits(_matrix(frame["__v"]))
                np.add.at(stays, home, 1)
                np.add.at(visits, cell, 1)
        used = np.nonzero(stays + visits)[0]
        yield pd.DataFrame({"__cell": used.astype("int32"), "__stays": stays[used], "__visits": visits[used]})

    celled = rows.mapInPandas(to_cells, cell_schema)
    # one record per cell and task is shuffled to size the blocks
    counted = rows.select("__v").mapInPandas(count_cells, "__cell int, __stays long, __visits long")
    if fewer is not None and fewer < pivots:
        visits = counted.agg((F.sum("__visits") / F.sum("__stays")).alias("x")).first()["x"] or 0
        if visits > MANY_VISITS // 2:  # a pair of cells meets in one of them, so half of the cells are visited
            return similarity_pairs(df, threshold, id_col=id_col, vector=vector, differ=differ, pivots=fewer, block=wide, inclusive=inclusive, carry=carry)
    in_blocks = lambda c: F.ceil(F.sum(c) / F.lit(float(block))).cast("bigint")
    sizes = counted.groupBy("__cell").agg(in_blocks("__stays").alias("__hn"), in_blocks("__visits").alias("__vn"))
    zero = F.lit(0).cast("bigint")
    placed = celled.join(sizes, "__cell").filter("__hn > 0")
    own = placed.withColumn(
        "__block", hash_mod(F.greatest(F.when(F.col("__home"), F.col("__hn")).otherwise(F.col("__vn")), F.lit(1)), S.SEED, "block", "__id")
    )

    def target(a: Column, b: Column, visit: bool, left: bool) -> Column:
        return F.struct(F.lit(visit).alias("visit"), a.alias("a"), b.alias("b"), F.lit(left).alias("left"))

    none = F.array().cast("array<struct<visit:boolean,a:bigint,b:bigint,left:boolean>>")
    home_tasks = F.flatten(
        F.array(
            F.transform(F.sequence(F.col("__block"), F.col("__hn") - 1), lambda x: target(F.col("__block"), x, False, True)),
            # a block meets itself in the rows of its left side
            F.when(F.col("__block") > 0, F.transform(F.sequence(zero, F.greatest(F.col("__block") - 1, zero)), lambda x: target(x, F.col("__block"), False, False))).otherwise(none),
            F.when(
                F.col("__vn") > 0,
                F.transform(F.sequence(zero, F.greatest(F.col("__vn") - 1, zero)), lambda x: target(F.col("__block"), x, True, True)),
            ).otherwise(none),
        )
    )
    visit_tasks = F.transform(F.sequence(zero, F.col("__hn") - 1), lambda x: target(x, F.col("__block"), True, False))
    spread = own.withColumn("__task", F.explode(F.when(F.col("__home"), home_tasks).otherwise(visit_tasks))).select(
        "__cell", "__task.visit", "__task.a", "__task.b", F.col("__task.left").alias("__left"), "__id", "__v", "__c", *carry
    )

    def match(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visit, a, b = (x.as_py() for x in key[1:])
        alone = not visit and a == b
        sides = Sides(batches, alone, [*carry])
        if not len(sides.left) or not len(sides.right):
            return
        for i, j, sims in pairs_above(sides.left, sides.right, threshold, inclusive=inclusive, one_side=alone):
            keep = sides.ids[i] != sides.ids[j] if alone else np.ones(len(i), bool)
            if differ:
                keep &= sides.classes[i] != sides.classes[j + sides.shift]
            yield sides.answer(i[keep], j[keep], sims[keep])

    task = ["__cell", "visit", "a", "b"]
    if len(centres) > 1:  # the few bytes of a task are much work: tasks are not merged by their bytes
        spread = spread.repartition(max(bucket_count(df), min(MAX_PIVOTS, len(centres) * (len(centres) + 1))), *task)
    return spread.groupBy(*task).applyInArrow(match, pair_schema(df, id_col, carry))


def collapse_copies(df: DataFrame, by: list[str], id_col: str = S.ROW_ID) -> DataFrame:
    """One row per distinct value with its smallest id and the number of copies."""
    return df.groupBy(*by).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def similar_text_pairs(
    df: DataFrame,
    threshold: float = S.TEXT_SIMILARITY,
    *,
    id_col: str = S.ROW_ID,
    vector: str = "vector",
    topic: str = S.TOPIC,
    block: int = BLOCK,
    recall: float | None = None,
) -> DataFrame:
    """Pairs of similar texts of different topics: hard negatives.

    Rows with the same vector and topic are one entry with a copy count, so a group of copies
    never pairs with itself; a result row stands for ``copies1 * copies2`` row pairs. With ``recall`` the pairs come
    from hash buckets (``lsh_pairs``): none below the threshold, and at least about that share of the others.
    """
    from labelloom.operators.lsh import lsh_pairs

    entries = materialise(collapse_copies(df.select(id_col, vector, topic), [vector, topic], id_col))  # read by every step of the join
    options = {"id_col": id_col, "vector": vector, "differ": topic, "block": block}
    # where an id is one entry, topic and copies travel with its vector; a join would send every pair twice
    carry = {"topic": topic, "copies": "copies"} if _one_entry_an_id(entries, id_col) else {}
    pairs = similarity_pairs(entries, threshold, carry=carry, **options) if recall is None else lsh_pairs(entries, threshold, recall=recall, carry=carry, **options)
    if "copies1" in pairs.columns:
        return pairs.select("id2", "id1", "similarity", "topic1", "copies1", "topic2", "copies2")
    info = entries.select(id_col, topic, "copies")
    first = info.select(F.col(id_col).alias("id1"), F.col(topic).alias("topic1"), F.col("copies").alias("copies1"))
    second = info.select(F.col(id_col).alias("id2"), F.col(topic).alias("topic2"), F.col("copies").alias("copies2"))
    return pairs.join(first, "id1").join(second, "id2")


def _one_entry_an_id(entries: DataFrame, id_col: str) -> bool:
    return entries.agg((F.count(F.lit(1)) == F.count_distinct(id_col)).alias("one")).first()["one"]


def compare_text_pairs(
    df: DataFrame, threshold: float = S.TEXT_SIMILARITY, *, recall: float, id_col: str = S.ROW_ID, vector: str = "vector", topic: str = S.TOPIC, block: int = BLOCK
) -> DataFrame:
    """``similar_text_pairs`` with ``recall`` against the exact ones: one row with the numbers of exact pairs (``true``), of those that
    the buckets give too (``hit``), and of pairs that they give besides (``other``). Pairs are equal if their ids and similarity (six digits) are.

    There may be far more pairs than rows. Where the buckets are looked up for pairs of blocks, both joins run in the task of two
    blocks and their answers are compared there; only the rows are sent. Otherwise the pairs of both meet as hashes in a shuffle.
    """
    from labelloom.operators.lsh import compare_in_blocks

    options = {"id_col": id_col, "vector": vector, "block": block}
    entries = materialise(collapse_copies(df.select(id_col, vector, topic), [vector, topic], id_col))
    if _one_entry_an_id(entries, id_col):
        inside = compare_in_blocks(entries, threshold, recall=recall, differ=topic, **options)
        if inside is not None:
            return inside
    sides = [
        similar_text_pairs(df, threshold, recall=r, topic=topic, **options)
        .select(F.xxhash64("id1", "id2", F.round("similarity", 6)).alias("pair"), *(F.lit(n).alias(c) for n, c in zip(marks, ("true", "hit"))))
        for r, marks in ((None, (1, 0)), (recall, (0, 1)))
    ]
    # neither set is written: a pair goes to its comparison as a hash (counts stay right if two hashes are equal)
    met = sides[0].union(sides[1]).groupBy("pair").agg(F.sum("true").alias("true"), F.sum("hit").alias("hit"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return met.agg(total("true").alias("true"), total(F.least("true", "hit")).alias("hit"), total(F.greatest(F.col("hit") - F.col("true"), F.lit(0))).alias("other"))


def similar_topic_pairs(
    topics: DataFrame,
    rows: DataFrame,
    threshold: float = S.TOPIC_SIMILARITY,
    *,
    per_topic: int = 2,
    topic: str = S.TOPIC,
    vector: str = "vector",
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """For each pair of similar topic names, the first texts of one against the first of the other.

    ``topics`` holds one vector per topic name. At most ``per_topic ** 2`` pairs per topic
    pair; each unordered topic pair occurs once.
    """
    named = topics.select(F.col(topic).cast("string").alias("__name"), vector)
    pairs = similarity_pairs(named, threshold, id_col="__name", vector=vector, inclusive=True)
    heads = head_per_group(
        rows.filter(F.col(topic).isNotNull()).select(F.col(topic).cast("string").alias("__name"), id_col),
        ["__name"], id_col, per_topic,
    )
    first = heads.select(F.col("__name").alias("topic1"), F.col(id_col).alias("id1"))
    second = heads.select(F.col("__name").alias("topic2"), F.col(id_col).alias("id2"))
    return (
        pairs.select(F.col("id1").alias("topic1"), F.col("id2").alias("topic2"), "similarity")
        .join(first, "topic1")
        .join(second, "topic2")
    )
