"""A kept index of vectors in cells, and exact or approximate nearest-neighbour search that reads only some cells.

``build_index`` trains cell centres once on a bounded sample and writes every vector into the folder of its cell,
with the numbers that bound what a cell can hold: how many vectors, how far they lie from the centre, how long they are.
``append`` puts more vectors into the same cells. Centres and bounds are at most MAX_CELLS rows; vectors never pass the driver.

``search`` is exact by default and runs in two rounds. First each query meets its nearest cells, which gives a k-th
best score. Then it meets only those other cells whose bound can still beat that score. With ``probes`` only the nearest
cells are read: approximate, one round. Either way the cells to read are a filter on the folder column, so the rest of the
index isn't read at all, and (cell, block, block) tasks of bounded size do the products.

The answer of the exact search doesn't depend on the centres; its work does: with vectors that don't cluster, bounds exclude
little and most cells are met.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelloom import schema as S
from labelloom.functions.hashing import hash_int, uniform
from labelloom.functions.ranking import bucket_count
from labelloom.operators.similarity import BLOCK, SENT, top_k_matches
from labelloom.session import ensure_checkpoint_dir, materialise

MAX_CELLS = 2048  # bounds the centres on the driver and in each task
SAMPLE_PER_CELL = 64  # the centres are trained on at most this many vectors a cell
SLACK = 1e-6  # covers rounding of scores (9 digits) and of bounds, relative to the lengths


@dataclass
class CellBounds:
    """What a cell can hold: its centre, and of its members the number, largest distance, widest angle and largest length."""

    centres: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    length: np.ndarray


@dataclass
class VectorIndex:
    """Where the vectors lie, and the bounds of the cells."""

    spark: SparkSession
    path: str
    keys: list[str]
    id_col: str
    vector: str
    schema: T.StructType
    cells: CellBounds

    @property
    def vectors(self) -> DataFrame:
        """The indexed rows with the folder column ``cell``."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def read_cells(self, cells: list[int]) -> DataFrame:
        """The rows of some cells; the scan leaves out the folders of the others."""
        return self.vectors.filter(F.col("cell").isin([int(c) for c in cells]) if cells else F.lit(False))


# --- building ----------------------------------------------------------------------------------


def train_centres(df: DataFrame, cells: int, rows: int, *, id_col: str, vector: str, seed: int = S.SEED) -> np.ndarray:
    """At most ``cells`` centres from a seeded sample of about SAMPLE_PER_CELL vectors a cell. Any centres give exact answers."""
    share = min(1.0, cells * SAMPLE_PER_CELL / max(rows, 1))
    known = df.filter(F.col(vector).isNotNull() & (uniform(seed, "cell", id_col) < share)).select(F.col(vector).alias("v"))
    sample = materialise(known.distinct())
    cells = min(cells, sample.count())  # no more centres than different vectors
    if cells < 2:
        means = sample.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).orderBy("p").toPandas()  # a row a dimension
        return means["x"].to_numpy(dtype="float64").reshape(1, -1)
    model = KMeans(k=cells, seed=seed, maxIter=8, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    return np.unique(np.array(model.clusterCenters()), axis=0)


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * vectors @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    a, b = np.linalg.norm(vectors, axis=1)[:, None], np.linalg.norm(centres, axis=1)[None, :]
    scale = a * b
    return np.arccos(np.clip(vectors @ centres.T / np.where(scale > 0, scale, 1.0), -1.0, 1.0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in column])


def _write(index: VectorIndex, df: DataFrame) -> None:
    """Adds the rows of ``df`` to the folders of their cells and their bounds to those of the cells."""
    columns = [*index.keys, index.id_col, index.vector]
    rows = df.filter(F.col(index.vector).isNotNull()).select(*columns)
    shared = index.spark.sparkContext.broadcast(index.cells.centres)
    at = index.vector

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle = shared.value
        for frame in frames:
            if frame.empty:
                continue
            vectors = _matrix(frame[at])
            far = _distances(vectors, middle)
            cell = far.argmin(axis=1)
            own = np.arange(len(cell))
            yield frame.assign(
                cell=cell.astype("int32"), __far=far[own, cell], __angle=_angles(vectors, middle)[own, cell], __length=np.linalg.norm(vectors, axis=1)
            )

    measured = T.StructType(
        [*rows.schema.fields, T.StructField("cell", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("__far", "__angle", "__length")]]
    )
    placed = materialise(rows.mapInPandas(assign, measured))  # read for the bounds and the write
    bounds = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("__far").alias("radius"), F.max("__angle").alias("angle"), F.max("__length").alias("length")
    )
    bounds.write.mode("append").parquet(f"{index.path}/bounds")  # at most a row a cell
    # by ranges of (cell, hash): a cell that holds most vectors is many files, small cells share a task
    narrow = placed.select(*columns, "cell").withColumn("__h", hash_int(S.SEED, "file", index.id_col))
    ordered = narrow.repartitionByRange(bucket_count(df), "cell", "__h").drop("__h")
    ordered.write.mode("append").partitionBy("cell").parquet(f"{index.path}/vectors")


def _with_bounds(index: VectorIndex) -> VectorIndex:
    """The index as its files are now."""
    m = len(index.cells.centres)
    kinds = {"n": "sum", "radius": "max", "angle": "max", "length": "max"}
    stored = index.spark.read.schema("cell int, n long, radius double, angle double, length double").parquet(f"{index.path}/bounds")
    found = stored.groupBy("cell").agg(*[getattr(F, kind)(c).alias(c) for c, kind in kinds.items()]).toPandas()  # at most MAX_CELLS rows
    at = found["cell"].to_numpy(dtype="int64")
    filled = {c: np.zeros(m, np.int64 if c == "n" else np.float64) for c in kinds}
    for c in kinds:
        filled[c][at] = found[c].to_numpy()
    return replace(index, cells=CellBounds(index.cells.centres, filled["n"], filled["radius"], filled["angle"], filled["length"]))


def scratch_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/labelloom-index-{uuid.uuid4().hex}"


def build_index(
    df: DataFrame,
    path: str | None = None,
    *,
    keys: list[str] | None = None,
    id_col: str = S.ROW_ID,
    vector: str = "vector",
    cells: int | None = None,
    block: int = BLOCK,
    seed: int = S.SEED,
) -> VectorIndex:
    """Index every row of ``df`` with a vector under ``path`` (a shared folder; by default one in the checkpoint folder).

    ``cells`` defaults to one per ``block`` vectors. ``keys`` are kept with the vectors: a search then only matches rows with equal keys.
    """
    spark, keys = df.sparkSession, keys or []
    df = df.select(*keys, id_col, F.col(vector).cast("array<double>").alias(vector))
    rows = df.filter(F.col(vector).isNotNull()).count()
    cells = max(1, min(MAX_CELLS, -(-rows // block) if cells is None else cells))
    centres = train_centres(df, cells, rows, id_col=id_col, vector=vector, seed=seed)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
    path = path or scratch_path(spark)
    meta = json.dumps({"keys": keys, "id_col": id_col, "vector": vector, "schema": schema.json()})
    listed = spark.createDataFrame([(k, c.tolist(), meta) for k, c in enumerate(centres)], "cell int, centre array<double>, meta string")
    listed.write.parquet(f"{path}/centres")
    index = VectorIndex(spark, path, keys, id_col, vector, schema, _unfilled(centres))
    _write(index, df)
    return _with_bounds(index)


def _unfilled(centres: np.ndarray) -> CellBounds:
    m = len(centres)
    return CellBounds(centres, np.zeros(m, np.int64), np.zeros(m), np.zeros(m), np.zeros(m))


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was written before, by this or another session."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])  # at most MAX_CELLS
    meta = json.loads(rows[0]["meta"])
    schema = T.StructType.fromJson(json.loads(meta["schema"]))
    centres = np.array([r["centre"] for r in rows])
    return _with_bounds(VectorIndex(spark, path, meta["keys"], meta["id_col"], meta["vector"], schema, _unfilled(centres)))


def append(index: VectorIndex, df: DataFrame) -> VectorIndex:
    """More rows for the same cells; the index that comes back sees them. Centres stay as trained."""
    _write(index, df.withColumn(index.vector, F.col(index.vector).cast("array<double>")))
    return _with_bounds(index)


# --- searching ---------------------------------------------------------------------------------


def best_possible(cells: CellBounds, vectors: np.ndarray, metric: str) -> np.ndarray:
    """For each vector and cell, a score that no member of the cell exceeds (for ``l2`` the negative squared distance)."""
    if metric == "l2":
        gap = np.maximum(_distances(vectors, cells.centres) - cells.radius[None, :], 0.0)
        bound = -(gap**2)
    else:
        lengths = np.linalg.norm(vectors, axis=1)[:, None]
        by_ball = vectors @ cells.centres.T + lengths * cells.radius[None, :]
        # the angle to a member is at least that to the centre less the widest one of the cell
        nearest = np.cos(np.maximum(_angles(vectors, cells.centres) - cells.angle[None, :], 0.0))
        by_cone = lengths * cells.length[None, :] * np.maximum(nearest, 0.0)
        # a centre or vector of length 0 has no direction
        flat = (np.linalg.norm(cells.centres, axis=1) == 0)[None, :] | (lengths == 0)
        bound = np.where(flat, by_ball, np.minimum(by_ball, by_cone))
    bound[:, cells.count == 0] = -np.inf
    return bound


def _slack(cells: CellBounds, vectors: np.ndarray, metric: str) -> np.ndarray:
    lengths, longest = np.linalg.norm(vectors, axis=1), cells.length.max(initial=0.0)
    return SLACK * (1.0 + ((lengths + longest) ** 2 if metric == "l2" else lengths * longest))


def _visits(index: VectorIndex, queries: DataFrame, metric: str, first: int, second: bool) -> DataFrame:
    """A row per query and cell that it has to meet: in the first round the ``first`` most promising cells, in the second those
    others whose bound reaches the ``__kth`` score (null: none known, so all). ``__cells``, if there, lists the cells of the query's keys."""
    shared = queries.sparkSession.sparkContext.broadcast(index.cells)
    kept = [f for f in queries.schema.fields if f.name not in ("__kth", "__cells")]
    schema = T.StructType([*kept, T.StructField("cell", T.IntegerType())])

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        for frame in frames:
            if frame.empty or not cells.count.any():
                continue
            vectors = _matrix(frame["__v"])
            bound = best_possible(cells, vectors, metric)
            if "__cells" in frame:
                own = np.zeros(bound.shape, bool)
                for i, listed in enumerate(frame["__cells"]):
                    own[i, np.asarray(listed, dtype="int64")] = True
                bound[~own] = -np.inf
            order = np.argsort(-bound, axis=1, kind="stable")[:, :first]
            near = np.zeros(bound.shape, bool)
            np.put_along_axis(near, order, True, axis=1)
            if second:
                least = frame["__kth"].fillna(-np.inf).to_numpy(dtype="float64") - _slack(cells, vectors, metric)
                near = ~near & (bound >= least[:, None])
            row, cell = np.nonzero(near & np.isfinite(bound))
            frame = frame.drop(columns=["__kth", "__cells"], errors="ignore")
            # a query may meet every cell: a batch's visits leave in pieces
            for at in range(0, len(row), SENT):
                yield frame.iloc[row[at : at + SENT]].assign(cell=cell[at : at + SENT].astype("int32"))

    return queries.mapInPandas(choose, schema)


def search(
    index: VectorIndex,
    queries: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    vector: str = "vector",
    metric: str = "l2",
    probes: int | None = None,
    exclude_self: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """The k best indexed rows of every query: (query_id, base_id, score, rank), ties to the smaller base id.

    Exact without ``probes``; with it only that many cells a query are read. Queries need different ids. ``metric`` is
    ``dot`` (higher is better) or ``l2`` (squared distance, lower is better). Null vectors take no part.
    """
    rounds = search_rounds(index, queries, k, query_id=query_id, vector=vector, metric=metric, probes=probes, exclude_self=exclude_self, block=block)
    return rounds["result"]


def search_rounds(
    index: VectorIndex, queries: DataFrame, k: int, *, query_id: str, vector: str, metric: str, probes: int | None, exclude_self: bool, block: int
) -> dict[str, DataFrame]:
    """``result`` of ``search``, and the cells met in the ``first`` and ``second`` round."""
    keys = index.keys
    rows = queries.filter(F.col(vector).isNotNull()).select(*keys, F.col(query_id).alias("__id"), F.col(vector).cast("array<double>").alias("__v"))
    if keys:
        # at most MAX_CELLS numbers a key
        rows = rows.join(index.vectors.groupBy(*keys).agg(F.collect_set("cell").alias("__cells")), keys)

    def meet(visits: DataFrame) -> DataFrame:
        cells = [r["cell"] for r in visits.select("cell").distinct().collect()]  # at most MAX_CELLS numbers
        base = index.read_cells(cells).select(*keys, "cell", F.col(index.id_col).alias("base_id"), F.col(index.vector).alias("__v"))
        found = top_k_matches(
            visits, base, k, keys=[*keys, "cell"], query_id="__id", base_id="base_id", vector="__v", metric=metric, exclude_self=exclude_self, block=block
        )
        return found.select("query_id", "base_id", "score", "rank")

    first = materialise(_visits(index, rows, metric, probes or 1, False))
    found = meet(first)
    if probes:
        return {"result": found, "first": first}
    found = materialise(found)
    kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("__q"), (-F.col("score") if metric == "l2" else F.col("score")).alias("__kth"))
    bounded = rows.join(kth, F.col("__id") == F.col("__q"), "left").drop("__q")
    second = materialise(_visits(index, bounded, metric, 1, True))
    better = F.asc("score") if metric == "l2" else F.desc("score")
    both = found.unionByName(meet(second)).drop("rank")
    per_query = Window.partitionBy("query_id").orderBy(better, "base_id")
    result = both.withColumn("rank", F.row_number().over(per_query).cast("bigint")).filter(F.col("rank") <= k)
    return {"result": result, "first": first, "second": second}


def pruned_top_k(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    base_id: str = "base_id",
    vector: str = "vector",
    metric: str = "dot",
    cells: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``top_k_matches`` without keys, but each query only meets cells that can hold one of its k best."""
    index = build_index(base, id_col=base_id, vector=vector, cells=cells, block=block)
    return search(index, queries, k, query_id=query_id, vector=vector, metric=metric, block=block)


def knn_join_indexed(df: DataFrame, k: int, index: VectorIndex, *, vector: str = "vector", probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """``knn_join`` against a kept index: k nearest other rows with equal keys by squared L2 distance."""
    found = search(index, df, k, query_id=index.id_col, vector=vector, metric="l2", probes=probes, exclude_self=True, block=block)
    return found.select(F.col("query_id").alias(index.id_col), F.col("base_id").alias("neighbour_id"), F.col("score").alias("distance2"), "rank")

