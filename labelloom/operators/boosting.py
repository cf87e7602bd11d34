"""Boosted trees for all classes at once, grown level by level from histograms that Spark sums.

Features are binned once, at quantiles of a bounded sample, and the rows packed into blocks of a few hundred. A round grows one
tree per class against the softmax loss. A level of all its trees is one Spark job: tasks sum gradients and curvatures by (class,
node, feature, bin), the sums are shuffled by node and feature chunk, where cumulative sums give the best split, and
only these (at most classes x nodes x chunks rows) come back. So 100 trees of depth 6 are at most 600 jobs, however many classes
there are, instead of a chain of jobs per class.

Blocks keep the scores of each row; every few rounds they are written anew with the trees since then added, which also cuts the
lineage. The bin of the value 0 isn't stored or shuffled (a node's total less its other bins), so hashed text features stay sparse.

The result is a Spark ML model: it can be a pipeline stage, saved and loaded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import schema as S
from labelloom.functions.hashing import uniform
from labelloom.session import materialise

BINS = 32
SAMPLE = 20_000  # bin edges are quantiles of about this many rows
BLOCK_ROWS = 1024
LEAST_ROWS = 1 << 13  # a task has at least about as many rows, so that small tables don't pay for many
TASK_ROWS = 1 << 16  # about as many rows a task once every core has one; each task sends sums of its own
CHUNK = 16  # features whose splits are searched together
GROUP_CELLS = 1 << 21  # rows of sums that one task searches
ROUNDS_HELD = 5  # rounds after which scores are written
DIGITS = 9  # gains are rounded before they are compared, so that sums in another order choose alike

CELLS = "part int, unit int, feature int, bin int, g double, h double"
PACKED = "part int, unit binary, feature binary, bin binary, g binary, h binary"  # the sums of a task for one part, in one row
SPLITS = "node int, feature int, bin int, gain double, gl double, hl double, g double, h double"


# --- trees -------------------------------------------------------------------------------------


class Trees:
    """Complete binary trees in arrays: [tree, node], children of node i are 2i + 1 and 2i + 2; feature -1 is a leaf.

    A row goes left where its bin of the feature is at most ``bin``, that is its value at most ``edge``.
    """

    def __init__(self, count: int, depth: int):
        width = (1 << (depth + 1)) - 1
        self.depth = depth
        self.feature = np.full((count, width), -1, np.int32)
        self.bin = np.zeros((count, width), np.uint8)
        self.value = np.zeros((count, width))

    def nodes(self, bins: np.ndarray, tree: int, levels: int | None = None) -> np.ndarray:
        """The node that each row (of a dense matrix of bins) reaches, at most ``levels`` deep."""
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth if levels is None else levels):
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[row, np.maximum(f, 0)] > self.bin[tree, at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray, classes: int) -> np.ndarray:
        """Sum of leaf values by class; trees are listed round by round, class by class."""
        out = np.zeros((len(bins), classes))
        for tree in range(len(self.feature)):
            out[:, tree % classes] += self.value[tree, self.nodes(bins, tree)]
        return out


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of the feature's edges below each value; ``edges`` has a row a feature, padded with infinity. NaN counts as lowest."""
    return np.stack([np.searchsorted(edges[f], values[:, f], side="left") for f in range(values.shape[1])], 1).astype(np.uint8) * ~np.isnan(values)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss by class score."""
    p = softmax(scores)
    h = np.maximum(2 * p * (1 - p), 1e-16)
    p[np.arange(len(labels)), labels] -= 1
    return p, h


# --- binning -----------------------------------------------------------------------------------


def quantile_edges(sample: list[tuple[np.ndarray, np.ndarray]], width: int, bins: int) -> np.ndarray:
    """At most ``bins - 1`` edges a feature from (indices, values) of the sampled rows; values that aren't listed are 0."""
    index = np.concatenate([i for i, _ in sample]) if sample else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in sample]) if sample else np.zeros(0)
    order = np.argsort(index, kind="stable")
    index, value = index[order], value[order]
    cuts = np.searchsorted(index, np.arange(width + 1))
    edges = np.full((width, bins - 1), np.inf)
    for f in range(width):
        own = value[cuts[f] : cuts[f + 1]]
        own = np.sort(np.concatenate((own[~np.isnan(own)], np.zeros(len(sample) - len(own)))))
        if not len(own):
            continue
        distinct = np.unique(own)
        # between neighbouring distinct values, at the quantiles; few values are told apart in full
        middle = (distinct[1:] + distinct[:-1]) / 2
        if len(middle) >= bins:
            at = own[(np.arange(1, bins) * len(own)) // bins]
            middle = np.unique(middle[np.minimum(np.searchsorted(distinct, at), len(middle) - 1)])
        edges[f, : len(middle)] = middle
    return edges


def _parts(v: dict | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(indices, values, size) of an unwrapped ML vector."""
    values = np.asarray(v["values"], dtype="float64")
    if v["type"] == 1:
        return np.arange(len(values)), values, len(values)
    return np.asarray(v["indices"], dtype="int64"), values, int(v["size"])


def blocks_of(df: DataFrame, features: str, label: str, classes: int, edges: np.ndarray) -> DataFrame:
    """Packed blocks of rows: labels, scores (0), and (row, feature, bin) of the values whose bin isn't that of 0."""
    shared = df.sparkSession.sparkContext.broadcast(edges)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits = shared.value
        for frame in frames:
            for start in range(0, len(frame), BLOCK_ROWS):
                part = frame.iloc[start : start + BLOCK_ROWS]
                rows, columns, values = [], [], []
                for r, v in enumerate(part["v"]):
                    i, x, _ = _parts(v)
                    rows.append(np.full(len(i), r)), columns.append(i), values.append(x)
                row, column, value = (np.concatenate(p) for p in (rows, columns, values))
                bins = np.zeros(len(value), np.uint8)
                order = np.argsort(column, kind="stable")
                cuts = np.searchsorted(column[order], np.arange(len(limits) + 1))
                for f in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[f] : cuts[f + 1]]
                    bins[own] = np.where(np.isnan(value[own]), 0, np.searchsorted(limits[f], value[own], side="left"))
                zero = np.array([np.searchsorted(e, 0.0, side="left") for e in limits], np.uint8)
                kept = bins != zero[column]
                packed = (part["label"].to_numpy().astype(np.int32), np.zeros((len(part), classes)), row[kept].astype(np.int32), column[kept].astype(np.int32), bins[kept])
                yield pd.DataFrame([[len(part), *(a.tobytes() for a in packed)]], columns=["n", "labels", "scores", "row", "column", "bin"])

    rows = df.select(F.unwrap_udt(features).alias("v"), F.col(label).cast("int").alias("label"))
    return rows.mapInPandas(pack, "n int, labels binary, scores binary, row binary, column binary, bin binary")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _opened(r: dict, classes: int, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, scores, dense bins) of a block."""
    bins = np.tile(zero, (r["n"], 1))
    bins[np.frombuffer(r["row"], np.int32), np.frombuffer(r["column"], np.int32)] = np.frombuffer(r["bin"], np.uint8)
    return np.frombuffer(r["labels"], np.int32), np.frombuffer(r["scores"], np.float64).reshape(r["n"], classes), bins


# --- growing -----------------------------------------------------------------------------------


def best_splits(sums: np.ndarray, zero: np.ndarray, totals: np.ndarray, reg: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, gain, left sums) of the best split of each unit of a node and some features; the first of equals.

    ``sums[unit, feature, bin] = (g, h)`` lacks the bins of 0, ``zero[unit, feature]``, which get what is missing to ``totals[unit]``.
    """
    units, features, bins, _ = sums.shape
    filled = sums.copy()
    filled[np.arange(units)[:, None], np.arange(features)[None, :], zero] += totals[:, None, :] - filled.sum(axis=2)
    left = filled.cumsum(axis=2)[:, :, :-1]
    right = totals[:, None, None, :] - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + reg)
    gain = score(left) + score(right) - score(totals)[:, None, None]
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), np.round(gain, DIGITS), -np.inf)
    flat = gain.reshape(units, -1)
    best = flat.argmax(axis=1)
    at = np.arange(units)
    return best // (bins - 1), best % (bins - 1), flat[at, best], left.reshape(units, -1, 2)[at, best]


def _level(blocks: DataFrame, tasks: int, held: Trees, growing: Trees, level: int, classes: int, zero: np.ndarray, bins: int, reg: float, least: float) -> pd.DataFrame:
    """Best split of every node of a level of the growing trees, with the node's own sums; node numbers run through all trees.

    A unit is a node with CHUNK features. Units are dealt to as many tasks as keep each one's rows bounded.
    """
    first, count, features = (1 << level) - 1, 1 << level, len(zero)
    chunks = -(-features // CHUNK)
    space = count * features * bins
    groups = max(1, min(classes * count * chunks, -(-tasks * classes * space // GROUP_CELLS)))
    names = [c.split()[0] for c in CELLS.split(", ")]

    def batch(node: np.ndarray, feature: np.ndarray, bin_: np.ndarray, g: np.ndarray, h: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
        numbers = ((node * chunks + chunk) % groups, node * chunks + chunk, feature, bin_)
        return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in numbers), pa.array(g), pa.array(h)], names=names)

    def sums_of(key: np.ndarray, g: np.ndarray, h: np.ndarray, k: int) -> pa.RecordBatch:
        node, rest = np.divmod(key, features * bins)
        feature, bin_ = np.divmod(rest, bins)
        return batch(node + k * count, feature, bin_, g, h, feature // CHUNK)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = classes * space <= 1 << 23  # 128 MB of sums; beyond it each block sends its own
        sums = np.zeros((classes, 2, space)) if whole else None
        totals = np.zeros((2, classes * count))
        for part in batches:
            for r in _rows(part):
                labels, scores, dense = _opened(r, classes, zero)
                g, h = gradients(scores + held.scores(dense, classes), labels)
                row = np.frombuffer(r["row"], np.int32)
                cell = np.frombuffer(r["column"], np.int32).astype(np.int64) * bins + np.frombuffer(r["bin"], np.uint8)
                for k in range(classes):
                    node = growing.nodes(dense, k, level) - first
                    inside = node >= 0  # rows in a leaf above take no part
                    own = np.ascontiguousarray(g[:, k]), np.ascontiguousarray(h[:, k])
                    for j, x in enumerate(own):
                        totals[j, k * count : (k + 1) * count] += np.bincount(node[inside], x[inside], count)
                    every = inside.all()
                    at = row if every else row[inside[row]]
                    key = (node * (features * bins))[at] + (cell if every else cell[inside[row]])
                    if whole:
                        for j, x in enumerate(own):
                            sums[k, j] += np.bincount(key, x[at], space)
                    elif len(key):
                        key, back = np.unique(key, return_inverse=True)
                        yield sums_of(key, np.bincount(back, own[0][at]), np.bincount(back, own[1][at]), k)
        if whole:
            for k in range(classes):
                key = np.flatnonzero(sums[k, 1])
                yield sums_of(key, sums[k, 0, key], sums[k, 1, key], k)
        used = np.flatnonzero(totals[1])
        for chunk in range(chunks):
            no_feature = np.full(len(used), -1)
            yield batch(used, no_feature, no_feature * 0, totals[0, used], totals[1, used], np.full(len(used), chunk))

    def search(part: pa.Table) -> pa.Table:
        if not len(part):
            return none
        unit, feature, bin_, g, h = (part[c].to_numpy() for c in names[1:])
        listed, place = np.unique(unit, return_inverse=True)
        own = np.flatnonzero(feature < 0)
        totals = np.stack([np.bincount(place[own], x[own], len(listed)) for x in (g, h)], 1)
        size = CHUNK * bins
        order = np.argsort(place, kind="stable")
        order = order[feature[order] >= 0]
        found = []
        step = max(1, (1 << 21) // size)  # a few units at a time, so that their dense table stays small
        cuts = np.searchsorted(place[order], np.arange(0, len(listed) + step, step))
        for k, start in enumerate(range(0, len(listed), step)):
            some = listed[start : start + step]
            mine = order[cuts[k] : cuts[k + 1]]
            key = (place[mine] - start) * size + (feature[mine] % CHUNK) * bins + bin_[mine]
            sums = np.stack([np.bincount(key, x[mine], len(some) * size).astype(np.float64) for x in (g, h)], 1).reshape(len(some), CHUNK, bins, 2)
            from_ = (some % chunks) * CHUNK
            zeros = padded[from_[:, None] + np.arange(CHUNK)]
            f, b, gain, left = best_splits(sums, zeros, totals[start : start + step], reg, least)
            found.append((some // chunks, from_ + f, b, gain, left[:, 0], left[:, 1], *totals[start : start + step].T))
        return pa.table([np.concatenate(c).astype(kind) for c, kind in zip(zip(*found), kinds)], names=outs)

    outs, kinds = [c.split()[0] for c in SPLITS.split(", ")], [np.int32] * 3 + [np.float64] * 5
    none = pa.table([np.zeros(0, kind) for kind in kinds], names=outs)
    padded = np.zeros(chunks * CHUNK, np.int64)
    padded[:features] = zero

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(cells(batches)))
        for g in range(groups):
            yield from search(own.filter(pc.equal(own["part"], g))).to_batches()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums as few rows: millions of small ones would cost more to exchange than to sum."""
        for own in cells(batches):
            part, *columns = (own.column(c).to_numpy() for c in names)
            order = np.argsort(part, kind="stable")
            parts, first = np.unique(part[order], return_index=True)
            cuts = [*first, len(part)]
            listed = [pa.array([c[order[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *listed], names=names)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for own in batches:
            for r in _rows(own):
                held.setdefault(r["part"], []).append(r)
        for part, rows in held.items():
            kinds_in = [np.int32] * 4 + [np.float64] * 2
            columns = [np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in list(zip(names, kinds_in))[1:]]
            yield from search(pa.table([np.full(len(columns[0]), part, np.int32), *columns], names=names)).to_batches()

    if tasks == 1:  # the sums of the only task are those of all rows: nothing to exchange
        found = blocks.mapInArrow(alone, SPLITS).toPandas()
    else:
        found = blocks.mapInArrow(packed, PACKED).repartition(groups, "part").mapInArrow(searched, SPLITS).toPandas()
    # of the units the largest gain, then the smallest feature
    return found.sort_values(["node", "gain", "feature"], ascending=[True, False, True]).drop_duplicates("node")


def _settle(growing: Trees, splits: pd.DataFrame, level: int, rate: float, reg: float) -> bool:
    """Writes a level's splits and the values of its nodes and their children; false if no node was split."""
    first, count = (1 << level) - 1, 1 << level
    any_split = False
    for s in splits.itertuples():
        tree, node = divmod(s.node, count)
        node += first
        growing.value[tree, node] = -rate * s.g / (s.h + reg)
        if s.feature >= 0 and s.gain > 0:
            any_split = True
            growing.feature[tree, node], growing.bin[tree, node] = s.feature, s.bin
            growing.value[tree, 2 * node + 1] = -rate * s.gl / (s.hl + reg)
            growing.value[tree, 2 * node + 2] = -rate * (s.g - s.gl) / (s.h - s.hl + reg)
    return any_split


def _joined(parts: list[Trees], depth: int) -> Trees:
    out = Trees(0, depth)
    for name in ("feature", "bin", "value"):
        setattr(out, name, np.concatenate([getattr(out, name), *(getattr(p, name) for p in parts)]))
    return out


def task_count(rows: int, cores: int) -> int:
    """Tasks of a level: as many as there are cores where each then has LEAST_ROWS, more where they would exceed TASK_ROWS."""
    return max(1, min(-(-rows // LEAST_ROWS), max(cores, -(-rows // TASK_ROWS))))


def fit_trees(
    df: DataFrame,
    classes: int,
    *,
    features: str = "features",
    label: str = "label",
    trees: int = 100,
    depth: int = 6,
    rate: float = 0.1,
    bins: int = BINS,
    reg: float = 1.0,
    least: float = 1.0,
    seed: int = S.SEED,
) -> tuple[Trees, np.ndarray]:
    """(trees, bin edges) fitted to the log loss: ``trees`` rounds with one tree per class each.

    ``label`` holds class numbers from 0. ``reg`` is added to the curvature of a leaf, a child needs a curvature of ``least``.
    """
    if not 2 <= bins <= 256 or depth < 1:
        raise ValueError("2 to 256 bins and a depth of at least 1")
    rows = materialise(df.filter(F.col(features).isNotNull()).select(features, label, F.monotonically_increasing_id().alias("__n")))
    n = rows.count()
    picked = rows.filter(uniform(seed, "bins", "__n") < min(1.0, SAMPLE / max(n, 1)))
    sample = [_parts(r["v"]) for r in picked.select(F.unwrap_udt(features).alias("v")).collect()]  # about SAMPLE rows
    if not sample:
        return Trees(0, depth), np.zeros((0, bins - 1))
    edges = quantile_edges([(i, v) for i, v, _ in sample], sample[0][2], bins)
    zero = np.array([np.searchsorted(e, 0.0, side="left") for e in edges], np.uint8)
    rows = rows.repartition(task_count(n, df.sparkSession.sparkContext.defaultParallelism))
    blocks = materialise(blocks_of(rows, features, label, classes, edges))
    tasks = blocks.select(F.spark_partition_id()).distinct().count()
    done: list[Trees] = []
    held: list[Trees] = []
    for _ in range(trees):
        growing, since = Trees(classes, depth), _joined(held, depth)
        for level in range(depth):
            if not _settle(growing, _level(blocks, tasks, since, growing, level, classes, zero, bins, reg, least), level, rate, reg):
                break
        if (growing.feature[:, 0] < 0).all():
            break  # no root has a split that gains anything
        held.append(growing)
        done.append(growing)
        if len(held) == ROUNDS_HELD:
            blocks, held = materialise(_rescored(blocks, _joined(held, depth), classes, zero)), []
    return _joined(done, depth), edges


def _rescored(blocks: DataFrame, held: Trees, classes: int, zero: np.ndarray) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            new = []
            for r in _rows(part):
                _, scores, dense = _opened(r, classes, zero)
                new.append((scores + held.scores(dense, classes)).tobytes())
            yield part.set_column(part.schema.get_field_index("scores"), "scores", pa.array(new, pa.binary()))

    return blocks.mapInArrow(add, blocks.schema)


# --- the ML stage ------------------------------------------------------------------------------


class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """Fitted boosted trees as a pipeline stage: class number, probabilities and scores of each row."""

    classes = Param(Params._dummy(), "classes", "number of classes", typeConverter=TypeConverters.toInt)

    def __init__(self, trees: Trees | None = None, edges: np.ndarray | None = None, classes: int = 0, **columns: str):
        super().__init__()
        self.trees, self.edges = trees, edges
        self._set(classes=classes, **columns)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.getOrDefault(self.classes)
        shared = dataset.sparkSession.sparkContext.broadcast((self.trees, self.edges))

        @F.pandas_udf("array<double>")
        def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            trees, edges = shared.value
            for frame in frames:
                out = np.zeros((len(frame), classes))
                if len(trees.feature) and len(frame):
                    dense = np.zeros((len(frame), len(edges)))
                    for k, (kind, _, indices, values) in enumerate(frame[["type", "size", "indices", "values"]].itertuples(index=False, name=None)):
                        dense[k, slice(None) if kind == 1 else indices] = values
                    out = trees.scores(binned(dense, edges), classes)
                yield pd.Series(list(out))

        scores = self.getRawPredictionCol()
        scored = dataset.withColumn(scores, raw(F.unwrap_udt(self.getFeaturesCol())))
        top = F.array_max(scores)
        e = F.transform(scores, lambda x: F.exp(x - top))
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return scored.withColumns(
            {
                self.getProbabilityCol(): F.transform(e, lambda x: x / total),
                self.getPredictionCol(): (F.array_position(scores, top) - 1).cast("double"),
            }
        )

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, m = SparkSession.active(), self.model
        DefaultParamsWriter.saveMetadata(m, path, spark)
        nodes = [(k, m.trees.depth, m.trees.feature[k].tolist(), m.trees.bin[k].astype(int).tolist(), m.trees.value[k].tolist()) for k in range(len(m.trees.feature))]
        spark.createDataFrame(nodes, "tree int, depth int, feature array<int>, bin array<int>, value array<double>").write.parquet(f"{path}/trees")
        edges = [(k, [x for x in e.tolist() if x < np.inf], m.edges.shape[1]) for k, e in enumerate(m.edges)]
        spark.createDataFrame(edges, "feature int, edges array<double>, width int").write.parquet(f"{path}/edges")


class _Reader(MLReader):
    def load(self, path: str) -> BoostedTreesModel:
        spark = SparkSession.active()
        rows = sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: r["tree"])
        trees = Trees(len(rows), rows[0]["depth"] if rows else 1)
        for k, r in enumerate(rows):
            trees.feature[k], trees.bin[k], trees.value[k] = r["feature"], r["bin"], r["value"]
        listed = sorted(spark.read.parquet(f"{path}/edges").collect(), key=lambda r: r["feature"])
        edges = np.full((len(listed), listed[0]["width"] if listed else 0), np.inf)
        for k, r in enumerate(listed):
            edges[k, : len(r["edges"])] = r["edges"]
        model = BoostedTreesModel(trees, edges)
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
