"""Approximate similarity join: signed random projections in several tables, multi-probe buckets, exact re-check.

The sign bits of a vector's products with random directions are its bucket, once per table. Two vectors at a small angle
share most bits, and where they differ, the products are near 0: so each vector is kept in its own bucket and also looks into
those that differ in the one or two bits it is least sure of. All that share a bucket are compared exactly, so no
pair below the threshold comes out.

How many tables and probes a wanted recall takes follows from the threshold alone: the products of a pair at cosine s are
normal with correlation s in any dimension, so a fixed simulation of such pairs tells how often they meet.

Hot buckets are cut into blocks, and each pair of blocks is one task-sized product, as in the exact join.

A low threshold on many rows takes so many tables that a vector is sent to hundreds of buckets. Where cutting all rows into
blocks sends it to fewer places, each pair of blocks is a task instead, which looks up for its pairs above the threshold
whether they share a bucket: the same pairs, with less to send.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import schema as S
from labelloom.functions.hashing import hash_mod
from labelloom.functions.ranking import bucket_count
from labelloom.functions.vectors import unit
from labelloom.operators.similarity import BLOCK, DIGITS, WIDE_FLOATS, Sides, pair_schema, pairs_above
from labelloom.session import materialise

RECALL = 0.95
MAX_BITS = 24
MAX_TABLES = 4096  # a threshold that needs more gets an error, not a smaller recall
TRIALS = 20_000
CELL_ROWS = 65_536  # most rows of a block where all pairs of blocks meet
CELL_LOOKS = 1 << 27  # most looks of such a block, over all tables (about a byte each)
LOOK_ROWS = 4096  # rows whose buckets are found at once
CELLS_WIDE = 12  # blocks of a small table, so that their pairs fill a cluster
FEW_COPIES = 64  # places that a vector may be sent to before blocks are tried
MAX_TASKS = 2048


# --- the plan ----------------------------------------------------------------------------------


def flips(bits: int) -> np.ndarray:
    """The patterns of at most two flipped bits, one a row; the first flips none."""
    one = np.eye(bits, dtype=bool)
    two = [one[i] | one[j] for i in range(bits) for j in range(i + 1, bits)]
    return np.vstack([np.zeros((1, bits), bool), one, *([np.array(two)] if two else [])])


def meeting_chance(threshold: float, bits: int, probes: int, *, trials: int = TRIALS) -> float:
    """How often one vector of a pair at the threshold looks into the other's bucket, in one table (a lower estimate)."""
    rng = np.random.default_rng(S.SEED)
    x = rng.standard_normal((trials, bits))
    y = threshold * x + np.sqrt(1 - threshold**2) * rng.standard_normal((trials, bits))
    differ = (x > 0) != (y > 0)
    price = np.where(differ, y**2, 0).sum(1)
    cheaper = ((y**2) @ flips(bits).T < price[:, None] * (1 - 1e-12)).sum(1)
    share = ((differ.sum(1) <= 2) & (cheaper <= probes)).mean()
    return max(0.0, share - 2 * np.sqrt(share * (1 - share) / trials))


def plan(threshold: float, rows: int, *, recall: float = RECALL, bits: int | None = None, probes: int | None = None, block: int = BLOCK) -> tuple[int, int, int]:
    """(tables, bits, probes): enough bits that a bucket of unrelated vectors is a fraction of a block, and the cheapest tables and probes."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("the threshold and the recall must lie between 0 and 1")
    bits = bits or min(MAX_BITS, max(4, ceil(log2(max(rows, 1) / max(block // 8, 1))) if rows else 4))
    choices = []
    for p in [probes] if probes is not None else [1, 2, 4, 8, 16]:
        chance = meeting_chance(min(threshold, 1 - 1e-12), bits, p)
        if chance > 0:
            tables = 1 if chance >= recall else ceil(log(1 - recall) / log(1 - chance))
            choices.append((tables * (2 + p), tables, bits, p))
    if not choices or min(choices)[1] > MAX_TABLES:
        raise ValueError(f"threshold {threshold} with {bits} bits takes more than {MAX_TABLES} tables; take the exact join")
    return min(choices)[1:]


# --- the join ----------------------------------------------------------------------------------


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in column])


def buckets(vectors: np.ndarray, planes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """For each vector its bucket and the ``probes`` next ones in one table; ``planes`` has a column a bit."""
    products = vectors @ planes
    own = (products > 0) @ (1 << np.arange(bits, dtype=np.int64))
    patterns = flips(bits)
    masks = patterns @ (1 << np.arange(bits, dtype=np.int64))
    cost = (products**2) @ patterns.T
    width = min(probes + 1, len(masks))
    order = np.argsort(cost, axis=1, kind="stable")[:, :width]  # a bit without any doubt against it costs nothing: keep the own bucket first
    order[:, 0] = 0
    return own[:, None] ^ masks[order]


def lsh_pairs(
    df: DataFrame,
    threshold: float,
    *,
    id_col: str = S.ROW_ID,
    vector: str = "vector",
    differ: str | None = None,
    recall: float = RECALL,
    bits: int | None = None,
    probes: int | None = None,
    block: int = BLOCK,
    seed: int = S.SEED,
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """Pairs (id1 < id2, similarity) with cosine above ``threshold``: each is found with probability ``recall`` or more.

    With ``differ`` only pairs that differ in that column are kept. Null vectors take no part. Where blocks meet, the columns of
    ``carry`` (out: column) come back as ``out1`` and ``out2``.
    """
    rows, shared, tables, bits, probes, blocks = _prepared(df, threshold, id_col, vector, differ, recall, bits, probes, block, seed, carry or {})
    if blocks:
        return _pairs_of_blocks(rows, blocks, threshold, shared, bits, probes, bool(differ), carry or {})
    rows = rows.select("__id", "__v", "__c")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            vectors = _matrix(frame["__v"])
            for t, planes in enumerate(shared.value):
                at = buckets(vectors, planes, bits, probes)
                looked, times = np.unique(at, return_counts=True)
                stored, kept = np.unique(at[:, 0], return_counts=True)
                yield pd.DataFrame({"table": np.int32(t), "bucket": looked, "looks": times, "stored": np.zeros(len(looked), np.int64)})
                yield pd.DataFrame({"table": np.int32(t), "bucket": stored, "looks": np.zeros(len(stored), np.int64), "stored": kept})

    in_blocks = lambda c: F.ceil(F.sum(c) / F.lit(float(block))).cast("bigint")
    counted = rows.select("__v").mapInPandas(count, "table int, bucket long, looks long, stored long").groupBy("table", "bucket")
    sizes = counted.agg(in_blocks("looks").alias("__ln"), in_blocks("stored").alias("__sn"), F.sum("looks").alias("__l"))
    # a bucket where only its one vector looks has no pair
    sizes = materialise(sizes.filter("__sn > 0 AND __l > 1").drop("__l"))
    fields = [*rows.schema.fields, T.StructField("table", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("own", T.BooleanType())]

    def spread(looking: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if frame.empty:
                    continue
                vectors = _matrix(frame["__v"])
                for t, planes in enumerate(shared.value):
                    at = buckets(vectors, planes, bits, probes if looking else 0)
                    for p in range(at.shape[1]):
                        yield frame.assign(table=np.int32(t), bucket=at[:, p], own=p == 0)

        return rows.mapInPandas(run, T.StructType(fields)).join(sizes, ["table", "bucket"])

    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def dealt(side: DataFrame, own: str, other: str, own_out: str, other_out: str) -> DataFrame:
        placed = side.withColumn(own_out, hash_mod(F.col(own), S.SEED, "block", "__id"))
        placed = placed.withColumn(other_out, F.explode(F.sequence(zero, F.col(other) - one)))
        return placed.select(F.struct("table", "bucket", "__lb", "__sb").alias("__task"), "__id", "__v", "__c", "own")

    left = dealt(spread(True), "__ln", "__sn", "__lb", "__sb")
    right = dealt(spread(False), "__sn", "__ln", "__sb", "__lb")
    schema = pair_schema(rows, "__id", {})

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id1": a["__id"].iloc[:0], "id2": b["__id"].iloc[:0], "similarity": np.zeros(0)})
        sims = np.round(_matrix(a["__v"]) @ _matrix(b["__v"]).T, DIGITS)
        lid, rid = a["__id"].to_numpy(), b["__id"].to_numpy()
        keep = (sims > threshold) & (~a["own"].to_numpy(dtype=bool)[:, None] | (lid[:, None] < rid[None, :]))
        if differ:
            keep &= a["__c"].to_numpy()[:, None] != b["__c"].to_numpy()[None, :]
        i, j = np.nonzero(keep)
        return pd.DataFrame({"id1": np.minimum(lid[i], rid[j]), "id2": np.maximum(lid[i], rid[j]), "similarity": sims[i, j]})

    found = left.groupBy("__task").cogroup(right.groupBy("__task")).applyInPandas(match, schema)
    return found.groupBy("id1", "id2").agg(F.max("similarity").alias("similarity"))


def _prepared(df, threshold, id_col, vector, differ, recall, bits, probes, block, seed, carry):
    """The unit vectors, written, the directions on every executor, the plan, and the number of blocks that meet, or 0 where buckets take fewer copies."""
    rows = materialise(
        df.select(
            F.col(id_col).alias("__id"),
            unit(vector).alias("__v"),
            (F.col(differ).cast("string") if differ else F.lit(None).cast("string")).alias("__c"),
            *(F.col(column).alias(out) for out, column in carry.items()),
        ).filter(F.col("__v").isNotNull())
    )
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("__v")).alias("d")).first()
    tables, bits, probes = plan(threshold, known["n"], recall=recall, bits=bits, probes=probes, block=block)
    # dimensions x tables x bits numbers, whatever the rows
    directions = np.random.default_rng(seed).standard_normal((tables, max(known["d"] or 1, 1), bits))
    shared = df.sparkSession.sparkContext.broadcast(directions)
    blocks = cell_blocks(known["n"], tables, probes, block, bits=bits, width=known["d"] or 1)
    return rows, shared, tables, bits, probes, blocks if tables * (2 + probes) > max(FEW_COPIES, blocks) else 0


# --- all pairs of blocks -----------------------------------------------------------------------


def cell_blocks(rows: int, tables: int, probes: int, block: int = BLOCK, *, bits: int = 0, width: int = 1) -> int:
    """Blocks that all rows are cut into where every pair of blocks meets, which is how many places a vector is sent to."""
    held = max(1 + probes, 4 + len(flips(bits)) // 8 + 1 if bits else 0)  # bytes of a row in one table
    most = max(1, min(CELL_ROWS, CELL_LOOKS // (tables * held), WIDE_FLOATS // width))
    return max(1, -(-rows // most), min(-(-rows // block), CELLS_WIDE))


def looks(vectors: np.ndarray, directions: np.ndarray, bits: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(table, vector) the own buckets, and (table, vector, byte) a bit for each pattern of flips that leads to a bucket looked into."""
    patterns, powers = flips(bits), 1 << np.arange(bits, dtype=np.int64)
    width = min(probes + 1, len(patterns))
    own = np.empty((len(directions), len(vectors)), np.int32)
    into = np.empty((len(directions), len(vectors), -(-len(patterns) // 8)), np.uint8)
    turned = patterns.T.astype("float64")
    for t, planes in enumerate(directions):
        for first in range(0, len(vectors), LOOK_ROWS):
            some = slice(first, first + LOOK_ROWS)
            products = vectors[some] @ planes
            own[t, some] = (products > 0) @ powers
            cost = products**2 @ turned
            cheapest = cost <= np.partition(cost, width - 1, axis=1)[:, width - 1 : width]
            cheapest[:, 0] = True
            into[t, some] = np.packbits(cheapest, axis=1)
    return own, into


def met(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, other: np.ndarray, bits: int) -> np.ndarray:
    """Whether vector i of one block or j of the other looks into the bucket of its partner in any table.

    Rows of one id (``other`` false) only meet where one looks into a bucket that isn't its own.
    """
    masks = flips(bits) @ (1 << np.arange(bits, dtype=np.int64))
    order = np.argsort(masks)
    ranked = masks[order].astype(np.int32)
    found, todo, x, y = np.zeros(len(i), bool), np.arange(len(i)), i, j
    for t, (own_left, own_right, into_left, into_right) in enumerate(zip(a[0], b[0], a[1], b[1])):
        apart = own_left[x] ^ own_right[y]
        near = np.flatnonzero(np.bitwise_count(apart) <= 2)  # further buckets are looked into by none
        flipped = order[np.searchsorted(ranked, apart[near])]
        byte, bit = flipped >> 3, (7 - (flipped & 7)).astype(np.uint8)
        looked = ((into_left[x[near], byte] | into_right[y[near], byte]) >> bit) & 1
        hit = near[(looked == 1) & ((flipped > 0) | other[todo[near]])]
        found[todo[hit]] = True
        if t % 4 == 3:
            todo = todo[~found[todo]]
            if not len(todo):
                break
            x, y = i[todo], j[todo]
    return found


def _cells(rows: DataFrame, blocks: int, carry: list[str]) -> DataFrame:
    """Each row sent to every pair of blocks that its own is in."""
    zero, last = F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")
    # a hash of the id and the vector: rows of one id must not make a block of their own
    placed = rows.filter(F.col("__id").isNotNull()).withColumn("__block", hash_mod(F.lit(blocks).cast("bigint"), S.SEED, "cell", "__id", F.xxhash64("__v").cast("string")))
    sent = placed.withColumn("__to", F.explode(F.sequence(zero, last))).select(
        F.least("__block", "__to").alias("__a"), F.greatest("__block", "__to").alias("__b"), (F.col("__block") <= F.col("__to")).alias("__left"), "__id", "__v", "__c", *carry
    )
    tasks = max(bucket_count(rows), min(blocks * (blocks + 1) // 2, MAX_TASKS))
    return sent.repartition(tasks, "__a", "__b")


def _exact(sides: Sides, alone: bool, threshold: float, differ: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, sims in pairs_above(sides.left, sides.right, threshold, one_side=alone):
        keep = sides.classes[i] != sides.classes[j + sides.shift] if differ else slice(None)
        yield i[keep], j[keep], sims[keep]


def _hashed(sides: Sides, alone: bool, threshold: float, differ: bool, directions: np.ndarray, bits: int, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of two blocks that share a bucket and lie above the threshold."""
    a = looks(sides.left, directions, bits, probes)
    b = a if alone else looks(sides.right, directions, bits, probes)
    for i, j, sims in _exact(sides, alone, threshold, differ):
        hit = met(a, b, i, j, sides.ids[i] != sides.ids[j + sides.shift], bits)
        yield i[hit], j[hit], sims[hit]


def _pairs_of_blocks(rows: DataFrame, blocks: int, threshold: float, shared, bits: int, probes: int, differ: bool, carry: dict[str, str]) -> DataFrame:
    """The pairs of ``lsh_pairs``, each tested in the task of its two blocks."""

    def match(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = key[0] == key[1]
        sides = Sides(batches, alone, [*carry])
        if len(sides.left) and len(sides.right):
            for found in _hashed(sides, alone, threshold, differ, shared.value, bits, probes):
                yield sides.answer(*found)

    found = _cells(rows, blocks, [*carry]).groupBy("__a", "__b").applyInArrow(match, pair_schema(rows, "__id", {c: c for c in carry}))
    ids = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("__id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        return found  # two rows meet in one task: a pair of their own ids comes once
    return found.groupBy("id1", "id2").agg(F.max("similarity").alias("similarity"), *(F.any_value(f"{c}{k}").alias(f"{c}{k}") for c in carry for k in (1, 2)))


def agreement(exact: Iterator, given: Iterator, width: int) -> np.ndarray:
    """(pairs of ``exact``, of them in ``given``, pairs of ``given`` besides) of two streams of (i, j, similarity) in the order of i, then j < ``width``."""
    counts = np.zeros(3, np.int64)
    keyed = lambda pairs: ((i * width + j, np.round(sims, 6)) for i, j, sims in pairs if len(i))
    given, keys, values = keyed(given), np.zeros(0, np.int64), np.zeros(0)
    for known, sims in keyed(exact):
        while not len(keys) or keys[-1] <= known[-1]:
            more = next(given, None)
            if more is None:
                break
            keys, values = np.concatenate([keys, more[0]]), np.concatenate([values, more[1]])
        upto = np.searchsorted(keys, known[-1], side="right")
        at = np.searchsorted(known, keys[:upto])
        hits = int(((known[at] == keys[:upto]) & (sims[at] == values[:upto])).sum())
        counts += (len(known), hits, upto - hits)
        keys, values = keys[upto:], values[upto:]
    counts[2] += len(keys) + sum(len(more[0]) for more in given)
    return counts


def compare_in_blocks(
    df: DataFrame, threshold: float, *, id_col: str = S.ROW_ID, vector: str = "vector", differ: str | None = None, recall: float = RECALL, block: int = BLOCK
) -> DataFrame | None:
    """The numbers of exact pairs, of those that ``lsh_pairs`` gives too, and of those that it gives besides, for ids that don't repeat.

    Both joins run over the same pairs of blocks, each on its own, and a task compares what they give. None where ``lsh_pairs`` uses buckets.
    """
    rows, shared, _, bits, probes, blocks = _prepared(df, threshold, id_col, vector, differ, recall, None, None, block, S.SEED, {})
    if not blocks:
        return None

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = key[0] == key[1]
        sides = Sides(batches, alone, [])
        counts = np.zeros(3, np.int64)
        if len(sides.left) and len(sides.right):
            exact = _exact(sides, alone, threshold, bool(differ))
            counts += agreement(exact, _hashed(sides, alone, threshold, bool(differ), shared.value, bits, probes), len(sides.right))
        yield pa.RecordBatch.from_pydict({c: pa.array([int(n)]) for c, n in zip(("true", "hit", "other"), counts)})

    counted = _cells(rows, blocks, []).groupBy("__a", "__b").applyInArrow(compare, "true long, hit long, other long")
    return counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("true", "hit", "other")))
