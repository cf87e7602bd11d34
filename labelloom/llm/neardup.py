"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Shingles are five lower-cased (A-Z) words; a text of fewer words is one shingle. A shingle weighs term frequency
times ln((1 + N) / (1 + df)) + 1. Document frequencies are exact down to a share ``floor`` of all documents: the larger of
``IDF_FLOOR`` and twice the share that falls in one of ``2**DF_BITS`` hash buckets by chance. Shingles below it weigh as if they had
it. The table of exact frequencies, which is broadcast, has at most ``2**(DF_BITS - 1)`` entries whatever the documents: every entry
stands for floor * N of the shingles of N documents.

1. Every document gets K consistent weighted samples; BANDS keys combine ROWS of them each. A pair of
   similarity s shares a key with probability 1 - (1 - s**ROWS)**BANDS: 0.995 at 0.8.
2. Documents with equal weighted sets are one node. Within a key, nodes are paired with the first of the key
   and with their neighbour by total weight: linear. Pairs are verified by exact weighted Jaccard similarity.
3. Links become classes (connected components). In keys that still hold several classes all pairs of different
   classes are compared whose total weights allow the threshold: as pairs in keys of at most FEW nodes, else by
   blocks of nodes. Every pair of blocks is a group of its own, whose similarities are one matrix product,
   and gives a spanning forest of its links. So every link that shares a key counts. The work grows with
   the square of a key's nodes only as far as they are of different classes and of similar weight.

Defined cases: null texts and texts without words have no shingles, each is a class of its own; equal texts are one
class; a null id may be in a class, whose id is the smallest id of its documents, null only if all are; rows with
equal ids are documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelloom.llm.textkit import LOWER, NOT_SPACE, counted, mix, text_slices, window_hashes, word_bounds, word_hashes
from labelloom.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 4
DF_BITS = 20
#: Shares of documents below which all shingles weigh the same, as far as chance in the buckets allows.
IDF_FLOOR = 2.0**-10
#: Buckets travel in so many ranges, partial counts in runs of so many shingles.
DF_RANGES = 256
DF_RUN = 1 << 20
#: Keys of at most so many nodes are compared pair by pair, larger ones by blocks of at most so many nodes and about so much weight.
FEW = 8
BLOCK_NODES = 1024
BLOCK_WEIGHT = 2_000_000
#: Shingles in at most so few documents of two blocks are compared pair by pair, others in dense matrices of so many columns.
RARE = 8
COLUMNS = 2048
#: Similarities of blocks are sums in single precision; they are exact to far less than this.
MARGIN = 1e-4
ROWS_PER_FILE = 100_000
#: Bits of the filter that tells which texts to read again; false positives cost time only.
FILTER_BITS = 26
#: Bits of a shingle's hash that are kept within a slice (the rest number the slice's documents).
HASH_BITS = 46


def _gamma_quantiles(bits: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution in the middle of 2**bits equal shares."""
    grid = np.concatenate((np.linspace(0, 0.1, 20_000)[1:], np.linspace(0.1, 30, 200_000)))
    share = (np.arange(1 << bits) + 0.5) / (1 << bits)
    return np.interp(share, 1 - (1 + grid) * np.exp(-grid), grid)


class Sampler:
    """Tables and seeds of the samples, the same in every worker."""

    made: Sampler | None = None

    def __init__(self) -> None:
        self.r = _gamma_quantiles(14).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(_gamma_quantiles(16)).astype(np.float32)
        self.seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    @classmethod
    def get(cls) -> Sampler:
        cls.made = cls.made or cls()
        return cls.made

    def bands(self, h: np.ndarray, log_w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Band keys (documents x BANDS) of weighted sets; entries of document i are at[i]:at[i + 1], none empty."""
        keys = np.zeros((len(at) - 1, BANDS), np.uint64)
        sizes = np.diff(at)
        for k, seed in enumerate(self.seeds):
            x = (h ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            r_at = (x & np.uint64(0x3FFF)).astype(np.int32)
            beta = ((x >> np.uint64(14)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
            t = np.floor(log_w * self.inverse[r_at] + beta)
            log_a = self.log_c[(x >> np.uint64(48)).astype(np.int32)] - self.r[r_at] * (t - beta + 1)
            least = np.minimum.reduceat(log_a, at[:-1])
            hit = np.flatnonzero(log_a == np.repeat(least, sizes))
            best = hit[np.searchsorted(hit, at[:-1])]
            sample = mix(h[best] + t[best].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(3) + sample)
        return keys


def shingle_slices(column: pa.Array):
    """(first row, row after, shingle hashes, term frequencies, bounds of the rows) of slices of texts."""
    top, low = np.uint64(HASH_BITS), np.uint64((1 << HASH_BITS) - 1)
    for first, stop, data, offsets in text_slices(column, 200_000):
        data = LOWER[data]
        starts, ends, at = word_bounds(data, offsets, NOT_SPACE)
        words, n = word_hashes(data, starts, ends), np.diff(at)
        row = np.repeat(np.arange(stop - first), n)
        windows = window_hashes(words, SHINGLE)
        inside = row[: len(windows)] == row[SHINGLE - 1 :] if len(windows) else np.zeros(0, bool)
        keys = [(row[: len(windows)][inside].astype(np.uint64) << top) | (windows[inside] & low)]
        for short in np.flatnonzero((n > 0) & (n < SHINGLE)):
            own = window_hashes(words[at[short] : at[short + 1]], int(n[short]))
            keys.append((np.uint64(short) << top) | (mix(own + np.uint64(n[short])) & low))
        keys = np.concatenate(keys)
        keys.sort()
        keys, tf = counted(keys)
        bounds = np.searchsorted(keys, np.arange(stop - first + 1, dtype=np.uint64) << top)
        yield first, stop, keys & low, tf, bounds


class Idf(NamedTuple):
    """Weights of the frequent shingles (sorted), of all others, and the buckets that hold a frequent one."""

    held: np.ndarray
    shingles: np.ndarray
    weights: np.ndarray
    rest: np.float32


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(HASH_BITS - DF_BITS)).astype(np.int64)


def _bucket_totals(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by hash bucket of their shingles, and the number of documents."""
    size, width = 1 << DF_BITS, (1 << DF_BITS) // DF_RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for first, stop, h, _, _ in shingle_slices(batch.column(0)):
                total += np.bincount(_bucket(h), minlength=size)
                n += stop - first
        parts = [x.astype(np.min_scalar_type(int(x.max()))) for x in total.reshape(DF_RANGES, width)]
        filled = [k for k, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *filled], pa.int32()), pa.array([np.int64(n).tobytes(), *[parts[k].tobytes() for k in filled]])], names=["range", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_buffer()
                values = np.frombuffer(raw, np.int64 if k < 0 else f"u{len(raw) // width}").astype(np.int64)
                sums[k] = sums[k] + values if k in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["range", "counts"])

    form = "range int, counts binary"
    merged = texts.mapInArrow(count, form).repartition("range").mapInArrow(add, form).toPandas()
    total, n = np.zeros((DF_RANGES, width), np.int64), 0
    for k, raw in zip(merged["range"], merged["counts"]):
        values = np.frombuffer(raw, np.int64)
        if k < 0:
            n = int(values[0])
        else:
            total[k] = values
    return total.ravel(), n


def frequent_shingles(texts: DataFrame, wanted, least: float) -> DataFrame:
    """(h, n): shingles of wanted buckets that occur in at least ``least`` documents, and their exact number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        found, waiting = [], 0
        for batch in batches:
            for _, _, h, _, _ in shingle_slices(batch.column(0)):
                found.append(h[flags[_bucket(h)]])
                waiting += len(found[-1])
                if waiting >= DF_RUN:
                    yield counts_of(found)
                    found, waiting = [], 0
        if waiting:
            yield counts_of(found)

    def counts_of(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = counted(np.sort(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def document_frequencies(docs: DataFrame, text: str) -> Idf:
    """Weights of shingles, from the counts over all documents."""
    texts, sc = docs.select(F.col(text).cast("string")), docs.sparkSession.sparkContext
    total, n = _bucket_totals(texts)
    n = max(n, 1)
    floor = max(IDF_FLOOR, 2 * float(total.sum()) / n / (1 << DF_BITS))
    weight = lambda df: (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    table = frequent_shingles(texts, sc.broadcast(total >= floor * n), floor * n).toPandas().sort_values("h")
    shingles = table["h"].to_numpy(np.int64).view(np.uint64)
    held = np.zeros(1 << DF_BITS, bool)
    held[_bucket(shingles)] = True
    return Idf(held, shingles, weight(table["n"].to_numpy(np.float64)), weight(np.float64(floor * n)))


def _weights(idf: Idf, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
    weight = np.full(len(h), idf.rest, np.float32)
    maybe = np.flatnonzero(idf.held[_bucket(h)])
    if len(maybe):
        at = np.minimum(np.searchsorted(idf.shingles, h[maybe]), len(idf.shingles) - 1)
        hit = idf.shingles[at] == h[maybe]
        weight[maybe[hit]] = idf.weights[at[hit]]
    return tf.astype(np.float32) * weight


def _set_hash(h: np.ndarray, tf: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes for each weighted set: two sums over its members."""
    parts = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h * np.uint64(odd) + tf.astype(np.uint64)), out=sums[1:])
        parts.append(mix(sums[at[1:]] - sums[at[:-1]]))
    raw = np.stack(parts, 1).astype(">u8").tobytes()
    return [raw[16 * k : 16 * k + 16] for k in range(len(at) - 1)]


def signatures(docs: DataFrame, idf, text: str) -> DataFrame:
    """``docs`` without the text, with ``node`` (null without shingles), ``total`` weight and ``keys`` of the bands."""
    fields = [f for f in docs.schema.fields if f.name != text]
    out = T.StructType([*fields, T.StructField("node", T.BinaryType()), T.StructField("total", T.DoubleType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    at, others = docs.columns.index(text), [k for k, c in enumerate(docs.columns) if c != text]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, table = Sampler.get(), idf.value
        for batch in batches:
            for first, stop, h, tf, bounds in shingle_slices(batch.column(at)):
                some = np.flatnonzero(np.diff(bounds) > 0)
                nodes, totals = np.full(stop - first, None, object), np.zeros(stop - first)
                keys = np.full(stop - first, None, object)
                if len(some):
                    dense = np.append(bounds[:-1][some], len(h))
                    w = _weights(table, h, tf)
                    sums = np.concatenate(([0.0], np.cumsum(w, dtype=np.float64)))
                    totals[some] = sums[dense[1:]] - sums[dense[:-1]]
                    nodes[some] = _set_hash(h, tf, dense)
                    found = sampler.bands(h, np.log(w), dense).view(np.int64)
                    for k, i in enumerate(some):
                        keys[i] = found[k]
                kept = [batch.column(k).slice(first, stop - first) for k in others]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(nodes.tolist(), pa.binary()), pa.array(totals), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=out.names
                )

    return docs.mapInArrow(sign, out)


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Bits of the hashes in the column ``key``: 2**FILTER_BITS of them, whatever the number of rows."""
    placed = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("place"))
    bits = F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")
    words = placed.groupBy(F.shiftright("place", 6).alias("at")).agg(bits).toPandas()
    bitmap = np.zeros((1 << FILTER_BITS) // 64, np.uint64)
    bitmap[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def vectors(docs: DataFrame, wanted, idf) -> DataFrame:
    """(node, h, w): the weighted sets of those texts of ``docs`` (text, key) whose key is in the bitmap, as packed arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches:
            place = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            chosen = (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
            for _, _, h, tf, bounds in shingle_slices(batch.column(0).filter(pa.array(chosen == 1))):
                some = np.flatnonzero(np.diff(bounds) > 0)
                if not len(some):
                    continue
                dense, w = np.append(bounds[:-1][some], len(h)), _weights(idf.value, h, tf)
                cut = list(zip(dense[:-1], dense[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_set_hash(h, tf, dense), pa.binary()), pa.array([h[a:b].tobytes() for a, b in cut]), pa.array([w[a:b].tobytes() for a, b in cut])],
                    names=["node", "h", "w"],
                )

    return docs.mapInArrow(pack, "node binary, h binary, w binary")


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of sorted hashes."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    shared = np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64)
    return shared / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - shared)


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = np.zeros(batch.num_rows)
        for k, (h1, w1, h2, w2) in enumerate(zip(*[batch.column(c) for c in ("h1", "w1", "h2", "w2")])):
            a, b = np.frombuffer(h1.as_buffer(), np.uint64), np.frombuffer(h2.as_buffer(), np.uint64)
            sims[k] = similarity(a, np.frombuffer(w1.as_buffer(), np.float32), b, np.frombuffer(w2.as_buffer(), np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims)], names=["a", "b", "sim"])


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def packed_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, idf) -> DataFrame:
    """(node, h, w) of the wanted nodes.

    Their texts are read again where they lie: a bitmap of fixed size tells them, so no text is shuffled.
    """
    wanted = wanted.distinct()
    key = F.xxhash64("row", "texthash").alias("key")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(nodes.join(wanted, "node").select(key)))
    return materialise(vectors(docs.select("text", key), bitmap, idf).dropDuplicates(["node"]).join(wanted, "node", "left_semi"))


def verified(pairs: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of the pairs of nodes whose weighted Jaccard similarity reaches the threshold."""
    joined = pairs.join(packed.toDF("a", "h1", "w1"), "a").join(packed.toDF("b", "h2", "w2"), "b")
    sims = joined.select("a", "b", "h1", "w1", "h2", "w2").mapInArrow(_similarity, "a binary, b binary, sim double")
    return sims.filter(F.col("sim") >= threshold)


def block_overlaps(h: np.ndarray, w: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum of the smaller weights of the shared shingles, of each left and each right document (entries: shingle, weight, document).

    A shingle's k-th smallest weight is a column that the documents of at least this weight have; it weighs
    what it exceeds the one before. Columns of few documents add up pair by pair.
    """
    n = int(max(left.max(), right.max())) + 1
    out = np.zeros((len(left), len(right)))
    row_of, col_of = np.full(n, -1), np.full(n, -1)
    row_of[left], col_of[right] = np.arange(len(left)), np.arange(len(right))
    order = np.lexsort((w, h))
    h, w, doc = h[order], w[order].astype(np.float64), doc[order]
    new_h = np.concatenate(([True], h[1:] != h[:-1]))
    ends = np.append(np.flatnonzero(new_h)[1:], len(h))[np.cumsum(new_h) - 1]  # after the last entry of the shingle
    at = np.flatnonzero(new_h | np.concatenate(([True], w[1:] != w[:-1])))  # first entry of each column; it holds all up to ``ends``
    gain = w[at] - np.where(new_h[at], 0.0, w[at - 1])
    held = ends[at] - at
    flat = out.ravel()
    for c in range(2, RARE + 1):
        own = np.flatnonzero(held == c)
        members = doc[at[own][:, None] + np.arange(c)]
        for x in range(c):
            for y in range(c):
                if x != y:
                    r, k = row_of[members[:, x]], col_of[members[:, y]]
                    both = (r >= 0) & (k >= 0)
                    np.add.at(flat, r[both] * len(right) + k[both], gain[own][both])
    own = np.flatnonzero(held > RARE)
    for part in (own[k : k + COLUMNS] for k in range(0, len(own), COLUMNS)):
        dense = np.zeros((n, len(part)), np.float32)
        many = held[part]
        entry = np.repeat(at[part] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        dense[doc[entry], np.repeat(np.arange(len(part)), many)] = 1
        out += (dense[left] * gain[part].astype(np.float32)) @ dense[right].T
    return out


def block_links(table: pa.Table, threshold: float) -> pa.Table:
    """(a, b): a spanning forest of the links between classes that a pair of blocks holds (side, node, label, h, w)."""
    side = table.column("side").to_numpy()
    nodes = table.column("node").to_pylist()
    _, label = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)
    h, w = ([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)] for c, kind in (("h", np.uint64), ("w", np.float32)))
    doc = np.repeat(np.arange(len(h)), [len(x) for x in h])
    total = np.array([x.sum(dtype=np.float64) for x in w])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if side.any() else 0))
    shared = block_overlaps(np.concatenate(h), np.concatenate(w), doc, left, right)
    sims = shared / (total[left][:, None] + total[right] - shared)
    found: list[tuple[int, int]] = []
    root = np.arange(int(label.max()) + 1)
    # single precision decides all but a margin; in it, the exact similarity does
    for low, high in ((threshold + MARGIN, np.inf), (threshold - MARGIN, threshold + MARGIN)):
        for k, i in enumerate(left):
            for j in right[np.flatnonzero((sims[k] >= low) & (sims[k] < high))]:
                a, b = root[label[i]], root[label[j]]
                if a != b and (high == np.inf or similarity(h[i], w[i], h[j], w[j]) >= threshold):
                    root[root == b] = a
                    found.append((i, j))
    return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})


def links_by_blocks(still: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between the classes of each key of ``still`` (band, key, node, total, label), enough to connect all that are linked."""
    key, least = ["band", "key"], threshold * (1 - 1e-6)
    held = still.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("held"))
    own = F.when(F.col("held") >= BLOCK_NODES, F.col("label"))  # large classes have blocks of their own
    along = Window.partitionBy(*key).orderBy("own", "total", "node")
    nth, weight = F.row_number().over(along), F.sum("total").over(along)
    block = F.xxhash64(F.coalesce("own", F.lit(b"")), F.floor(nth / BLOCK_NODES), F.floor(weight / BLOCK_WEIGHT))
    placed = still.join(held, [*key, "label"]).withColumn("own", own).withColumn("block", block).select(*key, "block", "node", "total", "label")
    placed = materialise(placed)
    sizes = [F.min("total").alias("lo"), F.max("total").alias("hi"), F.min("label").alias("l0"), F.max("label").alias("l1")]
    blocks = placed.groupBy(*key, "block").agg(*sizes)
    x, y = (blocks.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi", "l0", "l1")]) for s in "xy")
    alike = (F.col("hi_x") >= least * F.col("lo_y")) & (F.col("hi_y") >= least * F.col("lo_x"))
    one = (F.col("l0_x") == F.col("l1_x")) & (F.col("l0_y") == F.col("l1_y")) & (F.col("l0_x") == F.col("l0_y"))
    met = x.join(y, key).filter((F.col("block_x") <= F.col("block_y")) & alike & ~one)
    first, second = F.struct(F.col("block_x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_y").alias("block"), F.lit(1).alias("side"))
    sides = F.when(F.col("block_x") == F.col("block_y"), F.array(first)).otherwise(F.array(first, second))
    sides = met.select(*key, F.col("block_x").alias("i"), F.col("block_y").alias("j"), F.inline(sides))
    sent = placed.select(*key, "block", "node", "label").join(sides, [*key, "block"]).join(packed, "node")
    groups = sent.select(*key, "i", "j", "side", "node", "label", "h", "w").groupBy(*key, "i", "j")
    return groups.applyInArrow(lambda table: block_links(table, threshold), "a binary, b binary")


def compact(df: DataFrame, rows: int) -> DataFrame:
    """Written in as many files as about ``rows`` narrow rows need, however many partitions a shuffle has."""
    return materialise(df.coalesce(max(1, -(-rows // ROWS_PER_FILE))))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links: the smallest node that it is connected with.

    Labels spread to neighbours and are then looked up again (label of the label), until none changes.
    """
    n = 2 * links.count()
    both = compact(links.select("a", "b").union(links.select("b", "a")).distinct(), n)
    labels = compact(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), n)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        spread = compact(spread, n)
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = compact(spread.join(jump, "label").select("node", F.least("label", "far").alias("label"), "old"), n)
        if jumped.filter("label <> old").limit(1).count() == 0:
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, texthash, class_id, class_size, class): one row per document; class is null without shingles."""
    rows = docs.select(F.col(id_col).alias("row"), F.xxhash64(text).alias("texthash"), F.col(text).cast("string").alias("text"))
    idf = docs.sparkSession.sparkContext.broadcast(document_frequencies(rows, "text"))
    signed = materialise(signatures(rows, idf, "text"))
    nodes = signed.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("row", "texthash", "total", "keys")).alias("m")
    ).select("node", "m.row", "m.texthash", "m.total", "m.keys")
    n = signed.count()
    nodes = compact(nodes, n)
    keyed = nodes.select("node", "total", F.posexplode("keys").alias("band", "key"))
    crowd = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).filter("n > 1").drop("n")
    members = compact(keyed.join(crowd, ["band", "key"]), n)
    along = Window.partitionBy("band", "key").orderBy("total", "node")
    first = members.filter(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    beside = members.withColumn("a", F.lag("node").over(along)).filter("a is not null").select("a", F.col("node").alias("b"))
    lengths = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pairs = compact(first.union(beside).select(*lengths).distinct(), n)
    links = materialise(verified(pairs, packed_sets(ends_of(pairs), rows, nodes, idf), threshold).select("a", "b"))
    labels = components(links)
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ranges = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")]
    mixed = placed.groupBy("band", "key").agg(*ranges).filter("lo <> hi").select("band", "key", "n")
    still = compact(placed.join(mixed, ["band", "key"]).select("band", "key", "node", "total", "label", "n"), n)
    few, many = still.filter(F.col("n") <= FEW).drop("n"), still.filter(F.col("n") > FEW).drop("n")
    other = few.join(few.toDF("band", "key", "b", "total_b", "label_b"), ["band", "key"]).filter((F.col("node") < F.col("b")) & (F.col("label") != F.col("label_b")))
    other = other.filter(F.least("total", "total_b") >= threshold * (1 - 1e-6) * F.greatest("total", "total_b"))
    more = compact(other.select(F.col("node").alias("a"), "b").distinct().join(pairs, ["a", "b"], "left_anti"), n)
    if still.limit(1).count():
        packed = packed_sets(ends_of(more).union(many.select("node")), rows, nodes, idf)
        found = materialise(verified(more, packed, threshold).select("a", "b").union(links_by_blocks(many, packed, threshold)))
        if found.limit(1).count():
            labels = components(links.union(found))
    classed = signed.join(labels, "node", "left").select("row", "texthash", "node", F.coalesce("label", "node").alias("class"))
    sizes = classed.filter("class is not null").groupBy("class").agg(F.min("row").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    joined = classed.join(sizes, "class", "left")
    return joined.select(
        F.col("row").alias(id_col),
        "texthash",
        F.when(F.col("class").isNull(), F.col("row")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "class",
    )


def first_of_each_class(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id (then text hash); rows without shingles all stay."""
    shown = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    marks = near_duplicates(docs, id_col=id_col, text=text, threshold=threshold).withColumn("__k", shown)
    heads = marks.filter("class is not null").groupBy("class").agg(F.min(F.struct(id_col, "texthash", "__k")).alias("m"))
    alone = marks.filter("class is null").select("__k", F.col("texthash").alias("__th"), F.lit(False).alias("__one"))
    kept = heads.select(F.col("m.__k").alias("__k"), F.col("m.texthash").alias("__th"), F.lit(True).alias("__one")).union(alone.distinct())
    rows = docs.withColumns({"__k": shown, "__th": F.xxhash64(text)}).join(materialise(kept), ["__k", "__th"])
    nth = F.row_number().over(Window.partitionBy("__k", "__th").orderBy(F.lit(1)))
    return rows.withColumn("__n", F.when(F.col("__one"), nth).otherwise(1)).filter("__n = 1").select(*docs.columns)
