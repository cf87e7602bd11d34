"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions. A decision (the bits of the byte so far) has a context tree whose nodes
are the last 0 to DEPTH bytes; a node keeps how often a 0 and a 1 followed, its Krichevsky-Trofimov
estimate, and the weight of stopping there against going deeper. The probability of a bit mixes the
estimates of all nodes on its path with these weights. A text is its lower-cased (A-Z) bytes, then one
end byte; it is preceded by end bytes.

Every context that was seen is a node. All statistics are counted over all training texts: partitions count their
grams (context and byte) and send them packed to ranges of the context's last ROOT bytes. So a range has
whole subtrees from depth ROOT on, weighs them, and hands up only what they sum to below each node of depth 1; the shallow
nodes (at most 65,536) are weighed on the driver, and their shares go to all tasks. The counts stay with
their ranges, on disk.

Grams of at least GRAM_SHARE of all bytes (at most 1 / GRAM_SHARE) are scored from a broadcast table. A partition's other
grams go in blocks of documents: the distinct ones of a block are sent, packed, to the ranges, where the subtrees give
their values, and the values come back to the block, which sums them by document.

The base score needs the training count of every word. Words of at least SHARE of all tokens are looked up in a
broadcast table (at most 1 / SHARE words); all others are sent, packed, to ranges of their hash, where their
counts are formed and from where each document's sum comes back.

Defined cases: null text is empty, which has one token, the end; without training texts every bit has probability
1/2 and no word is known; null ids are kept; repeated rows are scored (and counted) each; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.textkit import LOWER, NOT_SPACE, binaries, counted, gathered, mix, range_count, summed, text_slices, word_bounds, word_hashes

DEPTH = 5
ROOT = 2
SHARE = 2.0**-20
GRAM_SHARE = 2.0**-21
END = 0xFF  # never a byte of UTF-8
END_WORD = np.uint64(0x5851F42D4C957F2D)
GRAMS_HELD = 6_000_000
DISTINCT_HELD = 3_000_000
BLOCK_HELD = 2_000_000
TABLE_BITS = 21
NO_ID = -(1 << 63)

U8 = np.uint64(8)


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(DEPTH bytes of context, byte) of every byte and every end, packed, in the order of the texts."""
    docs, sizes = len(offsets) - 1, np.diff(offsets)
    padded = np.full(len(data) + docs * (DEPTH + 1), END, np.uint8)
    begin = offsets[:-1] + np.arange(docs) * (DEPTH + 1)
    pads = (begin[:, None] + np.arange(DEPTH)).ravel()
    scored = np.ones(len(padded), bool)
    scored[pads] = False
    text = scored.copy()
    text[begin + DEPTH + sizes] = False
    padded[text] = data
    count = len(padded) - DEPTH
    packed = np.zeros(count, np.uint64)
    for k in range(DEPTH + 1):
        packed = (packed << U8) | padded[k : k + count]
    return packed[scored[DEPTH:]]


def _dealt(r: np.ndarray, ranges: int, columns: list[np.ndarray]) -> list[pa.Array]:
    """Packed pieces of the columns, one for each range."""
    order = np.argsort(r, kind="stable")
    cuts = np.searchsorted(r[order], np.arange(ranges + 1))
    columns = [c[order] for c in columns]
    return [binaries([c[a:b] for a, b in zip(cuts[:-1], cuts[1:])]) for c in columns]


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int32)


def _gram_range(g: np.ndarray, ranges: int) -> np.ndarray:
    """The range that has the subtree of a gram's context."""
    return _range_of(mix(((g >> U8) & _mask(ROOT)) + np.uint64(1)), ranges)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(*(np.concatenate(x) for x in zip(*held)))


COUNTS = "r int, g binary, gn binary, w binary, wn binary, n_bytes long, n_tokens long"


def count_partition(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of grams and words of a partition, a row for each range."""
    raw, gram_held, word_held = [], [], []
    size = n_bytes = n_tokens = 0

    def squeeze() -> None:
        nonlocal size
        if raw:
            keys = np.concatenate(raw)
            keys.sort()
            gram_held.append(counted(keys))
            raw.clear()
            size = 0

    def flush() -> pa.RecordBatch:
        nonlocal n_bytes, n_tokens
        squeeze()
        g, gn = _merged(gram_held)
        w, wn = _merged(word_held)
        columns = [*_dealt(_gram_range(g, ranges), ranges, [g, gn.astype(np.uint32)]), *_dealt(_range_of(w, ranges), ranges, [w, wn.astype(np.uint32)])]
        totals = [pa.array([n] * ranges, pa.int64()) for n in (n_bytes, n_tokens)]
        gram_held.clear(), word_held.clear()
        n_bytes = n_tokens = 0
        return pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), *columns, *totals], names=[c.split()[0] for c in COUNTS.split(", ")])

    for batch in batches:
        for first, stop, data, offsets in text_slices(batch.column(0)):
            data = LOWER[data]
            found = grams(data, offsets)
            raw.append(found)
            size, n_bytes = size + len(found), n_bytes + len(found)
            starts, ends, _ = word_bounds(data, offsets, NOT_SPACE)
            words = np.append(word_hashes(data, starts, ends), np.full(stop - first, END_WORD))
            n_tokens += len(words)
            words.sort()
            word_held.append(counted(words))
            if size >= GRAMS_HELD:
                squeeze()
                if len(word_held) > 1:
                    word_held[:] = [_merged(word_held)]
                if sum(len(x[0]) for x in gram_held) + len(word_held[0][0]) > DISTINCT_HELD:
                    yield flush()
    yield flush()


def nodes_of(g: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones) of every node of a depth; key: context << 8 | bits so far with a leading 1."""
    g, n = summed(g & _mask(depth + 1), n)
    keys, zeros, ones = [], [], []
    for k in range(8):
        prefix = g >> np.uint64(8 - k)
        bit = ((g >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))) if len(g) else np.zeros(0, np.int64)
        if not len(at):
            continue
        one, all_ = np.add.reduceat(n * bit, at), np.add.reduceat(n, at)
        first = g[at]
        keys.append(((first >> U8) << U8) | np.uint64(1 << k) | ((first & np.uint64(0xFF)) >> np.uint64(8 - k)))
        zeros.append(all_ - one)
        ones.append(one)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, zeros, ones = np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)
    order = np.argsort(keys)
    return keys[order], zeros[order], ones[order]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recursion; exact to about 1e-12."""
    y = x + 8
    steps = sum(np.log(x + k) for k in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def _stops(levels: list, first: int, below: np.ndarray | None) -> tuple[list, list, list, np.ndarray]:
    """Bottom up: (share of stopping, probability of a 1 in the rest, parent) by depth, and the log probability of what the nodes of the first depth have seen.

    It is half the node's own estimate, half the product of its branches and of the rest that has no branch (``below``: that product
    for the nodes of the last depth, where deeper ones are weighed elsewhere).
    """
    off: list[np.ndarray] = [np.zeros(0)] * len(levels)
    stop: list[np.ndarray] = [np.zeros(0)] * len(levels)
    parents: list[np.ndarray] = [np.zeros(0, np.int64)] * len(levels)
    log_w = np.zeros(0)
    for d in range(len(levels) - 1, -1, -1):
        keys, zeros, ones = levels[d]
        own = log_kt(zeros, ones)
        off[d] = np.full(len(keys), 0.5)
        if d == len(levels) - 1 and below is not None:
            deeper = below
        elif d == len(levels) - 1 or not len(levels[d + 1][0]):
            stop[d], log_w = np.ones(len(keys)), own
            continue
        else:
            child_keys, child_zeros, child_ones = levels[d + 1]
            parents[d + 1] = at = np.searchsorted(keys, child_keys & _mask(first + d + 1))
            rest = [x - np.bincount(at, c, len(keys)).astype(np.int64) for x, c in ((zeros, child_zeros), (ones, child_ones))]
            deeper = np.bincount(at, log_w, len(keys)) + log_kt(*rest)
            off[d] = (rest[1] + 0.5) / (rest[0] + rest[1] + 1)
        both = np.logaddexp(own, deeper)
        stop[d], log_w = np.exp(own - both), both - np.log(2)
    return stop, off, parents, log_w


def _mixture(levels: list, stop: list, parents: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Top down, for each depth: (probability of a 1 from the path up to the node, share that is left for what is deeper)."""
    sure = left = np.zeros(0)
    for d, (_, zeros, ones) in enumerate(levels):
        one = (ones + 0.5) / (zeros + ones + 1)
        a, b = (0.0, 1.0) if d == 0 else (sure[parents[d]], left[parents[d]]) if len(parents[d]) else (np.zeros(0), np.zeros(0))
        # in single precision a bit that always followed would become certain beyond 2^24 times, and any other impossible
        sure, left = a + b * stop[d] * one, b * (1 - stop[d])
        yield sure, left


def weigh(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, probability of a 1 where the path ends at the node) for each depth from ``first`` on, from the nodes' counts.

    A path that leaves the branches goes on in the rest, which is one node of its own (1/2 where nothing was seen).
    """
    stop, off, parents, _ = _stops(levels, first, None)
    return [(level[0], sure + left * rest) for level, rest, (sure, left) in zip(levels, off, _mixture(levels, stop, parents))]


def shallow(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of a 1 from the depths above ROOT, share left for the deeper ones) by last byte and bits so far, from the nodes of depth 1."""
    tops = keys & _mask(1)
    root = (*summed(tops, zeros), summed(tops, ones)[1])
    levels = [root, (keys, zeros, ones)]
    stop, _, parents, _ = _stops(levels, 0, below)
    sure, left = np.zeros((256, 256)), np.ones((256, 256))
    for (at, _, _), (a, b) in zip(levels, _mixture(levels, stop, parents)):
        if at is root[0]:  # also for bytes that were never seen as a context
            sure[:, at], left[:, at] = a, b
        else:
            sure[at >> U8, at & _mask(1)], left[at >> U8, at & _mask(1)] = a, b
    return sure.ravel(), left.ravel()


class Scorer:
    """log10 probabilities of grams by a tree from depth ``first`` on, under the mixture of the depths above it (``top``)."""

    def __init__(self, model: dict):
        self.tree, self.first, self.top = model["tree"], model.get("first", 0), model.get("top")

    def ones(self, g: np.ndarray) -> np.ndarray:
        """For each of the eight bits, the probability of a 1 at the deepest node of its path in the tree."""
        found = np.full((len(g), 8), 0.5)
        for k in range(8):
            prefix, todo = _prefix(g, k), np.arange(len(g))
            for d in range(len(self.tree) - 1, -1, -1):
                keys, values = self.tree[d]
                if not len(keys) or not len(todo):
                    continue
                key = (((g[todo] >> U8) & _mask(self.first + d)) << U8) | prefix[todo]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                found[todo[hit], k] = values[at[hit]]
                todo = todo[~hit]
        return found

    def __call__(self, g: np.ndarray) -> np.ndarray:
        return log_probability(g, self.ones(g), self.top)


def _prefix(g: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` bits of the byte, after a leading 1."""
    return np.uint64(1 << k) | ((g & np.uint64(0xFF)) >> np.uint64(8 - k))


def log_probability(g: np.ndarray, ones: np.ndarray, top: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Sum over the eight bits of the log10 of their probability."""
    total = np.zeros(len(g))
    for k in range(8):
        one = ones[:, k]
        if top is not None:
            at = (g & np.uint64(0xFF00)) | _prefix(g, k)
            one = top[0][at] + top[1][at] * one
        bit = (g >> np.uint64(7 - k)) & np.uint64(1)
        total += np.log10(np.where(bit == 1, one, 1 - one))
    return total


KINDS = {"w": np.uint64, "wn": np.int64, "k": np.uint64, "z": np.int64, "o": np.int64, "below": np.float64, "often": np.uint64, "ones": np.float64}
MODEL = "r int, distinct long, n_bytes long, n_tokens long, g binary, gn binary, " + ", ".join(f"{c} binary" for c in KINDS)


def _subtrees(g: np.ndarray, gn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [nodes_of(g, gn, d) for d in range(ROOT, DEPTH + 1)]


def merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: totals, all its grams, its frequent words, what its subtrees sum to by node of depth 1, and its frequent grams as the subtrees score them."""
    held: dict[int, list] = {}
    for batch in batches:
        r, *totals = (batch.column(c).to_pylist() for c in ("r", "n_bytes", "n_tokens"))
        kinds = (("g", np.uint64), ("gn", np.uint32), ("w", np.uint64), ("wn", np.uint32))
        for row in zip(r, *totals, *(gathered(batch.column(c), kind) for c, kind in kinds)):
            held.setdefault(row[0], []).append(row[1:])
    for r in list(held):
        rows = held.pop(r)
        n_bytes, n_tokens = sum(x[0] for x in rows), sum(x[1] for x in rows)
        g, gn = _merged([(x[2], x[3].astype(np.int64)) for x in rows])
        w, wn = _merged([(x[4], x[5].astype(np.int64)) for x in rows])
        frequent = wn >= SHARE * n_tokens
        levels = _subtrees(g, gn)
        keys, zeros, ones = levels[0]
        up = keys & _mask(ROOT)
        sums = [summed(up, x) for x in (zeros, ones, _stops(levels, ROOT, None)[3])]
        often = g[gn >= GRAM_SHARE * n_bytes]
        columns = [g, gn, w[frequent], wn[frequent], sums[0][0], *(x[1] for x in sums), often, Scorer({"tree": weigh(levels, ROOT), "first": ROOT}).ones(often)]
        numbers = [pa.array([x], kind) for x, kind in ((r, pa.int32()), (len(w), pa.int64()), (n_bytes, pa.int64()), (n_tokens, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*numbers, *(binaries([c]) for c in columns)], names=[c.split()[0] for c in MODEL.split(", ")])


def train(docs: DataFrame, text: str = "text") -> tuple[dict, DataFrame]:
    """Model of all given texts: (shares of the shallow nodes, frequent grams and words, totals), and the counts of all grams by range."""
    ranges = range_count(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = docs.select(F.col(text).cast("string")).mapInArrow(lambda b: count_partition(b, ranges), COUNTS)
    # on the executors' disks: it is read twice, and can be formed again
    kept = counts.repartition(ranges, "r").mapInArrow(merge_ranges, MODEL).persist(StorageLevel.DISK_ONLY)
    # at most 1 / GRAM_SHARE grams, 1 / SHARE words, and the nodes of depth 1 of each range
    rows = sorted(kept.drop("g", "gn").collect(), key=lambda row: row["r"])
    part = {c: np.concatenate([np.frombuffer(r[c], kind) for r in rows] or [np.zeros(0, kind)]) for c, kind in KINDS.items()}
    keys, zeros = summed(part["k"], part["z"])
    top = shallow(keys, zeros, *(summed(part["k"], part[c])[1] for c in ("o", "below")))
    words = np.argsort(part["w"])
    model = {
        "top": top, "grams": part["often"], "values": log_probability(part["often"], part["ones"].reshape(-1, 8), top),
        "words": part["w"][words], "counts": part["wn"][words], "tokens": max([r["n_tokens"] for r in rows], default=0), "distinct": sum(r["distinct"] for r in rows),
    }
    return model, kept.select("r", "g", "gn")


class Table:
    """Values of the frequent grams by one slot of a hash table; those whose slot another one has are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = np.full(1 << TABLE_BITS, (1 << 64) - 1, np.uint64), np.zeros(1 << TABLE_BITS)
        slot = self._slot(keys)
        self.keys[slot] = keys
        own = self.keys[slot] == keys
        self.values[slot[own]] = values[own]
        late = np.flatnonzero(~own)
        late = late[np.argsort(keys[late])]
        self.late, self.late_values = keys[late], values[late]

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def __call__(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 for grams that aren't in the table; where those are)"""
        slot = self._slot(g)
        miss = np.flatnonzero(self.keys[slot] != g)
        out = self.values[slot]
        out[miss] = 0.0
        if len(self.late) and len(miss):
            missing = g[miss]
            at = np.minimum(np.searchsorted(self.late, missing), len(self.late) - 1)
            hit = self.late[at] == missing
            out[miss[hit]] = self.late_values[at[hit]]
            miss = miss[~hit]
        return out, miss


#: Kinds of rows, in the order in which a range reads them. Sent to ranges: the range's grams (c0: gram, c1: count); documents of a block,
#: which only pass (c0 to c7: one each a document, c8: their rare grams, as places in the block's list); rare grams of a block (c0), in the order of
#: that list; rare words (c0: hash, c1: document). Sent back to blocks: values of the grams (c0); sums for documents (c0: document, c1: sum, c2: known).
GRAMS, DOCS, ASKED, WORDS, VALUES, SUMS = range(6)
ROWS = "kind int, r int, block long, " + ", ".join(f"c{k} binary" for k in range(9))
#: A document's number: its block's, its place there, and whether it is in training.
PLACE_BITS = 31


def _rows(kind: int, r: list, block: list, columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    packed = [binaries(c) for c in columns]
    packed += [pa.nulls(len(r), pa.binary())] * (9 - len(packed))
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(r), pa.int32()), pa.array(r, pa.int32()), pa.array(block, pa.int64()), *packed], names=[c.split()[0] for c in ROWS.split(", ")]
    )


def _pieces(kind: int, r: np.ndarray, block: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each range that gets something of a block; ``r`` is sorted."""
    own, sizes = counted(r)
    cuts = np.cumsum(sizes)[:-1]
    return _rows(kind, own.tolist(), [block] * len(own), [np.split(c, cuts) if len(own) else [] for c in columns])


def score_partition(batches: Iterator[pa.RecordBatch], model: dict, ranges: int, most: int) -> Iterator[pa.RecordBatch]:
    """Scores of the documents of a partition as far as the broadcast tables have them, and the grams and words that they don't have (columns: text, id, in training)."""
    table = Table(model["grams"], model["values"])
    words, logs = model["words"], np.log10(model["counts"] + 1.0)
    block = TaskContext.get().partitionId() << 14
    rest, asked, docs, place, size = [], [], [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not docs:
            return
        g = np.concatenate(asked)
        order = np.argsort(g, kind="stable")
        distinct, sizes = counted(g[order])
        r = _gram_range(distinct, ranges)
        by_range = np.argsort(r, kind="stable")
        spot = np.empty(len(distinct), np.uint32)
        spot[by_range] = np.arange(len(distinct))
        at = np.empty(len(g), np.uint32)
        at[order] = np.repeat(spot, sizes)
        spread = _range_of(mix(np.array([d[0][0] for d in docs]).astype(np.uint64)), ranges)
        yield _rows(DOCS, spread.tolist(), [block] * len(docs), [*map(list, zip(*docs)), np.split(at, np.cumsum([len(a) for a in asked])[:-1])])
        yield _pieces(ASKED, r[by_range], block, [distinct[by_range]])
        h, uid = (np.concatenate(c) for c in zip(*rest))
        r = _range_of(h, ranges)
        order = np.argsort(r, kind="stable")
        yield _pieces(WORDS, r[order], block, [h[order], uid[order]])

    for batch in batches:
        ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        training = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for first, stop, data, offsets in text_slices(batch.column(0)):
            data = LOWER[data]
            g = grams(data, offsets)
            found, rare = table(g)
            bounds = offsets + np.arange(len(offsets))
            sums = np.concatenate(([0.0], np.cumsum(found)))
            starts, ends, at = word_bounds(data, offsets, NOT_SPACE)
            n = np.diff(at)
            h = word_hashes(data, starts, ends)
            row = np.repeat(np.arange(stop - first), n)
            value, known = np.zeros(len(h)), np.zeros(len(h), bool)
            if len(words) and len(h):
                order = np.argsort(h)
                spot = np.minimum(np.searchsorted(words, h[order]), len(words) - 1)
                known[order] = words[spot] == h[order]
                value[order] = np.where(known[order], logs[spot], 0.0)
            uid = (block << PLACE_BITS) + (place + np.arange(stop - first)) * 2 + training[first:stop]
            place += stop - first
            tail = np.flatnonzero(~known)
            rest.append((h[tail], uid[row[tail]]))
            asked.append(g[rare])
            docs.append(
                (
                    uid, ids[first:stop], n + 1, np.bincount(row[known], minlength=stop - first), np.bincount(row, value, stop - first),
                    sums[bounds[1:]] - sums[bounds[:-1]], (offsets[1:] - offsets[:-1] + 1).astype(np.int64), np.diff(np.searchsorted(rare, bounds)),
                )
            )
            size += len(tail) + len(rare) + stop - first
            if size > most:
                yield from flush()
                rest, asked, docs, place, size, block = [], [], [], 0, 0, block + 1
    yield from flush()


def _word_sums(h: np.ndarray, uid: np.ndarray, r: int) -> pa.RecordBatch:
    """Counts the words of a range and turns them into sums for the documents of each block."""
    order = np.argsort(h, kind="stable")
    h, uid = h[order], uid[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    c = np.add.reduceat(uid & 1, at)
    c = np.repeat(c, np.diff(np.append(at, len(h))))
    keys, sums = summed(uid, np.log10(c + 1.0))
    _, known = summed(uid, (c > 0).astype(np.int64))
    blocks, sizes = counted(keys >> PLACE_BITS)
    cuts = np.cumsum(sizes)[:-1]
    return _rows(SUMS, [r] * len(blocks), blocks.tolist(), [np.split(x, cuts) for x in (keys, sums, known)])


def resolve(batches: Iterator[pa.RecordBatch], top: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Values of the grams and sums of the words that blocks sent to a range, sorted by range and kind; documents pass."""
    now, h, uid = None, [], []
    seen = values = scorer = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        if (kinds == DOCS).any():
            yield batch.filter(pa.array(kinds == DOCS))
        answers = [], [], []
        for kind, r, block, c0, c1 in zip(kinds, batch.column("r").to_pylist(), batch.column("block").to_pylist(), batch.column("c0"), batch.column("c1")):
            if r != now:
                if h:
                    yield _word_sums(np.concatenate(h), np.concatenate(uid), now)
                now, h, uid = r, [], []
                seen, scorer = np.zeros(0, np.uint64), Scorer({"tree": [], "top": top})
            if kind == GRAMS:
                seen, gn = np.frombuffer(c0.as_buffer(), np.uint64), np.frombuffer(c1.as_buffer(), np.int64)
                scorer = Scorer({"tree": weigh(_subtrees(seen, gn), ROOT), "first": ROOT, "top": top})
                values = scorer(seen)
            elif kind == ASKED:
                g = np.frombuffer(c0.as_buffer(), np.uint64)
                at = np.searchsorted(seen, g)
                hit = np.zeros(len(g), bool)
                hit[at < len(seen)] = seen[at[at < len(seen)]] == g[at < len(seen)]
                found = np.empty(len(g))
                if hit.any():
                    found[hit] = values[at[hit]]
                found[~hit] = scorer(g[~hit])
                for held, x in zip(answers, (r, block, found)):
                    held.append(x)
            elif kind == WORDS:
                h.append(np.frombuffer(c0.as_buffer(), np.uint64).copy())
                uid.append(np.frombuffer(c1.as_buffer(), np.int64).copy())
        if answers[0]:
            yield _rows(VALUES, answers[0], answers[1], [answers[2]])
    if h:
        yield _word_sums(np.concatenate(h), np.concatenate(uid), now)


SCORES = "id long, n_tokens long, n_known long, base_sum double, score double, n_bytes long"


def finish(rows: pa.Table, end_known: bool) -> pa.Table:
    """The documents of a block with their sums from all ranges."""
    rows = rows.sort_by([("kind", "ascending"), ("r", "ascending")]).combine_chunks()
    kind = rows.column("kind").to_numpy()

    def parts(which: int, *dtypes) -> list[np.ndarray]:
        own = rows.filter(pa.array(kind == which))
        return [np.concatenate([*gathered(own.column(f"c{k}"), dtype), np.zeros(0, dtype)]) for k, dtype in enumerate(dtypes)]

    i, f = np.int64, np.float64
    uid, ids, n, known, base, score, n_bytes, rare, at = parts(DOCS, i, i, i, i, f, f, i, i, np.uint32)
    (values,) = parts(VALUES, f)
    score = score + np.bincount(np.repeat(np.arange(len(uid)), rare), values[at], len(uid))
    keys, sums, more = parts(SUMS, i, f, i)
    order = np.argsort(uid)
    spot = order[np.searchsorted(uid, keys, sorter=order)]
    base = base + np.bincount(spot, sums, len(uid))
    known = known + np.bincount(spot, more, len(uid)).astype(np.int64)
    return pa.Table.from_arrays(
        [pa.array(ids, mask=ids == NO_ID), pa.array(n), pa.array(known + int(end_known)), pa.array(base), pa.array(score), pa.array(n_bytes)],
        names=[c.split()[0] for c in SCORES.split(", ")],
    )


def score(docs: DataFrame, training, *, id_col: str = "doc_id", text: str = "text", most: int = BLOCK_HELD) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every text, learning from those where ``training`` holds.

    ``most``: rare grams, rare words and documents after which a block of documents ends.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("training"))
    model, counts = train(rows.filter("training"))
    ranges = range_count(int(spark.conf.get("spark.sql.shuffle.partitions")))
    top, shared = spark.sparkContext.broadcast(model.pop("top")), spark.sparkContext.broadcast(model)
    sent = rows.mapInArrow(lambda b: score_partition(b, shared.value, ranges, most), ROWS)
    grams_of = counts.select(F.lit(GRAMS).alias("kind"), "r", F.lit(-1).cast("long").alias("block"), F.col("g").alias("c0"), F.col("gn").alias("c1"))
    by_range = sent.unionByName(grams_of, allowMissingColumns=True).repartition(ranges, "r").sortWithinPartitions("r", "kind")
    resolved = by_range.mapInArrow(lambda b: resolve(b, top.value), ROWS)
    at = int(np.searchsorted(model["words"], END_WORD))
    ends = int(model["counts"][at]) if at < len(model["words"]) and model["words"][at] == END_WORD else 0
    done = resolved.groupBy("block").applyInArrow(lambda t: finish(t, ends > 0), SCORES)
    scale = float(np.log10(model["tokens"] + model["distinct"] + 1.0))
    base = F.col("base_sum") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(scale)
    return done.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
