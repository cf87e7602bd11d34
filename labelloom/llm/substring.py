"""Removal of repeated word spans over a whole corpus.

A window is ``window`` consecutive words of a document. A word is removed if a window that covers it has a
word sequence that also starts earlier: in a smaller document, or before in the same one. Windows
are judged on the input.

The corpus is its own reference here, and grows without bound, so automata of it can't be broadcast (see the
README for figures). Instead:

1. Winnowing: of the ``window - anchor + 1`` shingles of ``anchor`` words in a window, the one of smallest
   hash (the first of equals) is its anchor. Equal windows have equal anchors, so a window can only repeat
   if its anchor does. Anchors (a fifth of the words) are dealt to ranges of their hash; anchors
   that occur twice set a bit in a bitmap of fixed size, which is broadcast. A false positive costs
   time, never correctness.
2. Windows with such an anchor are dealt to ranges of their 128-bit hash. In a range, all occurrences of a
   window lie together; all but the first are repeats.
3. Repeats are dealt back to their documents and merged to maximal spans, which are cut out of the text.

No window sends more than its occurrences, so groups of thousands of copies stay linear, and ranges
of hashes are even whatever the documents share.

Defined cases: null texts have no words; documents shorter than a window keep all words; rows with equal id and
text are one document (they don't remove each other's words); equal ids with different texts are
different documents, the smaller text hash first; null ids come last; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.textkit import (
    NOT_SPACE,
    Powers,
    binaries,
    counted,
    gathered,
    mix,
    range_count,
    range_cuts,
    text_slices,
    window_hashes,
    word_bounds,
    word_hashes,
)
WINDOW = 20
ANCHOR = 12
BITMAP_BITS = 27
FLUSH = 500_000
SECOND = Powers(0xA24BAED4963EE407)


def anchors(words: np.ndarray, at: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, document, anchor's hash, anchor's place) of every window; at: first word of each document, and the total."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    count = len(words) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    start = np.flatnonzero(row[:count] == row[window - 1 :])
    grams = window_hashes(words, anchor)
    width = window - anchor + 1
    least = grams[start]
    for k in range(1, width):
        least = np.minimum(least, grams[start + k])
    place = start + (width - 1)
    for k in range(width - 2, -1, -1):
        place = np.where(grams[start + k] == least, start + k, place)
    return start, row[start], least, place


def sliced_words(column: pa.Array):
    """(first row, row after, bytes, starts, ends, first word of each row, hashes of the words)."""
    for first, stop, data, offsets in text_slices(column):
        starts, ends, at = word_bounds(data, offsets, NOT_SPACE)
        yield first, stop, data, starts, ends, at, word_hashes(data, starts, ends)


def repeated_anchors(docs: DataFrame, *, window: int, anchor: int) -> np.ndarray:
    """Bitmap (packed bytes) over the upper bits of the anchors that occur more than once."""
    ranges = range_count(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = (1 << BITMAP_BITS) // ranges

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
            keys.sort()
            cuts = range_cuts(keys, ranges)
            parts = [keys[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), binaries(parts)], names=["r", "keys"])

        for batch in batches:
            for _, _, _, _, _, at, words in sliced_words(batch.column(0)):
                _, _, least, place = anchors(words, at, window, anchor)
                new = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
                held.append(least[new])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        yield flush()

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r, keys in zip(batch.column(0).to_pylist(), gathered(batch.column(1), np.uint64)):
                held.setdefault(r, []).append(keys)
        for r, parts in held.items():
            keys = np.concatenate(parts)
            keys.sort()
            keys, n = counted(keys)
            bits = np.zeros(share, bool)
            bits[(keys[n > 1] >> np.uint64(64 - BITMAP_BITS)).astype(np.int64) - r * share] = True
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), binaries([np.packbits(bits)])], names=["r", "bits"])

    dealt = docs.select("text").mapInArrow(find, "r int, keys binary").repartition(ranges, "r")
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for row in dealt.mapInArrow(repeat, "r int, bits binary").toLocalIterator():  # 2**BITMAP_BITS bits, whatever the corpus
        part = np.frombuffer(row["bits"], np.uint8)
        bitmap[row["r"] * len(part) : (row["r"] + 1) * len(part)] = part
    return bitmap


def repeated_windows(docs: DataFrame, bitmap: np.ndarray, *, window: int, anchor: int) -> DataFrame:
    """(id, th, spans): for each document with repeats, its repeated words as packed (begin, end) pairs in order."""
    spark = docs.sparkSession
    ranges = range_count(int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(bitmap)
    fields = [("h", np.uint64), ("h2", np.uint64), ("id", np.int64), ("th", np.int64), ("pos", np.int32)]

    def dealt(keys: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        # inside a range, the order of the documents stays: their ids then compress well
        r = (keys >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int32)
        order = np.argsort(r, kind="stable")
        cuts = np.searchsorted(r[order], np.arange(ranges + 1))
        packed = [binaries([c[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), *packed], names=["r", *(f"c{k}" for k in range(len(columns)))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, hashes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, stop, data, starts, ends, at, words in sliced_words(batch.column(0)):
                start, row, least, _ = anchors(words, at, window, anchor)
                bit = least >> np.uint64(64 - BITMAP_BITS)
                some = (shared.value[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1
                some = np.flatnonzero(some)
                start, row = start[some], row[some]
                if not len(start):
                    continue
                # the second half of the hash has nothing of the first: other word hashes, another base
                twice = word_hashes(data, starts, ends, lane=1)
                up, down = SECOND.upto(len(words) + 1)
                sums = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(twice * up[: len(words)], out=sums[1:])
                other = mix((sums[start + window] - sums[start]) * down[start])
                held.append((window_hashes(words, window)[start], other, ids[first:stop][row], hashes[first:stop][row], (start - at[row]).astype(np.int32)))
                size += len(start)
                if size >= FLUSH:
                    columns = [np.concatenate(c) for c in zip(*held)]
                    yield dealt(columns[0], columns)
                    held, size = [], 0
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield dealt(columns[0], columns)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[] for _ in fields]
        for batch in batches:
            for k, (_, kind) in enumerate(fields):
                parts[k].extend(gathered(batch.column(k + 1), kind))
        if not parts[0]:
            return
        h, h2, ids, th, pos = (np.concatenate(p) for p in parts)
        order = np.lexsort((pos, th, ids, h2, h))
        h, h2, ids, th, pos = (x[order] for x in (h, h2, ids, th, pos))
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        gone = (ids != ids[first]) | (th != th[first]) | (pos != pos[first])
        if gone.any():
            key = mix(ids[gone].view(np.uint64) ^ mix(th[gone].view(np.uint64)))
            yield dealt(key, [ids[gone], th[gone], pos[gone]])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[], [], []]
        for batch in batches:
            for k, kind in enumerate((np.int64, np.int64, np.int32)):
                parts[k].extend(gathered(batch.column(k + 1), kind))
        if not parts[0] or not sum(map(len, parts[0])):
            return
        ids, th, pos = (np.concatenate(p) for p in parts)
        order = np.lexsort((pos, th, ids))
        ids, th, pos = ids[order], th[order], pos[order]
        new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])))
        opened = new | np.concatenate(([True], pos[1:] > pos[:-1] + window))
        begin = np.flatnonzero(opened)
        end = np.append(begin[1:], len(pos)) - 1
        pairs = np.stack((pos[begin], pos[end] + window), 1).astype(np.int32)
        docs_at = np.flatnonzero(new[begin])
        cuts = np.append(docs_at, len(begin))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[begin[docs_at]]), pa.array(th[begin[docs_at]]), binaries([pairs[a:b] for a, b in zip(cuts[:-1], cuts[1:])])],
            names=["id", "th", "spans"],
        )

    found = docs.select("text", "id", "th").mapInArrow(find, "r int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary")
    gone = found.repartition(ranges, "r").mapInArrow(later, "r int, c0 binary, c1 binary, c2 binary")
    return gone.repartition(ranges, "r").mapInArrow(spans, "id long, th long, spans binary")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words left joined by single spaces."""
    docs = docs.drop("n_words", "n_removed", "kept")
    last = F.lit((1 << 63) - 1)
    rows = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), last), "__th": F.xxhash64(text), "__t": F.col(text).cast("string")})
    bare = rows.select(F.col("__t").alias("text"), F.col("__id").alias("id"), F.col("__th").alias("th"))
    bitmap = repeated_anchors(bare, window=window, anchor=anchor)
    spans = repeated_windows(bare, bitmap, window=window, anchor=anchor)
    joined = rows.join(spans.toDF("__id", "__th", "__spans"), ["__id", "__th"], "left")
    names = [*docs.columns, "__t", "__spans"]
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(len(names) - 1)
            for first, stop, data, starts, ends, at, _ in sliced_words(batch.column(len(names) - 2)):
                keep = np.ones(len(starts) + 1, bool)
                for row in range(first, stop):
                    if marks[row].is_valid:
                        for a, b in np.frombuffer(marks[row].as_buffer(), np.int32).reshape(-1, 2):
                            keep[at[row - first] + a : at[row - first] + b] = False
                keep = keep[:-1]
                inside = np.zeros(len(data) + 1, np.int8)
                np.add.at(inside, starts[keep], 1)
                np.add.at(inside, ends[keep], -1)
                member = np.cumsum(inside, dtype=np.int32)[:-1] > 0
                member[ends[keep][ends[keep] < len(data)]] = True  # one parting byte after each kept word
                left = np.where(NOT_SPACE[data], data, 32).astype(np.uint8)
                texts = []
                for row in range(stop - first):
                    lo, hi = at[row], at[row + 1]
                    own = np.flatnonzero(keep[lo:hi])
                    if not len(own):
                        texts.append("")
                        continue
                    a, b = starts[lo + own[0]], ends[lo + own[-1]]
                    texts.append(left[a:b][member[a:b]].tobytes().decode())
                n = np.diff(at)
                kept_n = np.diff(np.concatenate(([0], np.cumsum(keep)))[at])
                own = [batch.column(k).slice(first, stop - first) for k in range(len(names) - 2)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n.astype(np.int64)), pa.array((n - kept_n).astype(np.int64)), pa.array(texts, pa.string())], names=out.names
                )

    return joined.select(*names).mapInArrow(cut, out)


#: The result for ``documents``, in DuckDB.
ORACLE = f"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
win as (
  select doc_id, i, array_to_string(w[i + 1 : i + {WINDOW}], ' ') as s
  from (select doc_id, w, unnest(range(0, len(w) - {WINDOW} + 1)) as i from d)
), later as (select doc_id, i from (select *, row_number() over (partition by s order by doc_id, i) as nth from win) where nth > 1
), gone as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as k from later
), placed as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as k from d
), kept as (
  select p.doc_id, count(g.k) as n_removed, string_agg(word, ' ' order by p.k) filter (where g.k is null) as kept
  from placed p left join gone g on p.doc_id = g.doc_id and p.k = g.k group by p.doc_id
)
select d.doc_id, len(d.w)::BIGINT as n_words, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""
