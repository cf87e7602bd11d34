"""Language identification: multinomial naive Bayes over hashed character trigrams.

Training counts trigrams per language in every partition, Spark adds them up, and the log-probability
matrix (languages x buckets) is broadcast: its size depends on the number of languages and the
bucket parameter only. Scoring is sparse: a text reads the matrix rows of its own trigrams.

Characters are lower-cased; everything but letters counts as a space.

Defined cases: null text or text without a letter is ``und`` with score 0; null languages don't train;
with nothing to learn from, every text is ``und``; ties go to the language first in code point order;
repeated rows count as often as they occur; an empty table gives an empty table; further columns are
kept by ``predict`` and may not be named ``lang_pred`` or ``score`` (those are replaced).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.textkit import segment_sums

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: A posterior is that of at most so many n-grams of average evidence, so that long texts of mixed language stay uncertain.
EVIDENCE = 60
UNDETERMINED = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """True at each code point that is a letter; built once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def trigram_slices(texts: list[str | None], buckets: int, limit: int = 300_000):
    """(first row, row after, bucket of each trigram, is it more than spaces, bounds of the rows) of slices of whole texts.

    Two spaces stand around each text, so that a lone letter has trigrams and none crosses texts.
    """
    letters, shift, row = letter_table(), np.uint32(32 - (buckets.bit_length() - 1)), 0
    while row < len(texts):
        stop, size = row, 0
        while stop < len(texts) and (stop == row or size + len(texts[stop] or "") <= limit):
            size += len(texts[stop] or "") + 2
            stop += 1
        lowered = [(t or "").lower() for t in texts[row:stop]]
        chars = np.frombuffer(("  " + "  ".join(lowered) + "  ").encode("utf-32-le"), np.uint32)
        chars = np.where(letters[chars], chars, np.uint32(32))
        code = (chars[:-2] * np.uint32(0x85EBCA6B) + chars[1:-1]) * np.uint32(0xC2B2AE35) + chars[2:]
        code ^= code >> np.uint32(15)
        code = (code * np.uint32(0x9E3779B1)) >> shift
        real = chars != 32
        some = real[:-2] | real[1:-1] | real[2:]
        bounds = np.zeros(stop - row + 1, np.int64)
        np.cumsum([len(t) + 2 for t in lowered], out=bounds[1:])
        yield row, stop, code, some, bounds
        row = stop


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> dict:
    """Model of all given rows: languages, log probability matrix (languages x buckets) and log priors."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts: dict[str, list] = {}
            for own, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(name, []).append(own)
            for name, own in texts.items():
                docs[name] = docs.get(name, 0) + len(own)
                grams.setdefault(name, np.zeros(buckets, np.int64))
                for _, _, code, some, _ in trigram_slices(own, buckets):
                    grams[name] += np.bincount(code[some], minlength=buckets)
        for name, counts in grams.items():
            filled = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(filled) + 1), pa.string()),
                    pa.array(np.concatenate(([-1], filled)).astype(np.int32)),
                    pa.array(np.concatenate(([docs[name]], counts[filled]))),
                ],
                names=["lang", "bucket", "n"],
            )

    chosen = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = (
        chosen.filter("lang is not null")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(counts["lang"].unique())
    matrix, prior = np.zeros((buckets, len(langs)), np.float64), np.zeros(len(langs))
    for k, name in enumerate(langs):
        own = counts[counts["lang"] == name]
        grams = own[own["bucket"] >= 0]
        matrix[grams["bucket"].to_numpy(), k] = grams["n"].to_numpy()
        prior[k] = own.loc[own["bucket"] < 0, "n"].sum()
    matrix = np.log(matrix + SMOOTHING) - np.log(matrix.sum(0) + SMOOTHING * buckets)
    return {
        "langs": langs,
        "matrix": np.ascontiguousarray(matrix.T, np.float32),
        "prior": np.log(prior / prior.sum()) if langs else prior,
        "buckets": buckets,
    }


def predict(docs: DataFrame, model: dict, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of the language (see EVIDENCE)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m["langs"], UNDETERMINED], object)
        for batch in batches:
            best, sure = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for first, stop, code, some, bounds in trigram_slices(batch.column(at).to_pylist(), m["buckets"]):
                if not m["langs"]:
                    continue
                found = np.concatenate(([0], np.cumsum(some)))[bounds]
                lettered, n = np.diff(found) > 0, np.maximum(np.diff(found), 1)
                code = code[some]
                logs = np.stack([segment_sums(row[code], found) for row in m["matrix"]], 1)
                logs = logs * (np.minimum(n, EVIDENCE) / n)[:, None] + m["prior"]
                top = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1)[:, None]).sum(1)
                best[first:stop] = np.where(lettered, top, len(names) - 1)
                sure[first:stop] = np.where(lettered, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(sure)], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return docs.mapInArrow(score, out)
