"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Features are the distinct hash buckets of a text's lower-cased words, neighbouring pairs and pairs with
one word between them, each with value 1 / (number of features) ** POWER. Every shard of labelled rows
runs some passes of FTRL (a learning rate per coordinate, L1 and L2 terms), and the shards' weights are
averaged. L1 leaves few weights, which are broadcast as two short arrays.

The fit reads at most ``max_rows`` labelled rows, chosen by a hash of the id (a documented bound); all
rows are scored.

Defined cases: null and empty texts have no features and get the score of the intercept alone; null
labels don't train; a document labelled twice counts with its largest label; without rows of both
labels every score is the share of ones (0 if there are none); repeated rows are scored alike, null ids like others (but don't
train); texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.hashing import hash_int
from labelloom.llm.textkit import ALNUM, LOWER, counted, mix, text_slices, word_bounds, word_hashes

BITS = 20
MAX_ROWS = 30_000
#: Rows of one shard; more rows make more shards.
SHARD_ROWS = 8_000
PASSES = 8
ALPHA, BETA, L1, L2 = 4.0, 1.0, 1.0, 0.0
POWER = 0.25


def feature_slices(column: pa.Array, bits: int = BITS):
    """(first row, row after, distinct buckets, first bucket of each row and the total) of slices of texts."""
    shift = np.uint64(64 - bits)
    for first, stop, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, at = word_bounds(data, offsets, ALNUM)
        words = word_hashes(data, starts, ends)
        row = np.repeat(np.arange(stop - first), np.diff(at))
        keys = [(row.astype(np.uint64) << np.uint64(32)) | (mix(words) >> shift)]
        for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            if len(words) > gap:
                same = row[gap:] == row[:-gap]
                pair = mix(words[:-gap] * np.uint64(odd) + words[gap:])[same] >> shift
                keys.append((row[:-gap][same].astype(np.uint64) << np.uint64(32)) | pair)
        keys = np.concatenate(keys)
        keys.sort()
        keys = counted(keys)[0]
        yield first, stop, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(keys, np.arange(stop - first + 1, dtype=np.uint64) << np.uint64(32))


def ftrl(examples: list[tuple[np.ndarray, int]], start: np.ndarray, bias: float, size: int) -> tuple[np.ndarray, float]:
    """One pass of FTRL-proximal over the examples; z is set so that the first weights equal ``start``."""
    n = np.zeros(size)
    z = np.where(start != 0, -start * (BETA / ALPHA + L2) - np.sign(start) * L1, 0.0)
    n0, z0 = 0.0, -bias * BETA / ALPHA
    for feats, y in examples:
        x = max(len(feats), 1) ** -POWER
        zi, ni = z[feats], n[feats]
        root = np.sqrt(ni)
        w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2), 0.0)
        w0 = -z0 / ((BETA + np.sqrt(n0)) / ALPHA)
        p = 1 / (1 + np.exp(-np.clip(w.sum() * x + w0, -35, 35)))
        g = (p - y) * x
        z[feats] += g - (np.sqrt(ni + g * g) - root) / ALPHA * w
        n[feats] += g * g
        g0 = p - y
        z0 += g0 - (np.sqrt(n0 + g0 * g0) - np.sqrt(n0)) / ALPHA * w0
        n0 += g0 * g0
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w, -z0 / ((BETA + np.sqrt(n0)) / ALPHA)


def labelled_features(docs: DataFrame, labels: DataFrame, *, max_rows: int, bits: int) -> DataFrame:
    """(order, y, feats) of at most ``max_rows`` labelled texts, the first in the order of a hash of the id."""
    marks = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("__y"))
        .withColumn("__order", hash_int(7, "toxic", "doc_id"))
        .orderBy("__order", "doc_id")
        .limit(max_rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # max_rows bounds it

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, feats, at in feature_slices(batch.column(0), bits):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(first, stop - first),
                        batch.column(2).slice(first, stop - first),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(feats.astype(np.int32))),
                    ],
                    names=["order", "y", "feats"],
                )

    return chosen.select("text", "__order", "__y").mapInArrow(features, "order long, y int, feats array<int>")


def fit_shard(pdf: pd.DataFrame, *, bits: int, passes: int) -> pd.DataFrame:
    """(bucket, w, rows, ones) of one shard: the weights that aren't 0, and the intercept as bucket -1."""
    pdf = pdf.sort_values("order", kind="stable")
    share = (pdf["y"].sum() + 0.5) / (len(pdf) + 1)
    weights, bias = np.zeros(1 << bits), float(np.log(share / (1 - share)))
    if 0 < pdf["y"].sum() < len(pdf):
        examples = list(zip(pdf["feats"], pdf["y"]))
        for _ in range(passes):
            weights, bias = ftrl(examples, weights, bias, 1 << bits)
    filled = np.flatnonzero(weights)
    out = pd.DataFrame({"bucket": np.concatenate(([-1], filled)), "w": np.concatenate(([bias], weights[filled]))})
    return out.assign(rows=len(pdf), ones=int(pdf["y"].sum()))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, bits: int = BITS, passes: int = PASSES) -> dict:
    """Sparse weights of a model fitted on labelled documents: buckets, weights, bias, share of ones, bits."""
    shards = max(1, -(-min(max_rows, labels.count()) // SHARD_ROWS))
    rows = labelled_features(docs, labels, max_rows=max_rows, bits=bits).withColumn("shard", (F.col("order") % shards).cast("int"))
    fit = partial(fit_shard, bits=bits, passes=passes)
    parts = rows.groupBy("shard").applyInPandas(lambda pdf: fit(pdf), "bucket int, w double, rows long, ones long").toPandas()
    heads = parts[parts["bucket"] == -1]
    total, ones = int(heads["rows"].sum()), int(heads["ones"].sum())
    model = {"buckets": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": None, "share": ones / total if total else 0.0, "bits": bits}
    if 0 < ones < total:
        mean = (parts["w"] * parts["rows"] / total).groupby(parts["bucket"]).sum()
        model["bias"] = float(mean[-1])
        mean = mean[mean.index >= 0]
        model |= {"buckets": mean.index.to_numpy(np.int64), "weights": mean.to_numpy()}
    return model


def score(docs: DataFrame, model: dict, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = np.zeros(1 << m["bits"])
        dense[m["buckets"]] = m["weights"]
        for batch in batches:
            p = np.full(batch.num_rows, m["share"])
            if m["bias"] is not None:
                for first, stop, feats, bounds in feature_slices(batch.column(at), m["bits"]):
                    n = np.diff(bounds)
                    sums = np.bincount(np.repeat(np.arange(stop - first), n), dense[feats], stop - first)
                    logit = sums * np.maximum(n, 1) ** -POWER + m["bias"]
                    p[first:stop] = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"]
            )

    return docs.mapInArrow(run, out)
