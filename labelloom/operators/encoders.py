"""Text encoders for training: word vectors learned from the text, and a user's own model.

Both are pipeline stages, so a trained model carries its encoder.

Word vectors come from Spark ML's Word2Vec; a text is the mean of its words' vectors, each weighted by a / (a + share of the
word among all words), so that words that are everywhere say little. The vocabulary (words of at least ``min_count``
occurrences) is held by the driver and sent to every task, as Word2Vec itself does; raise ``min_count`` for large corpora.

A user encoder is a function that loads a model and returns ``texts -> vectors``. It is called once per Python worker, not per
batch; the files it needs can be sent with ``files`` and are found by ``pyspark.SparkFiles.get``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.feature import Normalizer, RegexTokenizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.ranking import bucket_count
from labelloom.session import materialise

Encode = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Factory = Callable[[], Encode]

DIMENSIONS = 64
SMOOTH = 1e-3  # words rarer than this share of all count nearly in full


# --- word vectors ------------------------------------------------------------------------------


class WordVectorsModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Weighted mean of word vectors; a text without a known word is the zero vector."""

    def __init__(self, words: list[str] | None = None, weights: np.ndarray | None = None, vectors: np.ndarray | None = None, **columns: str):
        super().__init__()
        self.words, self.weights, self.vectors = words or [], weights, vectors
        self._set(**columns)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        place = {w: k for k, w in enumerate(self.words)}
        shared = dataset.sparkSession.sparkContext.broadcast((place, self.weights, self.vectors))

        @F.pandas_udf("array<double>")
        def mean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            place, weights, vectors = shared.value
            for batch in batches:
                out = np.zeros((len(batch), vectors.shape[1]))
                for k, words in enumerate(batch):
                    at = [place[w] for w in words if w in place] if words is not None else []
                    if at:
                        own = weights[at]
                        out[k] = own @ vectors[at] / own.sum()
                yield pd.Series(list(out))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mean(F.col(self.getInputCol()))))

    def write(self) -> MLWriter:
        return _WordWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _WordReader()


class _WordWriter(MLWriter):
    def __init__(self, model: WordVectorsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, m = SparkSession.active(), self.model
        DefaultParamsWriter.saveMetadata(m, path, spark)
        rows = [(k, w, float(m.weights[k]), m.vectors[k].tolist()) for k, w in enumerate(m.words)]
        spark.createDataFrame(rows, "place int, word string, weight double, vector array<double>").write.parquet(f"{path}/words")


class _WordReader(MLReader):
    def load(self, path: str) -> WordVectorsModel:
        spark = SparkSession.active()
        rows = spark.read.parquet(f"{path}/words").toPandas().sort_values("place")
        vectors = np.stack(rows["vector"].tolist()) if len(rows) else np.zeros((0, DIMENSIONS))
        model = WordVectorsModel(rows["word"].tolist(), rows["weight"].to_numpy(), vectors)
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def fit_word_vectors(
    rows: DataFrame, text: str = "__text", *, dims: int = DIMENSIONS, min_count: int = 2, window: int = 5, rounds: int = 5, seed: int = S.SEED
) -> PipelineModel:
    """Tokeniser, learned word vectors and normaliser, from the column ``text`` to ``features``."""
    tokens = RegexTokenizer(inputCol=text, outputCol="__words", pattern="\\W+")
    split = materialise(tokens.transform(rows.select(text)).select("__words"))
    counts = split.select(F.explode("__words").alias("word")).groupBy("word").count()
    known = materialise(counts.filter(F.col("count") >= min_count))
    if known.isEmpty():
        return PipelineModel([tokens, WordVectorsModel([], np.zeros(0), np.zeros((0, dims)), inputCol="__words", outputCol="features")])
    learner = Word2Vec(
        vectorSize=dims, minCount=min_count, windowSize=window, maxIter=rounds, numPartitions=bucket_count(rows), seed=seed, inputCol="__words", outputCol="__mean"
    )
    vectors = learner.fit(split).getVectors().select("word", vector_to_array("vector").alias("vector"))
    total = counts.agg(F.sum("count")).scalar()
    weight = F.lit(SMOOTH) / (F.lit(SMOOTH) + F.col("count") / total)
    found = vectors.join(known, "word").select("word", weight.alias("weight"), "vector").orderBy("word").toPandas()  # the vocabulary
    learned = WordVectorsModel(found["word"].tolist(), found["weight"].to_numpy(), np.stack(found["vector"].tolist()), inputCol="__words", outputCol="__mean")
    return PipelineModel([tokens, learned, Normalizer(inputCol="__mean", outputCol="features")])


# --- a user's own model ------------------------------------------------------------------------

_LOADED: dict[str, Encode] = {}


def _loaded(name: str, factory: Factory) -> Encode:
    """The model of this Python worker; it is loaded at its first use there."""
    if name not in _LOADED:
        _LOADED.clear()  # a worker serves one encoder at a time; an older one need not stay in memory
        _LOADED[name] = factory()
    return _LOADED[name]


def _by_name(name: str) -> Factory:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class UserEncoder(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """A user's model as a stage. It can be saved if its factory is a function that can be imported by name."""

    factory = Param(Params._dummy(), "factory", "module:function that loads the model", typeConverter=TypeConverters.toString)
    batch = Param(Params._dummy(), "batch", "texts per call", typeConverter=TypeConverters.toInt)

    def __init__(self, load: Factory | None = None, batch: int = 32, **columns: str):
        super().__init__()
        self.load_model = load
        self.key = uuid4().hex
        self._set(batch=batch, **columns)
        if load is not None:
            self._set(factory=f"{load.__module__}:{load.__qualname__}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getOrDefault(self.factory)
        load, key, size = self.load_model or _by_name(name), self.key, self.getOrDefault(self.batch)

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _loaded(key, load)
            for texts in batches:
                listed, out = texts.fillna("").tolist(), []
                for start in range(0, len(listed), size):
                    part = listed[start : start + size]
                    vectors = [np.asarray(v, dtype="float64") for v in model(part)]
                    if len(vectors) != len(part):
                        raise ValueError("the encoder must answer every text")
                    out.extend(vectors)
                yield pd.Series(out, dtype="object")

        return dataset.withColumn(self.getOutputCol(), array_to_vector(encode(F.col(self.getInputCol()))))

    def write(self) -> MLWriter:
        name = self.getOrDefault(self.factory)
        if "<" in name or name.startswith("__main__"):
            raise ValueError(f"an encoder can only be saved if its factory can be imported, not {name}")
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


def send_files(spark: SparkSession, files: Sequence[str]) -> None:
    """Copies model files to every worker; a factory finds them by ``SparkFiles.get(name)``."""
    for f in files:
        spark.sparkContext.addFile(f, recursive=True)


def user_encoder(load: Factory, *, text: str = "__text", out: str = "features", batch: int = 32) -> UserEncoder:
    return UserEncoder(load, batch, inputCol=text, outputCol=out)
