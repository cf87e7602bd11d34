"""Two-level classification with Spark ML pipelines."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, PCA, HashingTF, IndexToString, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.text import effective_text
from labelloom.operators.boosting import BoostedTreesModel, fit_trees
from labelloom.operators.encoders import Factory, fit_word_vectors, send_files, user_encoder
from labelloom.operators.evaluate import classification_report
from labelloom.operators.prepare import known_pairs_only
from labelloom.sources.readers import require_columns

LEVELS = (S.DOMAIN, S.TOPIC)
NARROW = 512  # features that a covariance matrix is cheap for
NO_SPREAD = 1e-12  # directions with less of the variance hold rounding alone


def index_labels(df: DataFrame, level: str):
    """Sorted label values to numbers (fitted indexer). It keeps unseen values of rows to be scored as one number more."""
    return StringIndexer(inputCol=level, outputCol=f"{level}_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)


def text_features(n_features: int = 1 << 12) -> list:
    """Default text encoder: hashed, idf-weighted, length-normalised words."""
    return [
        RegexTokenizer(inputCol="__text", outputCol="__words", pattern="\\W+"),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=n_features),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="features"),
    ]


def prepare_features(df: DataFrame, vector: str | None = None) -> DataFrame:
    """Either a precomputed ``array`` column becomes ``features``, or the text is kept for the encoder."""
    if vector:
        return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return df.withColumn("__text", F.coalesce(effective_text(df), F.lit("")))


def featurize(df: DataFrame, n_features: int = 1 << 12, vector: str | None = None) -> DataFrame:
    """Rows with a ``features`` vector."""
    prepared = prepare_features(df, vector)
    if vector:
        return prepared
    return Pipeline(stages=text_features(n_features)).fit(prepared).transform(prepared).drop("__text", "__words", "__tf", "__idf")


def fit_encoder(rows: DataFrame, encoder: str | Factory, *, n_features: int = 1 << 12, files: Sequence[str] = (), seed: int = S.SEED) -> PipelineModel:
    """From the column ``__text`` to ``features``."""
    if callable(encoder):
        send_files(rows.sparkSession, files)
        return PipelineModel([user_encoder(encoder)])
    if encoder == "vectors":
        return fit_word_vectors(rows, seed=seed)
    if encoder == "words":
        return Pipeline(stages=text_features(n_features)).fit(rows)
    raise ValueError(f"unknown encoder: {encoder}")


def uncorrelated(rows: DataFrame) -> list:
    """Stages that turn narrow features to their principal axes, all of them: logistic regression has the same optimum there.

    It scales each axis by its spread, so that its steps no longer crawl along what the features have in common. Axes without
    any spread are left out, as no row differs in them. No stage where the features are wide or there is nothing to turn.
    """
    width = rows.agg(F.max(F.size(F.unwrap_udt("features")["values"])).alias("values"), F.max(F.unwrap_udt("features")["size"]).alias("size"), F.count("features").alias("n")).first()
    size = width["size"] or width["values"] or 0
    if not 1 < size <= NARROW or width["n"] < 2:
        return []
    turned = PCA(k=size, inputCol="features", outputCol="__axes").fit(rows)
    share = turned.explainedVariance.toArray()
    spread = int((share > NO_SPREAD).sum())  # NaN where all rows are equal
    if spread == 0:
        return []
    return [turned if spread == size else PCA(k=spread, inputCol="features", outputCol="__axes").fit(rows)]


def _fitted_head(rows: DataFrame, features: str, level: str, classes: int, kind: str, max_iter: int, trees: int, depth: int, seed: int):
    columns = {"featuresCol": features, "predictionCol": f"__{level}", "rawPredictionCol": f"__{level}_raw", "probabilityCol": f"__{level}_prob"}
    label = f"{level}_index"
    if kind == "logistic":
        return LogisticRegression(family="multinomial", maxIter=max_iter, labelCol=label, **columns).fit(rows)
    if kind == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, labelCol=label, **columns).fit(rows)
    if kind == "trees":
        return BoostedTreesModel(*fit_trees(rows, classes, label=label, trees=trees, depth=depth, seed=seed), classes, **columns)
    raise ValueError(f"unknown head: {kind}")


def train(
    df: DataFrame,
    head: str = "logistic",
    *,
    vector: str | None = None,
    encoder: str | Factory = "words",
    files: Sequence[str] = (),
    levels: tuple[str, ...] = LEVELS,
    max_iter: int = 1000,
    trees: int = 100,
    depth: int = 6,
    n_features: int = 1 << 12,
    seed: int = S.SEED,
) -> PipelineModel:
    """One pipeline: encoder, then an independent head per label level.

    Encoders of the text: ``words``, hashed words (``n_features`` buckets); ``vectors``, word vectors learned from the given
    text; or a function that loads a model and returns ``texts -> vectors`` (with ``files`` sent to the workers). A ``vector``
    column is used as it is.

    Heads: ``logistic``; ``trees``, boosted trees, one ensemble for all classes; ``forest``, one random forest
    for all classes. The head is always the one asked for, and knows exactly the labels that occur.

    The driver holds coefficients only; gradients and tree statistics are summed on executors. A logistic head on at most NARROW
    features is fitted along their principal axes (``uncorrelated``), which takes far fewer passes. The rows are dealt evenly to
    at least as many tasks as there are cores, however few splits their files have.
    """
    require_columns(df, [*levels, *([] if vector else [S.DESCRIPTION])])
    labelled_rows = prepare_features(df.dropna("any", subset=list(levels)), vector).select(*levels, "features" if vector else "__text")
    splits = (labelled_rows.select(F.spark_partition_id().alias("split")).agg(F.max("split")).first()[0] or 0) + 1
    rows = labelled_rows.repartition(max(df.sparkSession.sparkContext.defaultParallelism, splits)).persist()
    kept = rows
    try:
        fitted_encoder = PipelineModel([]) if vector else fit_encoder(rows, encoder, n_features=n_features, files=files, seed=seed)
        encoded = fitted_encoder.transform(rows)
        if callable(encoder):  # a user's model is not asked again for each pass
            encoded = kept = encoded.select(*levels, "features").persist()
        axes = PipelineModel(uncorrelated(encoded) if head == "logistic" else [])
        encoded, features = axes.transform(encoded), "__axes" if axes.stages else "features"

        def stages_of(level: str) -> list:
            indexer = index_labels(rows, level)
            # a head is fitted to the labels that occur; the number for unseen labels is for rows to be scored alone
            labelled = indexer.copy().setHandleInvalid("error").transform(encoded)
            fitted = _fitted_head(labelled, features, level, len(indexer.labels), head, max_iter, trees, depth, seed)
            return [indexer, fitted, IndexToString(inputCol=f"__{level}", outputCol=f"predicted_{level}", labels=indexer.labels)]

        with ThreadPoolExecutor(len(levels)) as pool:  # the levels' chains of jobs side by side
            fitted = list(pool.map(inheritable_thread_target(df.sparkSession)(stages_of), levels))
        return PipelineModel([*fitted_encoder.stages, *axes.stages, *(stage for stages in fitted for stage in stages)])
    finally:
        kept.unpersist()
        rows.unpersist()


def predict(
    model: PipelineModel,
    df: DataFrame,
    *,
    vector: str | None = None,
    observed: DataFrame | None = None,
) -> DataFrame:
    """Input columns plus ``predicted_domain`` and ``predicted_topic``.

    With ``observed`` (the training table), only predicted pairs that occur there are kept.
    """
    scored = model.transform(prepare_features(df, vector))
    out = scored.select(*df.columns, *[c for c in scored.columns if c.startswith("predicted_")])
    return known_pairs_only(out, observed) if observed is not None else out


def save_model(model: PipelineModel, path: str, config: dict[str, object] | None = None, spark: SparkSession | None = None) -> str:
    """Pipeline and config, the two parts that ``load_model`` needs."""
    model.write().overwrite().save(f"{path}/pipeline")
    session = spark or SparkSession.active()
    line = session.createDataFrame([(json.dumps(config or {}, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/config")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, object]]:
    """(pipeline, config); an error names the part that is missing."""
    parts = {}
    for name, load in (("pipeline", PipelineModel.load), ("config", lambda p: spark.read.text(p).first())):
        try:
            parts[name] = load(f"{path}/{name}")
        except Exception as error:
            raise FileNotFoundError(f"no saved {name} under {path}") from error
    return parts["pipeline"], json.loads(parts["config"]["value"])


def evaluate(model: PipelineModel, df: DataFrame, *, vector: str | None = None) -> DataFrame:
    """Classification report of both levels on labelled rows; rows are predicted once."""
    return classification_report(predict(model, df, vector=vector))
