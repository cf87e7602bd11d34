"""Train, predict and evaluate runs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from labelloom import schema as S
from labelloom.operators.classify import evaluate, load_model, predict, save_model, train
from labelloom.operators.enrich import enrich_text
from labelloom.operators.prepare import parse_text_spec, with_attribute_name
from labelloom.operators.split import train_test_split
from labelloom.operators.tracking import choose_model, flatten_metrics, save_experiment
from labelloom.session import materialise
from labelloom.sources.readers import read_labelled
from labelloom.sources.writers import timestamped_path, write_csv


def run_training(
    spark: SparkSession,
    df: DataFrame,
    out: str,
    *,
    head: str = "logistic",
    vector: str | None = None,
    rewrite: Callable[[str], str] | None = None,
    share: float = S.TEST_SHARE,
    seed: int = S.SEED,
    **options,
) -> tuple[str, DataFrame]:
    """Split, (optionally) rewrite, train, evaluate and record. Returns (model path, report)."""
    rows = enrich_text(with_attribute_name(df), rewrite) if rewrite else df
    split = train_test_split(rows, share, seed=seed)
    fitted = train(split.filter("split = 'train'").drop("split"), head, vector=vector, seed=seed, **options)
    path = f"{out}/model_{datetime.now():%Y%m%d_%H%M%S_%f}"
    config = {"head": head, "vector": vector or "", "share": share, "seed": seed, **options}
    save_model(fitted, path, config, spark)
    report = materialise(evaluate(fitted, split.filter("split = 'test'").drop("split"), vector=vector))
    save_experiment(spark, f"{out}/history", path, config, flatten_metrics(report))
    return path, report


def predict_csv(
    spark: SparkSession,
    path: str,
    out: str,
    *,
    model_path: str | None = None,
    history: str | None = None,
    metric: str = "domain_accuracy",
) -> str:
    """Score a CSV with the given or best recorded model; returns the path written."""
    chosen = choose_model(spark, history or "", metric, model_path)
    model, _ = load_model(spark, chosen)
    rows = with_attribute_name(read_labelled(spark, path, required=[S.DESCRIPTION]))
    return write_csv(predict(model, rows), timestamped_path(out))


def predict_texts(spark: SparkSession, model_path: str, specs: DataFrame, column: str = "value") -> DataFrame:
    """Score texts given as ``name: text``."""
    model, _ = load_model(spark, model_path)
    return predict(model, parse_text_spec(specs, column))


def evaluate_csv(spark: SparkSession, path: str, model_path: str) -> DataFrame:
    model, _ = load_model(spark, model_path)
    return evaluate(model, read_labelled(spark, path, required=S.TRAINING_COLUMNS))
