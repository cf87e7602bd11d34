"""Experiment records and metric histories."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.readers import HISTORY_SCHEMA, read_history


def save_experiment(
    spark: SparkSession,
    history: str,
    path: str,
    config: dict[str, object],
    metrics: dict[str, float],
    *,
    now: datetime | None = None,
) -> None:
    """Append one record to the history folder; the commit protocol makes it all or nothing.

    Nested metrics are flattened with dots before they come here (see ``flatten_metrics``).
    """
    moment = now or datetime.now(timezone.utc)
    record = [
        (
            int(moment.timestamp() * 1_000_000),
            moment.isoformat(),
            path,
            {k: str(v) for k, v in config.items()},
            {k: float(v) for k, v in metrics.items()},
            None,
        )
    ]
    spark.createDataFrame(record, HISTORY_SCHEMA).drop("_corrupt_record").coalesce(1).write.mode("append").json(history)


def flatten_metrics(report: DataFrame) -> dict[str, float]:
    """Averages and accuracy of a classification report as flat names (a handful of rows)."""
    rows = report.filter("kind <> 'label'").select("level", "kind", "precision", "recall", "f1").collect()
    out: dict[str, float] = {}
    for r in rows:
        if r["kind"] == "accuracy":
            out[f"{r['level']}_accuracy"] = r["f1"]
        else:
            prefix = f"{r['level']}_metrics.{r['kind'].replace(' ', '_')}"
            out.update({f"{prefix}.{m}": r[m] for m in ("precision", "recall", "f1")})
    return out


def best_experiment(experiments: DataFrame, metric: str) -> DataFrame:
    """Record with the largest metric; a missing metric is minus infinity; the first wins a tie."""
    value = F.coalesce(F.element_at("metrics", metric), F.lit(float("-inf")))
    return experiments.agg(
        F.max_by("path", F.struct(value.alias("v"), (-F.col("seq")).alias("s"))).alias("path"),
        F.max(value).alias("value"),
    )


def choose_model(spark: SparkSession, history: str, metric: str = "domain_accuracy", path: str | None = None) -> str:
    """The given model path, or the best one on record."""
    if path:
        return path
    records, _ = read_history(spark, history)
    best = best_experiment(records, metric).first()
    if best is None or best["path"] is None:
        raise ValueError("no experiment on record")
    return best["path"]


def metric_last(history: DataFrame) -> DataFrame:
    """Last value of each (phase, metric) of an append-only (phase, metric, epoch, value) table."""
    return history.groupBy("phase", "metric").agg(
        F.max("epoch").alias("epoch"), F.max_by("value", "epoch").alias("value"), F.count(F.lit(1)).alias("epochs")
    )


def append_metrics(history: DataFrame, path: str) -> None:
    history.write.mode("append").parquet(path)
