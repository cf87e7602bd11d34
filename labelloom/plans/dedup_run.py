"""Duplicate analysis and cleaning of one CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom import schema as S
from labelloom.operators.dedup import duplicate_stats, keep_first
from labelloom.operators.profile import topic_share, domain_counts
from labelloom.sources.readers import read_labelled
from labelloom.sources.writers import cleaned_path, write_csv


def deduplicate_csv(spark: SparkSession, path: str, out: str | None = None) -> tuple[str, dict[str, DataFrame]]:
    """Write the cleaned CSV; return its path and the report tables."""
    df = read_labelled(spark, path, required=S.DEDUP_COLUMNS)
    cleaned = keep_first(df)
    target = write_csv(cleaned, out or cleaned_path(path))
    return target, {
        "duplicates": duplicate_stats(df),
        "domains": domain_counts(df, cleaned),
        "topics": topic_share(cleaned),
    }
