"""Sinks. All write folders through Spark's output commit protocol, never through the driver."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", *, names: dict[str, str] | None = None) -> str:
    """Header CSV, quotes doubled, without the technical row id. ``names`` maps columns to names of the file."""
    df.drop(S.ROW_ID).withColumnsRenamed(names or {}).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write only when there is at least one row; tells whether it wrote."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


# File names and line forms that readers of the files expect.
def cleaned_path(path: str) -> str:
    return path.replace(".csv", "_cleaned.csv") if ".csv" in path else path.rstrip("/") + "_cleaned"


def timestamped_path(folder: str, stem: str = "predictions", now: datetime | None = None) -> str:
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return f"{folder.rstrip('/')}/{stem}_{stamp}.csv"


def write_report(df: DataFrame, path: str) -> str:
    """A report table as UTF-8 text lines ``column=value`` in column order."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)
    return path


def distribution_text(distribution_df: DataFrame) -> DataFrame:
    """Readable lines of a distribution table."""
    return distribution_df.select(
        F.format_string(
            "%s: %d records (%.2f%%) | %s: %d records (%.2f%% of domain)",
            F.col(S.DOMAIN), F.col("domain_count"), F.col("domain_pct"),
            F.col(S.TOPIC), F.col("topic_count"), F.col("topic_pct"),
        ).alias("value")
    )


def write_json_stats(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
