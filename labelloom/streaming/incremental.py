"""Chunked scans as Structured Streaming: files arrive, micro-batches are scored, output appends.

The row-wise operators (label masks, text specs, lookups, model and template prediction) run unchanged
on streaming frames. Progress lives in the checkpoint folder, so a restarted run continues after the
last committed chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labelloom import schema as S
from labelloom.operators.profile import cardinality_sketches
from labelloom.sources.readers import null_out


def stream_csv(
    spark: SparkSession, folder: str, schema: T.StructType = S.LABELLED_SCHEMA, *, files_per_chunk: int = 100
) -> DataFrame:
    """Streaming scan of a folder of header CSV files."""
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("maxFilesPerTrigger", files_per_chunk)
        .csv(folder)
    )
    return null_out(raw)


def run_incrementally(
    stream: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Apply a row-wise step to all files not yet seen, append the result, then stop."""
    return (
        step(stream)
        .writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def sketch_incrementally(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep a row of cardinality sketches per micro-batch of files not yet seen; unite them with ``united_cardinalities``.

    A batch that runs twice replaces its own folder.
    """

    def keep(chunk: DataFrame, batch: int) -> None:
        cardinality_sketches(chunk).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
