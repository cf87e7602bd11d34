"""User functions over batches of texts: map, rewrite, generate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import schema as S
from labelloom.functions.text import after_prefix
from labelloom.session import materialise

PIECE_ROWS = 256  # rows whose texts a task holds at once

BatchFunction = Callable[[Sequence[str]], Sequence[str]]


def map_batches(
    df: DataFrame, fn: BatchFunction, column: str, batch_size: int = 32, *, out: str = "mapped"
) -> DataFrame:
    """Apply ``fn`` to lists of at most ``batch_size`` texts; answers stay with their rows."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    piece = max(1, PIECE_ROWS // batch_size) * batch_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts may be long: only a piece of an Arrow batch is held as Python strings, with its answers
            for first in range(0, batch.num_rows, piece):
                rows = batch.slice(first, piece)
                texts = rows.column(column).to_pylist()
                answers: list[str] = []
                for start in range(0, len(texts), batch_size):
                    part = texts[start : start + batch_size]
                    got = list(fn(part))
                    if len(got) != len(part):
                        raise ValueError("batch function must answer every text")
                    answers.extend(got)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string())], names=[*rows.schema.names, out])

    return df.mapInArrow(run, schema)


def _spread(df: DataFrame, tasks: int | None) -> DataFrame:
    return df.repartition(tasks or df.sparkSession.sparkContext.defaultParallelism)


def refine_prompt() -> F.Column:
    """Prompt that asks for a clearer description of one attribute."""
    return F.concat(
        F.lit("Rewrite this attribute description in one clear, concise sentence.\nAttribute: "),
        F.coalesce(F.col(S.NAME), F.lit("")),
        F.lit("\nDescription: "),
        F.coalesce(F.col(S.DESCRIPTION), F.lit("")),
        F.lit("\nAnswer as: " + S.REWRITE_PREFIX + " <text>"),
    )


def enrich_text(
    df: DataFrame,
    fn: Callable[[str], str],
    *,
    enabled: bool = True,
    retries: int = 3,
    persist: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Add ``processed_description``: the user's rewrite of each description.

    Each distinct (name, description) is sent once. After ``retries`` failures the original text
    stays, with ``rewrite_status`` = ``failed``. Disabled: the frame is returned unchanged. The
    answers are written once, so later stages never call the function again. The calls are spread over
    ``tasks`` tasks (default: one per core), because a slow function is the cost here, not the bytes.
    """
    if not enabled:
        return df
    schema = T.StructType(
        [
            T.StructField(S.NAME, T.StringType()),
            T.StructField(S.DESCRIPTION, T.StringType()),
            T.StructField("__answer", T.StringType()),
            T.StructField("attempts", T.LongType()),
            T.StructField("rewrite_status", T.StringType()),
        ]
    )

    def ask(prompt: str) -> tuple[str | None, int, str]:
        for attempt in range(1, retries + 1):
            try:
                return fn(prompt), attempt, "ok"
            except Exception:  # noqa: BLE001 - any failure of the user function counts as one attempt
                continue
        return None, retries, "failed"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = [ask(p) for p in frame["__prompt"]]
            yield pd.DataFrame(
                {
                    S.NAME: frame[S.NAME],
                    S.DESCRIPTION: frame[S.DESCRIPTION],
                    "__answer": [a[0] for a in asked],
                    "attempts": [a[1] for a in asked],
                    "rewrite_status": [a[2] for a in asked],
                }
            )

    inputs = df.select(S.NAME, S.DESCRIPTION).distinct().withColumn("__prompt", refine_prompt())
    answers = _spread(inputs, tasks).mapInPandas(run, schema)
    if persist:
        answers = materialise(answers)
    answers = answers.select(
        F.col(S.NAME).alias("__n"), F.col(S.DESCRIPTION).alias("__d"), "__answer", "attempts", "rewrite_status"
    )
    same = F.col(S.NAME).eqNullSafe(F.col("__n")) & F.col(S.DESCRIPTION).eqNullSafe(F.col("__d"))
    return (
        df.join(answers, same, "left")
        .withColumn(S.PROCESSED, F.coalesce(after_prefix(F.col("__answer")), F.col(S.DESCRIPTION)))
        .drop("__n", "__d", "__answer")
    )


def generate_responses(
    prompts: DataFrame,
    fn: Callable[[str], str],
    *,
    retries: int = 3,
    persist: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Send each planned prompt to the user's generator once; the answers become a response table.

    A prompt that keeps failing gives a null response. The table is written once by default.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for prompt in frame["prompt"]:
                answer = None
                for _ in range(retries):
                    try:
                        answer = fn(prompt)
                        break
                    except Exception:  # noqa: BLE001
                        continue
                answers.append(answer)
            yield frame[[*S.CLASS, "batch_id"]].assign(response=pd.Series(answers, index=frame.index, dtype="object"))

    out = _spread(prompts, tasks).mapInPandas(run, S.RESPONSE_SCHEMA)
    return materialise(out) if persist else out
