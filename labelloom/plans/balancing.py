"""Balance a labelled CSV with an injected generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelloom import schema as S
from labelloom.operators.balance import balance
from labelloom.operators.enrich import generate_responses
from labelloom.operators.generate import build_prompts, generation_stats, plan_batches
from labelloom.operators.profile import balance_report
from labelloom.operators.split import evaluation_part, training_part
from labelloom.sources.readers import read_definitions, read_labelled
from labelloom.sources.writers import write_csv, write_if_any


def balance_file(
    spark: SparkSession,
    path: str,
    out: str,
    generator: Callable[[str], str] | None = None,
    *,
    definitions_path: str | None = None,
    cap: int = S.CLASS_CAP,
    batch_size: int = S.GENERATION_BATCH,
    mode: str = "all_or_nothing",
    seed: int = S.SEED,
) -> dict[str, DataFrame]:
    """Write original, training, evaluation (when any) and report; return the report tables.

    Only the generator call touches the outside; its answers are checkpointed, everything else can be
    recomputed.
    """
    df = read_labelled(spark, path)
    responses = None
    if generator is not None:
        definitions = read_definitions(spark, definitions_path)[0] if definitions_path else None
        plan = plan_batches(df, cap, batch_size, fixed_context=5 if mode == "per_line" else None)
        used = df if mode == "per_line" else None
        prompts = build_prompts(df, plan, definitions=definitions, used=used, seed=seed)
        responses = generate_responses(prompts, generator)
    result = balance(df, responses, cap, mode=mode, batch_size=batch_size, seed=seed)
    write_csv(df, f"{out}/original_data.csv")
    write_csv(training_part(result).drop("origin"), f"{out}/balanced_training_data.csv")
    write_if_any(evaluation_part(result).drop("origin"), f"{out}/evaluation_data.csv")
    report = balance_report(result)
    report.write.mode("overwrite").option("header", True).csv(f"{out}/balance_report")
    tables = {"report": report}
    if responses is not None:
        tables["generation"] = generation_stats(df, responses, cap=cap, mode=mode, batch_size=batch_size)
    return tables
