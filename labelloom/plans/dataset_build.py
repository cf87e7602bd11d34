"""From taxonomy and master definitions to the labelled table, its report and the masked test set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.operators.prepare import build_labelled, drop_incomplete, incomplete_counts, mask_labels
from labelloom.operators.profile import distribution, ordered_report
from labelloom.session import materialise
from labelloom.sources.readers import read_csv, with_row_id
from labelloom.sources.writers import distribution_text, write_csv


@dataclass
class DatasetPaths:
    labelled: str
    masked: str
    report: str
    dropped: int


def build_dataset(
    spark: SparkSession, taxonomy_path: str, master_path: str, out: str, *, seed: int = S.SEED
) -> DatasetPaths:
    """Write ``input.csv``, ``test.csv`` and the distribution report. The join is computed once."""
    taxonomy = with_row_id(read_csv(spark, taxonomy_path, required=S.TAXONOMY_COLUMNS))
    master = read_csv(spark, master_path, required=S.MASTER_COLUMNS)
    joined = materialise(build_labelled(taxonomy, master).drop(S.ROW_ID))
    complete: DataFrame = drop_incomplete(joined)
    paths = DatasetPaths(f"{out}/input.csv", f"{out}/test.csv", f"{out}/distribution_analysis.txt", 0)
    write_csv(complete, paths.labelled)
    content = F.concat_ws("|", *S.LABELLED_COLUMNS)  # equal rows are masked alike, wherever they lie
    write_csv(mask_labels(complete, seed=seed, id_col=content).drop("mask"), paths.masked)
    distribution_text(ordered_report(distribution(complete))).write.mode("overwrite").text(paths.report)
    paths.dropped = incomplete_counts(joined).first()["dropped"]
    return paths
