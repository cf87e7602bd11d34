"""Readers with explicit schemas, column checks and null rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelloom import schema as S
from labelloom.functions.text import strip


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def null_out(df: DataFrame, na_values: Iterable[str] = S.NA_VALUES) -> DataFrame:
    """Map the usual spellings of a missing value in string columns to null."""
    markers = list(na_values)
    columns = [
        F.when(F.col(f.name).isin(markers), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    required: Iterable[str] = (),
    multi_line: bool = True,
    na_values: Iterable[str] | None = S.NA_VALUES,
    encoding: str = "UTF-8",
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Header CSV as strings. ``names`` maps the file's column names to the library's, where they differ.

    Quoted line breaks need ``multi_line``; such files are not splittable, so give a folder of
    files, or convert once to Parquet. ``multi_line=False`` splits large files.
    """
    frame = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("inferSchema", False)
        .csv(path)
    )
    frame = frame.withColumnsRenamed(names or {})
    require_columns(frame, required)
    return null_out(frame, na_values) if na_values is not None else frame


def with_row_id(df: DataFrame, out: str = S.ROW_ID) -> DataFrame:
    """Numbers the rows of a file scan from 0 in the order of file path, block and line.

    A block is read in order by one task, so its rows have consecutive numbers there; they are shifted
    by the rows of all earlier blocks. The result depends neither on how Spark packs and
    schedules blocks nor on the number of cores, and rows aren't shuffled.
    """
    block = ["__file", "__block"]
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
    )
    blocks = placed.groupBy(*block).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    shift = blocks.select(*block, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(shift, block).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(out))


def read_labelled(
    spark: SparkSession, path: str, *, required: Iterable[str] = S.LABELLED_COLUMNS, **options
) -> DataFrame:
    return with_row_id(read_csv(spark, path, required=required, **options))


def read_templates(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, required=S.TEMPLATE_COLUMNS, **options).select(*S.TEMPLATE_COLUMNS)


def parse_definitions(lines: DataFrame, value: str = "value", order_by: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(definitions, rejects) of ``domain|topic|definition`` lines.

    Blank lines and ``#`` comments are skipped; of repeated keys the last line wins; lines without
    exactly three fields are rejects.
    """
    kept = lines.filter((strip(F.col(value)) != "") & ~F.col(value).startswith("#"))
    parts = F.split(strip(F.col(value)), "\\|")
    split = kept.withColumn("__parts", parts)
    good = split.filter(F.size("__parts") == 3).select(
        strip(F.col("__parts")[0]).alias(S.DOMAIN),
        strip(F.col("__parts")[1]).alias(S.TOPIC),
        strip(F.col("__parts")[2]).alias("definition"),
        F.col(order_by),
    )
    last = Window.partitionBy(*S.CLASS).orderBy(F.desc(order_by))
    definitions = (
        good.withColumn("__rn", F.row_number().over(last)).filter("__rn = 1").select(*S.CLASS, "definition")
    )
    rejects = split.filter(F.size("__parts") != 3).select(order_by, value)
    return definitions, rejects


def read_definitions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_definitions(with_row_id(spark.read.text(path), "line_no"))


HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(experiment records, corrupt lines) of an experiment history folder."""
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    parsed = lines.select(
        F.from_json("value", HISTORY_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    ).select("r.*")
    bad = F.col("_corrupt_record").isNotNull()
    return parsed.filter(~bad).drop("_corrupt_record"), parsed.filter(bad).select("_corrupt_record")
