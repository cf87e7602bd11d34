"""Sources, sinks and file flows: the given tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.operators import classify, profile, split, tracking
from labelloom.operators.dedup import keep_first
from labelloom.plans import views as V
from labelloom.plans.catalogue import evaluation, profiling
from labelloom.plans.catalogue.sql import using
from labelloom.plans.dataset_build import build_dataset
from labelloom.plans.dedup_run import deduplicate_csv
from labelloom.plans.training import predict_csv, run_training
from labelloom.session import ensure_checkpoint_dir
from labelloom.sources import readers, writers
from labelloom.streaming.incremental import run_incrementally, sketch_incrementally, stream_csv

#: Names of the columns in the files of these flows, and what the library calls them.
FILE_NAMES = {"field": S.NAME, "text": S.DESCRIPTION, "area": S.DOMAIN, "kind": S.TOPIC}


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/labelloom-{name}-{uuid.uuid4().hex}"


#: Bytes of text in a file: a file with quoted line breaks is read by one task.
FILE_BYTES = 32 << 20


def _in_file_order(df: DataFrame) -> DataFrame:
    """Files of bounded size whose path order is the order of the row ids."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"]
    size = df.agg(F.sum(sum(texts, F.lit(0)).cast("bigint"))).first()[0] or 0
    # ranges hold like numbers of rows, so a range of long texts is larger than another
    return df.repartitionByRange(max(4, -(-size // FILE_BYTES)), S.ROW_ID).sortWithinPartitions(S.ROW_ID)


def _attributes_file(spark, sf, rows=None, **options) -> str:
    rows = V.attributes(spark, sf) if rows is None else rows
    return writers.write_csv(_in_file_order(rows), _folder(spark, "csv"), **options)


def _round_trip(spark, sf):
    back = {v: k for k, v in FILE_NAMES.items()}
    return readers.read_labelled(spark, _attributes_file(spark, sf, names=back), names=FILE_NAMES)


def _round_trip_documents(spark, sf):
    """Texts with line breaks and quotes; row ids by file order."""
    path = _attributes_file(spark, sf, V.doc_attributes(spark, sf))
    back = readers.read_labelled(spark, path)
    return back.select(S.ROW_ID, F.md5(S.DESCRIPTION).alias("digest"), S.DOMAIN, S.TOPIC)


def _latin_file(spark, sf):
    """A file in another encoding."""
    path = _folder(spark, "latin")
    rows = V.attributes(spark, sf).withColumn(S.NAME, F.concat(S.NAME, F.lit(" é")))
    rows.select(*S.LABELLED_COLUMNS).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_csv(spark, path, required=S.LABELLED_COLUMNS, multi_line=False, encoding="ISO-8859-1")


def _streamed(spark, sf):
    """The file in chunks, as a stream, counted by class."""
    rows = stream_csv(spark, _attributes_file(spark, sf))
    out = _folder(spark, "stream")
    run_incrementally(rows, lambda chunk: chunk, out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).groupBy(*S.CLASS).agg(F.count(F.lit(1)).alias("n"))


def _definitions(spark, sf):
    path = _folder(spark, "definitions")
    lines = V.definition_lines(spark, sf).repartitionByRange(3, "line_no").sortWithinPartitions("line_no")
    lines.select("value").write.text(path)
    return readers.read_definitions(spark, path)[0]


def _templates(spark, sf):
    return readers.read_templates(spark, writers.write_csv(V.templates(spark, sf), _folder(spark, "templates")))


def _history(spark, sf) -> str:
    path = _folder(spark, "history")
    V.experiments(spark, sf).select(
        "seq", F.lit("").alias("timestamp"), "path", F.create_map(F.lit("k"), F.col("path")).alias("config"), "metrics"
    ).write.json(path)
    return path


def _choose(spark, sf):
    """One more record, far better, is appended; it is the one chosen."""
    history = _history(spark, sf)
    best = tracking.choose_model(spark, history)
    tracking.save_experiment(spark, history, best + "_tuned", {"from": best}, {"domain_accuracy": 1e9})
    records, corrupt = readers.read_history(spark, history)
    counts = records.agg(F.count(F.lit(1)).alias("records"), F.lit(corrupt.count()).cast("bigint").alias("corrupt"))
    return counts.select(F.lit(best).alias("best"), F.lit(tracking.choose_model(spark, history)).alias("later"), "records", "corrupt")


def _stats(spark, sf):
    rows = V.attributes(spark, sf)
    counts = profile.phase_counts({"initial": rows, "deduplicated": keep_first(rows)})
    back = spark.read.schema(counts.schema).json(writers.write_json_stats(counts, _folder(spark, "stats")))
    return back


def _report_text(spark, sf):
    path = _folder(spark, "report")
    writers.distribution_text(profile.ordered_report(profile.distribution(V.attributes(spark, sf)))).write.text(path)
    return spark.read.text(path)


def _conditional(spark, sf):
    rows, path = V.attributes(spark, sf), _folder(spark, "some")
    parts = split.cap_split(rows, 15)
    wrote = writers.write_if_any(split.evaluation_part(parts), path)
    skipped = writers.write_if_any(rows.filter("row_id < 0"), f"{path}-none")
    back = readers.read_csv(spark, path) if wrote else rows.filter("row_id < 0")
    return back.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(wrote).alias("wrote"), F.lit(skipped).alias("skipped"))


def _dedup(spark, sf):
    path, _ = deduplicate_csv(spark, _attributes_file(spark, sf), _folder(spark, "cleaned"))
    return readers.read_csv(spark, path)


def _dedup_default(spark, sf):
    """Without a path, the cleaned file lies beside the input."""
    path = _attributes_file(spark, sf)
    deduplicate_csv(spark, path)
    return readers.read_csv(spark, f"{path}_cleaned")


def _timestamped(spark, sf):
    """Outputs of a run carry its time: found again by the name's form."""
    folder = _folder(spark, "outputs")
    writers.write_csv(_in_file_order(V.attributes(spark, sf)), writers.timestamped_path(folder))
    back = readers.read_csv(spark, f"{folder}/predictions_" + "[0-9]" * 8 + "_" + "[0-9]" * 6 + ".csv")
    return back.groupBy(*S.CLASS).agg(F.count(F.lit(1)).alias("n"))


def _sketched_stream(spark, sf):
    """A file at a time, a row of sketches for each, united afterwards."""
    out = _folder(spark, "sketches")
    sketch_incrementally(stream_csv(spark, _attributes_file(spark, sf), files_per_chunk=1), out, f"{out}-state").awaitTermination()
    return profiling.near_exact(spark, sf, profile.united_cardinalities(spark.read.parquet(out)))


def _dataset(spark, sf):
    """What the build writes: the labelled rows and the masked test rows."""
    folder = _folder(spark, "dataset")
    writers.write_csv(_in_file_order(V.taxonomy(spark, sf)), f"{folder}/t.csv")
    writers.write_csv(V.master(spark, sf), f"{folder}/m.csv")
    paths = build_dataset(spark, f"{folder}/t.csv", f"{folder}/m.csv", f"{folder}/out")
    parts = [readers.read_csv(spark, p).withColumn("part", F.lit(n)) for n, p in (("input", paths.labelled), ("test", paths.masked))]
    return parts[0].unionByName(parts[1])


def _training(spark, sf):
    """Train and record on part of the rows, score a file with the best recorded model."""
    folder, rows = _folder(spark, "training"), V.attributes(spark, sf)
    path, report = run_training(spark, rows, folder)
    scored = readers.read_csv(spark, predict_csv(spark, _attributes_file(spark, sf), f"{folder}/predictions", history=f"{folder}/history"))
    model, config = classify.load_model(spark, path)
    labels = rows.select(F.col(S.TOPIC).alias("predicted_topic")).distinct().withColumn("known", F.lit(True))
    accuracy = report.filter("kind = 'accuracy'").count()
    return scored.join(labels, "predicted_topic", "left").select(
        *S.LABELLED_COLUMNS, F.coalesce("known", F.lit(False)).alias("known"), F.lit(config["head"]).alias("head"),
        F.lit(accuracy).cast("bigint").alias("levels"), F.lit(len(model.stages) > 0).alias("loaded"),
    )


QUERIES = {
    "csv_round_trip": _round_trip,
    "csv_round_trip_documents": _round_trip_documents,
    "csv_encoding": _latin_file,
    "csv_streamed": _streamed,
    "definitions_file": _definitions,
    "templates_file": _templates,
    "choose_model": _choose,
    "stats_json": _stats,
    "report_text": _report_text,
    "conditional_write": _conditional,
    "dedup_file": _dedup,
    "dedup_file_default": _dedup_default,
    "timestamped_output": _timestamped,
    "cardinalities_streamed": _sketched_stream,
    "dataset_build": _dataset,
    "train_and_predict_file": _training,
}

_BEST = evaluation.ORACLES["best_experiment"]
_ALL = "attribute_name, description, domain, topic"
_MASK = f"('0x' || substr(md5(concat_ws('|', '42', 'mask', {_ALL})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE"

ORACLES = {
    "csv_round_trip": using("attributes") + f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {_ALL} FROM attributes",
    "csv_round_trip_documents": using("docs")
    + "SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, md5(description) AS digest, domain, topic FROM docs",
    "csv_encoding": using("attributes") + "SELECT attribute_name || ' é' AS attribute_name, description, domain, topic FROM attributes",
    "csv_streamed": using("attributes") + "SELECT domain, topic, count(*) AS n FROM attributes GROUP BY 1, 2",
    "definitions_file": profiling.ORACLES["read_definitions"],
    "templates_file": using("attributes")
    + "SELECT domain AS domain_name, topic AS topic_name, min(description) AS topic_definition FROM attributes GROUP BY 1, 2",
    "choose_model": f"""SELECT path AS best, path || '_tuned' AS later, (SELECT count(DISTINCT o_custkey) + 1 FROM orders) AS records,
         0::BIGINT AS corrupt FROM ({_BEST})""",
    "stats_json": profiling.ORACLES["phase_counts"],
    "report_text": f"""SELECT printf('%s: %d records (%.2f%%) | %s: %d records (%.2f%% of domain)', domain, domain_count, domain_pct,
         topic, topic_count, topic_pct) AS value FROM ({profiling.ORACLES["ordered_report"]})""",
    "conditional_write": using("split15")
    + "SELECT count(*) AS n, count(*) > 0 AS wrote, false AS skipped FROM split15 WHERE split = 'eval'",
    "dedup_file": using("kept") + f"SELECT {_ALL} FROM kept",
    "dedup_file_default": using("kept") + f"SELECT {_ALL} FROM kept",
    "timestamped_output": using("attributes") + "SELECT domain, topic, count(*) AS n FROM attributes GROUP BY 1, 2",
    "cardinalities_streamed": profiling.ORACLES["cardinalities_sketched"],
    "dataset_build": using("complete", masked=f"SELECT {_ALL}, {_MASK} AS u FROM complete")
    + f"""SELECT {_ALL}, 'input' AS part FROM complete UNION ALL
          SELECT attribute_name, description, CASE WHEN u < 0.3::DOUBLE OR (u >= 0.3::DOUBLE + 0.3::DOUBLE AND u < 0.3::DOUBLE + 0.3::DOUBLE + 0.4::DOUBLE) THEN NULL ELSE domain END,
                 CASE WHEN u >= 0.3::DOUBLE AND u < 0.3::DOUBLE + 0.3::DOUBLE + 0.4::DOUBLE THEN NULL ELSE topic END, 'test' FROM masked""",
    "train_and_predict_file": using("attributes")
    + f"SELECT {_ALL}, true AS known, 'logistic' AS head, 2::BIGINT AS levels, true AS loaded FROM attributes",
}
