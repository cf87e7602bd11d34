"""Readers, writers and end-to-end flows through files."""

import os

import pytest
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.operators import classify, split, tracking
from labelloom.plans import views as V
from labelloom.plans.balancing import balance_file
from labelloom.plans.dataset_build import build_dataset
from labelloom.plans.dedup_run import deduplicate_csv
from labelloom.plans.template_route import predict_templates_csv
from labelloom.plans.training import evaluate_csv, predict_csv, predict_texts, run_training
from labelloom.session import ensure_checkpoint_dir
from labelloom.sources import readers, writers
from labelloom.streaming.incremental import run_incrementally, sketch_incrementally, stream_csv

CSV = '''attribute_name,description,domain,topic
net_revenue,"Income, after ""returns""",finance,revenue
page_views,"Views
per page",web,usage
empty,,web,usage
missing,NA,web,usage
net_revenue,Second text,finance,revenue
net_revenue,Third text,finance,cost
'''


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_rules(spark, folder):
    df = readers.read_labelled(spark, _write(folder, "in.csv", CSV))
    rows = df.orderBy(S.ROW_ID).collect()
    assert [r[S.NAME] for r in rows] == ["net_revenue", "page_views", "empty", "missing", "net_revenue", "net_revenue"]
    assert rows[0][S.DESCRIPTION] == 'Income, after "returns"'
    assert rows[1][S.DESCRIPTION] == "Views\nper page"
    assert rows[2][S.DESCRIPTION] is None and rows[3][S.DESCRIPTION] is None
    raw = readers.read_csv(spark, os.path.join(folder, "in.csv"), na_values=None).collect()
    assert "NA" in {r[S.DESCRIPTION] for r in raw}
    with pytest.raises(ValueError, match="definition"):
        readers.read_csv(spark, os.path.join(folder, "in.csv"), required=["definition"])


def test_csv_round_trip(spark, folder):
    df = readers.read_labelled(spark, _write(folder, "in.csv", CSV))
    out = writers.write_csv(df, f"{folder}/out.csv")
    again = readers.read_labelled(spark, out)
    assert sorted(map(str, again.drop(S.ROW_ID).collect())) == sorted(map(str, df.drop(S.ROW_ID).collect()))


def test_conditional_write_and_names(spark, folder):
    df = spark.range(2)
    assert not writers.write_if_any(df.filter("id > 5"), f"{folder}/none.csv") and not os.path.exists(f"{folder}/none.csv")
    assert writers.write_if_any(df, f"{folder}/some.csv")
    assert writers.cleaned_path("/x/y.csv") == "/x/y_cleaned.csv"
    assert writers.timestamped_path("/x").startswith("/x/predictions_")


def test_definition_file(spark, folder):
    path = _write(folder, "defs.txt", "# head\nd|c|old\n\nd|c|new\nbroken\n")
    good, bad = readers.read_definitions(spark, path)
    assert [tuple(r) for r in good.collect()] == [("d", "c", "new")]
    assert bad.count() == 1


def test_dedup_flow(spark, folder):
    out, tables = deduplicate_csv(spark, _write(folder, "in.csv", CSV))
    assert out.endswith("in_cleaned.csv")
    assert readers.read_labelled(spark, out).count() == 5
    assert tables["duplicates"].first()["rows_removed"] == 1


def test_dataset_flow(spark, folder):
    taxonomy = _write(folder, "t.csv", "attribute_name,domain,topic\na,d,c\nb,d,e\nz,d,e\na,d2,c2\n")
    master = _write(folder, "m.csv", "attribute_name,description\na,text a\nb,\nq,unused\na,other a\n")
    paths = build_dataset(spark, taxonomy, master, f"{folder}/data")
    assert paths.dropped == 1
    assert readers.read_labelled(spark, paths.labelled).count() == 4
    masked = readers.read_labelled(spark, paths.masked)
    assert masked.count() == 4 and masked.filter("domain IS NOT NULL AND topic IS NOT NULL").count() == 0
    assert "records" in spark.read.text(paths.report).first()[0]


def test_history(spark, folder):
    history = f"{folder}/history"
    tracking.save_experiment(spark, history, "m1", {"k": 1}, {"acc": 0.5})
    tracking.save_experiment(spark, history, "m2", {"k": 2}, {"acc": 0.7})
    tracking.save_experiment(spark, history, "m3", {"k": 3}, {"other": 0.9})
    _write(history, "broken.json", "{not json\n")
    records, bad = readers.read_history(spark, history)
    assert records.count() == 3 and bad.count() == 1
    assert tracking.choose_model(spark, history, "acc") == "m2"
    assert tracking.choose_model(spark, history, "acc", "given") == "given"


def _attributes(spark, sf):
    return V.attributes(spark, sf)


def test_balance_flow(spark, sf, folder):
    writers.write_csv(_attributes(spark, sf), f"{folder}/in.csv")
    _write(folder, "defs.txt", "Brand#1|SMALL|small things\n")

    def generator(prompt):
        tag = str(abs(hash(prompt)) % 10**8)
        return "\n".join(f'{{"attribute_name": "new_{tag}_{i}", "description": "d {i}"}}' for i in range(5))

    tables = balance_file(spark, f"{folder}/in.csv", f"{folder}/out", generator, definitions_path=f"{folder}/defs.txt", cap=4)
    train = readers.read_labelled(spark, f"{folder}/out/balanced_training_data.csv")
    assert {r["count"] for r in train.groupBy("domain", "topic").count().collect()} == {4}
    assert tables["generation"].agg(F.sum("shortfall")).first()[0] == 0
    assert tables["report"].filter("section = 'totals' AND metric = 'original'").first()["value"] == _attributes(spark, sf).count()


def test_train_predict_evaluate_flow(spark, sf, folder):
    rows = _attributes(spark, sf)
    path, report = run_training(spark, rows, f"{folder}/models", max_iter=30, n_features=256)
    averages = {(r["level"], r["kind"]): r["f1"] for r in report.collect()}
    assert averages[("topic", "accuracy")] > 0.9  # the topic is a word of the text
    writers.write_csv(rows.drop("domain", "topic"), f"{folder}/in.csv")
    out = predict_csv(spark, f"{folder}/in.csv", folder, history=f"{folder}/models/history")
    scored = readers.read_csv(spark, out)
    assert {"predicted_domain", "predicted_topic"} <= set(scored.columns) and scored.count() == rows.count()
    specs = spark.createDataFrame([("x: SMALL red widget size 3",)], "value string")
    assert predict_texts(spark, path, specs).first()["predicted_topic"] == "SMALL"
    writers.write_csv(rows, f"{folder}/full.csv")
    assert evaluate_csv(spark, f"{folder}/full.csv", path).count() > 0
    with pytest.raises(FileNotFoundError):
        classify.load_model(spark, f"{folder}/nothing")


@pytest.mark.parametrize("head,options", [("logistic", {"max_iter": 50}), ("trees", {"trees": 3, "depth": 3})])
def test_heads_beat_the_majority_rate(spark, folder, head, options):
    rows = spark.range(240).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("d"), F.col("id") % 2).alias("domain"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("topic"),
        F.array(*[F.when(F.col("id") % 6 == k, 1.0).otherwise(F.sin(F.col("id") + k) * 0.2) for k in range(6)]).alias("vector"),
    )
    parts = split.train_test_split(rows)
    model = classify.train(parts.filter("split = 'train'"), head, vector="vector", **options)
    report = classify.evaluate(model, parts.filter("split = 'test'"), vector="vector")
    accuracy = {r["level"]: r["f1"] for r in report.filter("kind = 'accuracy'").collect()}
    assert accuracy["domain"] > 0.8 and accuracy["topic"] > 0.8


def test_template_flow_and_streaming(spark, sf, folder):
    rows = _attributes(spark, sf)
    templates = V.templates(spark, sf)
    writers.write_csv(rows, f"{folder}/in.csv")
    out = predict_templates_csv(spark, f"{folder}/in.csv", f"{folder}/out.csv", "description", templates)
    scored = readers.read_csv(spark, out)
    assert {"predicted_domain", "predicted_topic", "confidence"} <= set(scored.columns)
    assert scored.count() == rows.count()
    right = scored.filter("predicted_topic = topic").count()
    assert right > rows.count() / 2


def test_streaming_equals_batch(spark, sf, folder):
    from labelloom.operators.prepare import mask_labels, with_definition
    from labelloom.operators.similarity import nearest_template

    rows = _attributes(spark, sf).drop("row_id").repartition(4)
    rows.write.option("header", True).csv(f"{folder}/chunks")
    definitions = V.definitions(spark, sf)

    def step(df):
        return with_definition(mask_labels(df, id_col="attribute_name"), definitions)

    stream = stream_csv(spark, f"{folder}/chunks", files_per_chunk=1)
    run_incrementally(stream, step, f"{folder}/scored", f"{folder}/ckpt").awaitTermination()
    want = sorted(map(str, step(readers.read_csv(spark, f"{folder}/chunks")).collect()))
    assert sorted(map(str, spark.read.parquet(f"{folder}/scored").collect())) == want
    # a second run finds nothing new
    run_incrementally(stream_csv(spark, f"{folder}/chunks"), step, f"{folder}/scored", f"{folder}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{folder}/scored").count() == len(want)

    vectors = V.vectors(spark, sf).select("row_id", "vector")
    vectors.repartition(3).write.parquet(f"{folder}/vectors")
    templates = V.centroids(spark, sf).withColumnRenamed("topic", "template_id")
    source = spark.readStream.schema(vectors.schema).parquet(f"{folder}/vectors")
    run_incrementally(source, lambda d: nearest_template(d, templates), f"{folder}/near", f"{folder}/ckpt2").awaitTermination()
    batch = nearest_template(vectors, templates)
    assert sorted(map(str, spark.read.parquet(f"{folder}/near").collect())) == sorted(map(str, batch.collect()))


def test_checkpoint_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = ensure_checkpoint_dir(spark)
    assert folder and (named is None or named.rstrip("/") in folder)


def test_sketches_of_chunks_unite_to_the_sketch_of_the_whole(spark, tmp_path):
    from labelloom.operators import profile

    rows = spark.range(30_000).select(
        F.col("id").alias("row_id"), F.concat(F.lit("d"), F.col("id") % 7).alias("domain"), F.concat(F.lit("t"), F.col("id") % 9000).alias("topic")
    )
    rows = rows.union(spark.createDataFrame([(-1, None, None), (-2, "d1", None), (-3, "d1|t", "x"), (-4, "d1", "t|x")], rows.schema))
    whole = profile.united_cardinalities(profile.cardinality_sketches(rows)).first()
    chunks = profile.cardinality_sketches(rows.withColumn("chunk", F.col("row_id") % 10), ["chunk"])
    assert chunks.count() > 10
    united = profile.united_cardinalities(chunks).first()
    exact = profile.cardinalities(rows).first()
    error = 4 * 1.04 / 2 ** (profile.SKETCH_BITS / 2)
    for c in profile.SKETCHED:
        assert abs(united[c] - whole[c]) <= 0.01 * whole[c]  # the order of union moves the estimate a little, not the registers
        assert abs(united[c] - exact[c]) <= error * exact[c]
    assert united["total"] == exact["total"] == 30_004 and united["domains"] == exact["domains"]
    none = profile.united_cardinalities(profile.cardinality_sketches(rows.limit(0)))
    assert tuple(none.first()) == (0, 0, 0, 0)
    # a stream of files: one row of sketches per file, and files that come later only add their own
    files = str(tmp_path / "in")
    cells = rows.select(F.lit("n").alias("attribute_name"), F.lit("t").alias("description"), "domain", "topic")
    for part in range(2):
        cells.filter(F.col("domain").isNotNull()).filter(F.abs(F.hash("topic")) % 2 == part).coalesce(1).write.mode("append").option("header", True).csv(files)
        sketch_incrementally(stream_csv(spark, files, files_per_chunk=1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        kept = spark.read.parquet(str(tmp_path / "out"))
        assert kept.count() == part + 1
    assert profile.united_cardinalities(kept).first()["total"] == 30_003
