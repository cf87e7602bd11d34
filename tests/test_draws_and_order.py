"""Draws reach every pair, row ids follow files, ranks split evenly, both template paths agree."""

import os

import pytest
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions import ranking
from labelloom.operators import classify, pairs, prepare
from labelloom.operators.similarity import nearest_template
from labelloom.sources import readers


def _labelled(spark, rows):
    return spark.createDataFrame(rows, "row_id long, attribute_name string, description string, domain string, topic string")


def test_every_pair_is_drawn_by_some_seed(spark):
    df = _labelled(spark, [(k, f"n{k}", "t", f"d{k % 2}", f"c{k % 3}") for k in range(9)])
    space = pairs.pair_space(df)
    label = {k: (k % 2, k % 3) for k in range(9)}
    seen = {"negative": set(), "positive": set()}
    for seed in range(24):
        drawn = {"negative": pairs.negative_pairs(space, 6, seed=seed), "positive": pairs.drawn_positive_pairs(space, 2, seed=seed)}
        for kind, frame in drawn.items():
            got = {frozenset((r["id1"], r["id2"])) for r in frame.select("id1", "id2").collect()}
            assert len(got) == (6 if kind == "negative" else 2)
            seen[kind] |= got
    every = {frozenset((a, b)) for a in range(9) for b in range(a)}
    same = {p for p in every if len({label[x] for x in p}) == 1}
    assert seen["positive"] == same and seen["negative"] == every - same


def test_row_ids_follow_files_whatever_the_splits(spark, tmp_path):
    sizes = {"a.csv": 1, "b.csv": 2001, "c.csv": 30}
    want = []
    for name, n in sizes.items():
        with open(os.path.join(tmp_path, name), "w") as f:
            f.write("attribute_name,description,domain,topic\n" + "".join(f"{name}-{k},text {k},d,c\n" for k in range(n)))
        want += [f"{name}-{k}" for k in range(n)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("128m", "4k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            rows = readers.read_labelled(spark, str(tmp_path), multi_line=False).orderBy(S.ROW_ID).collect()
            assert [r[S.NAME] for r in rows] == want and [r[S.ROW_ID] for r in rows] == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("shape", ["outlier", "reader"])
def test_buckets_follow_the_rows(spark, shape):
    ids = spark.range(40_000).withColumnRenamed("id", "row_id")
    if shape == "outlier":
        ids = ids.union(spark.createDataFrame([(1 << 50,)], "row_id long"))
    else:
        ids = ids.select(((F.col("row_id") % 3) * (1 << 33) + F.col("row_id")).alias("row_id"))
    sizes = ids.groupBy(ranking._quantile_bucket(ids, "row_id", 64).alias("b")).count().toPandas()["count"]
    assert len(sizes) >= 60 and sizes.max() <= 2 * sizes.mean()


def test_template_paths_agree_on_nulls_zeros_and_ties(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "row_id long, vector array<double>")
    templates = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0])], "template_id long, vector array<double>")
    found = [sorted(map(tuple, nearest_template(rows, templates, 3, max_floats=n).collect())) for n in (10**6, 0)]
    assert found[0] == found[1] and {r[0] for r in found[0]} == {1, 3, 4}


def test_last_template_and_definition_of_a_class_win(spark):
    df = _labelled(spark, [(1, "n", "t", "d", "c"), (2, "n", "t", "d", "c")])
    templates = spark.createDataFrame([(1, "d", "c", "old"), (2, "d", "c", "new")], "row_id long, domain_name string, topic_name string, topic_definition string")
    found, missing = prepare.with_template(df, templates)
    assert [r["template"].endswith("new") for r in found.collect()] == [True, True] and missing.count() == 0
    definitions = spark.createDataFrame([(1, "d", "c", "new"), (0, "d", "c", "zold")], "line_no long, domain string, topic string, definition string")
    assert [r["definition"] for r in prepare.with_definition(df, definitions).collect()] == ["new", "new"]


def test_missing_model_parts_are_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="pipeline"):
        classify.load_model(spark, str(tmp_path / "none"))


def test_heads_have_the_labels_of_training_only(spark):
    rows = spark.createDataFrame([(k, [float(k % 2), 1.0], "d", f"c{k % 2}") for k in range(20)], "row_id long, vector array<double>, domain string, topic string")
    model = classify.train(rows, vector="vector", levels=(S.TOPIC,), max_iter=5)
    unseen = rows.withColumn("topic", F.lit("never"))
    assert {r["predicted_topic"] for r in classify.predict(model, unseen, vector="vector").collect()} <= {"c0", "c1"}


def test_as_of_join_over_a_hot_key(spark):
    """A key of most rows over many ranges, ties, nulls, and no earlier row, against a plain search."""
    import bisect
    import random

    from labelloom.functions.joins import as_of_join

    rng = random.Random(3)
    left = [(i, rng.choice(["hot"] * 8 + ["b", "none", None]), rng.randrange(500)) for i in range(3000)]
    right = [(rng.choice(["hot", "b", None]), rng.randrange(20, 500), i) for i in range(300)]
    got = as_of_join(spark.createDataFrame(left, "id long, k string, x long"), spark.createDataFrame(right, "k string, x long, v long"), "k", "x", "v")
    places = {k: sorted((x, v) for kk, x, v in right if kk == k) for k in ("hot", "b", "none")}
    for r in got.collect():
        own = places.get(r["k"], [])
        at = bisect.bisect_right(own, (r["x"], 10**9)) - 1
        assert r["v"] == (own[at][1] if at >= 0 else None)
    assert got.count() == len(left)


def test_cross_domain_draws_of_a_topic_in_very_many_domains(spark):
    """One topic in 100,000 domains: no list per topic, exact number, never the own topic or domain."""
    from labelloom.operators import pairs

    rows = spark.range(101_000).select(
        F.col("id").alias("row_id"), F.lit("n").alias("attribute_name"), F.lit("t").alias("description"),
        F.concat(F.lit("d"), F.col("id") % 100_000).alias("domain"), F.when(F.col("id") < 100_000, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("topic"),
    )
    got = pairs.negative_pairs(rows, 5000, strategy="other")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    counts = got.agg(F.count("*"), F.countDistinct("id1", "id2"), F.count_if(F.col("topic1") == F.col("topic2")), F.count_if(F.col("domain1") == F.col("domain2"))).first()
    assert tuple(counts) == (5000, 5000, 0, 0)
