"""Multi-class boosted trees against a plain version, and as a pipeline stage."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.operators import boosting, classify


def points(spark, n, classes, dims=6, seed=1, noise=0.4):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, classes, n)
    x = np.round(rng.normal(size=(n, dims)) * noise + np.eye(classes, dims)[labels] * 2, 2)
    x[:, -1] = np.where(rng.random(n) < 0.8, 0.0, x[:, -1])
    df = spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, labels))], "row_id long, v array<double>, label int")
    return x, labels, df.withColumn("features", array_to_vector("v"))


def plain_boosting(x, y, classes, edges, trees, depth, rate, reg=1.0, least=1.0):
    """Scores after ``trees`` rounds, every split found by trying all of them."""
    bins = boosting.binned(x, edges).astype(int)
    scores = np.zeros((len(y), classes))
    for _ in range(trees):
        g, h = boosting.gradients(scores, y)
        step = np.zeros_like(scores)
        for k in range(classes):
            def grow(rows, level, k=k):
                G, H = g[rows, k].sum(), h[rows, k].sum()
                step[rows, k] = -rate * G / (H + reg)
                if level == depth:
                    return
                best = (0.0, None)
                for f in range(x.shape[1]):
                    for b in range(edges.shape[1]):
                        left = rows[bins[rows, f] <= b]
                        gl, hl = g[left, k].sum(), h[left, k].sum()
                        if hl < least or H - hl < least:
                            continue
                        gain = round(gl**2 / (hl + reg) + (G - gl) ** 2 / (H - hl + reg) - G**2 / (H + reg), boosting.DIGITS)
                        if gain > best[0]:
                            best = (gain, (f, b))
                if best[1]:
                    f, b = best[1]
                    grow(rows[bins[rows, f] <= b], level + 1)
                    grow(rows[bins[rows, f] > b], level + 1)
            grow(np.arange(len(y)), 0)
        scores = scores + step
    return scores


@pytest.mark.parametrize("classes,bins", [(3, 8), (2, 32)])
def test_trees_equal_a_plain_version(spark, monkeypatch, classes, bins):
    monkeypatch.setattr(boosting, "TASK_ROWS", 80 if classes == 3 else 1 << 16)  # several tasks, or one
    x, y, df = points(spark, 200, classes)
    trees, edges = boosting.fit_trees(df.repartition(3), classes, trees=7, depth=3, bins=bins)
    assert edges.shape == (6, bins - 1)
    want = plain_boosting(x, y, classes, edges, 7, 3, 0.1)
    assert np.allclose(trees.scores(boosting.binned(x, edges), classes), want, atol=1e-7)
    model = boosting.BoostedTreesModel(trees, edges, classes, featuresCol="features", predictionCol="p", rawPredictionCol="r", probabilityCol="q")
    got = model.transform(df).orderBy("row_id").toPandas()
    assert np.allclose(np.stack(got["r"]), want, atol=1e-7)
    assert np.allclose(np.stack(got["q"]), boosting.softmax(want), atol=1e-7) and (got["p"] == want.argmax(1)).all()


def test_sparse_and_dense_rows_give_one_forest(spark):
    x, y, df = points(spark, 150, 3)
    x[np.abs(x) < 0.5] = 0
    forms = [
        [(i, Vectors.dense(row), int(c)) for i, (row, c) in enumerate(zip(x, y))],
        [(i, Vectors.sparse(6, [(j, v) for j, v in enumerate(row) if v]), int(c)) for i, (row, c) in enumerate(zip(x, y))],
    ]
    fits = [boosting.fit_trees(spark.createDataFrame(rows, ["row_id", "features", "label"]), 3, trees=3, depth=4) for rows in forms]
    for name in ("feature", "bin", "value"):
        assert np.allclose(getattr(fits[0][0], name), getattr(fits[1][0], name))


def test_boosting_learns_separable_classes(spark):
    _, _, df = points(spark, 600, 4, noise=0.5, seed=3)
    rows = df.select("row_id", F.col("v").alias("vector"), F.col("label").cast("string").alias("topic"))
    train, test = rows.filter("row_id < 450"), rows.filter("row_id >= 450")
    model = classify.train(train, "trees", vector="vector", levels=("topic",), trees=15, depth=4)
    got = classify.predict(model, test, vector="vector").toPandas()
    assert (got["topic"] == got["predicted_topic"]).mean() > 0.9


def test_saved_and_loaded(spark, tmp_path):
    _, _, df = points(spark, 120, 3)
    rows = df.select("row_id", F.col("v").alias("vector"), F.col("label").cast("string").alias("topic"))
    model = classify.train(rows, "trees", vector="vector", levels=("topic",), trees=3, depth=2)
    path = classify.save_model(model, str(tmp_path / "m"))
    again, _ = classify.load_model(spark, path)
    first, second = (classify.predict(m, rows, vector="vector").orderBy("row_id").toPandas() for m in (model, again))
    assert first.equals(second)


def test_one_class_and_constant_features(spark):
    df = spark.createDataFrame([(i, Vectors.dense([1.0, float("nan")]), 0) for i in range(10)], ["row_id", "features", "label"])
    trees, edges = boosting.fit_trees(df, 1, trees=4, depth=2)
    assert len(trees.feature) == 0
    empty = df.filter("row_id < 0")
    trees, edges = boosting.fit_trees(empty, 2)
    model = boosting.BoostedTreesModel(trees, edges, 2, featuresCol="features", predictionCol="p", rawPredictionCol="r", probabilityCol="q")
    assert model.transform(df).select("p").distinct().collect()[0][0] == 0.0


def test_heads_know_only_labels_that_occur(spark):
    _, _, df = points(spark, 60, 3)
    rows = df.select("row_id", F.col("v").alias("vector"), F.col("label").cast("string").alias("topic"))
    for head, options in (("logistic", {"max_iter": 5}), ("forest", {"trees": 2, "depth": 2}), ("trees", {"trees": 1, "depth": 1})):
        model = classify.train(rows, head, vector="vector", levels=("topic",), **options)
        unseen = rows.withColumn("topic", F.lit("never"))
        scored = model.transform(classify.prepare_features(unseen, "vector"))
        assert scored.select("predicted_topic").distinct().count() <= 3
        first = scored.select("__topic_prob").first()[0]
        assert len(first) == 3
