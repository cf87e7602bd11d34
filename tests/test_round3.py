import os

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel

from labelloom.operators import boosting, classify, similarity
from labelloom.plans.catalogue import flows, vectors
from labelloom.sources import readers

LABELLED = "row_id long, attribute_name string, description string, domain string, topic string"


def test_recall_query_writes_no_set_of_pairs(spark, sf, monkeypatch):
    def refuse(df):
        raise AssertionError("a set of pairs is written")

    monkeypatch.setattr(vectors, "materialise", refuse)
    row = vectors.QUERIES["similar_text_pairs_recall"](spark, sf).first()
    assert row["pairs"] == vectors.QUERIES["similar_text_pairs"](spark, sf).count() > 0 and row["recalled"] and row["none_else"]


@pytest.mark.parametrize("differ", [None, "topic"])
def test_larger_cells_give_every_pair(spark, differ, monkeypatch):
    v = np.random.default_rng(3).standard_normal((150, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    topic = [None if k % 7 == 0 else str(k % 3) for k in range(150)]
    df = spark.createDataFrame([(k, x.tolist(), topic[k]) for k, x in enumerate(v)], "row_id long, vector array<double>, topic string")
    calls, whole = [], similarity.similarity_pairs
    monkeypatch.setattr(similarity, "similarity_pairs", lambda *a, **k: calls.append(k) or whole(*a, **k))
    found = whole(df, 0.2, differ=differ, block=4).collect()
    assert [(k["pivots"], k["block"]) for k in calls] == [(12, 13)]
    want = {(i, j) for i in range(150) for j in range(i) if round(v[i] @ v[j], 9) > 0.2 and (not differ or topic[i] != topic[j])}
    assert len(found) == len(want) and {(r["id2"], r["id1"]) for r in found} == want


def test_written_files_stay_small(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(flows, "FILE_BYTES", 1000)
    df = spark.createDataFrame([(k, None if k == 5 else "a", "x\n" * 99 + "x", "d", "t") for k in range(60)], LABELLED)
    path = flows._attributes_file(spark, None, df)
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".csv")]
    assert len(files) >= 12  # 12,119 bytes of text
    rows = readers.read_labelled(spark, path).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(60)) and {r["description"] for r in rows} == {"x\n" * 99 + "x"}
    assert [r["attribute_name"] for r in rows].index(None) == 5


def test_logistic_head_takes_few_passes_over_correlated_features(spark):
    rng = np.random.default_rng(5)
    common, own = rng.standard_normal((400, 1)), rng.standard_normal((400, 8))
    x = np.hstack([common * 100 + own * 0.01, common])  # nearly one direction, and one that depends on the others not at all
    labels = np.where(own[:, 0] - own[:, 1] + rng.standard_normal(400) > 0, "a", "b")
    df = spark.createDataFrame([(k, v.tolist(), c, c) for k, (v, c) in enumerate(zip(x, labels.tolist()))], "row_id long, v array<double>, domain string, topic string")
    model = classify.train(df, vector="v")
    heads = [m for m in model.stages if isinstance(m, LogisticRegressionModel)]
    assert len(heads) == 2 and all(m.summary.totalIterations < 60 for m in heads)
    right = classify.predict(model, df, vector="v").filter("predicted_topic = topic").count()
    assert right > 280


@pytest.mark.parametrize("vectors_", [[[1.0, 2.0]] * 4, [[1.0]] * 4, [[0.0, 1.0], [0.0, 2.0], [0.0, 3.0], None]])
def test_features_without_spread_still_train(spark, vectors_):
    df = spark.createDataFrame([(k, v, "d", "ab"[k % 2]) for k, v in enumerate(vectors_) if v], "row_id long, v array<double>, domain string, topic string")
    assert classify.predict(classify.train(df, vector="v"), df, vector="v").filter("predicted_topic IN ('a', 'b')").count() == df.count()

def test_boosting_uses_the_cores_before_its_tasks_are_full():
    assert [boosting.task_count(n, 12) for n in (1, 8192, 8193, 80_000, 500_000, 10**7)] == [1, 1, 2, 10, 12, 153]


def test_boosting_in_many_tasks_grows_the_trees_of_one(spark, monkeypatch):
    x = np.random.default_rng(2).integers(0, 9, (600, 5)).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), "up" if v[0] > v[1] else "down", "ab"[int(v[2] > 4)]) for k, v in enumerate(x)], "row_id long, v array<double>, domain string, topic string")
    trees = []
    for least in (boosting.LEAST_ROWS, 100):
        monkeypatch.setattr(boosting, "LEAST_ROWS", least)
        model = classify.train(df, "trees", vector="v", trees=2, depth=3)
        trees.append([m.trees for m in model.stages if isinstance(m, boosting.BoostedTreesModel)])
    for one, many in zip(*trees):
        assert np.array_equal(one.feature, many.feature) and np.array_equal(one.bin, many.bin) and np.allclose(one.value, many.value)
