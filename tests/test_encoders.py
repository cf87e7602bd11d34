"""Learned word vectors and user encoders as part of training."""

import os

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.operators import classify, encoders
from labelloom.plans.catalogue.models import letter_model

#: Words of two topics that share no word with each other; texts of a topic hardly share words.
GROUPS = {"sea": [f"sea{k}" for k in range(40)], "rock": [f"rock{k}" for k in range(40)]}


def texts(spark, n, seed, width=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        topic = "sea" if i % 2 else "rock"
        words = [*rng.choice(GROUPS[topic], width), "the", "of", "the"]
        rows.append((i, "a", " ".join(rng.permutation(words)), "d", topic))
    return spark.createDataFrame(rows, "row_id long, attribute_name string, description string, domain string, topic string")


def counting_encoder():
    """A stand-in for a large model: its loads are counted in a folder that a file names."""

    def load():
        folder = open(SparkFiles.get("where.txt")).read()
        with open(os.path.join(folder, f"{os.getpid()}-{os.urandom(4).hex()}"), "w"):
            pass
        return lambda batch: [[float(t.count("s")), float(t.count("r")), float(len(t) % 7)] for t in batch]

    return load


@pytest.fixture
def where(spark, tmp_path):
    loads = tmp_path / "loads"
    loads.mkdir()
    (tmp_path / "where.txt").write_text(str(loads))
    return str(tmp_path / "where.txt"), loads


def test_word_vectors_are_a_weighted_mean(spark):
    rows = classify.prepare_features(texts(spark, 200, 1).repartition(2))
    model = encoders.fit_word_vectors(rows, dims=8)
    learned = model.stages[1]
    assert set(learned.words) == {w for g in GROUPS.values() for w in g} | {"the", "of"}
    weight = dict(zip(learned.words, learned.weights))
    assert weight["the"] < weight["of"] < weight["sea1"] <= 1
    place = {w: k for k, w in enumerate(learned.words)}
    for r in model.transform(rows).limit(20).collect():
        at = [place[w] for w in r["__words"]]
        want = learned.weights[at] @ learned.vectors[at] / learned.weights[at].sum()
        assert np.allclose(r["__mean"].toArray(), want) and np.linalg.norm(r["features"].toArray()) == pytest.approx(1)


def test_word_vectors_know_texts_without_a_common_word(spark):
    """Trained on some words' texts with labels, tested on texts of other words of the same topics."""
    model = classify.train(texts(spark, 400, 2), encoder="vectors", levels=(S.TOPIC,))
    got = classify.predict(model, texts(spark, 100, 3)).toPandas()
    assert (got["topic"] == got["predicted_topic"]).mean() > 0.9


def test_word_vectors_saved_and_without_words(spark, tmp_path):
    rows = texts(spark, 60, 4)
    odd = rows.limit(3).withColumn("description", F.when(F.col("row_id") == 0, None).when(F.col("row_id") == 1, "").otherwise("unseen words"))
    model = classify.train(rows, encoder="vectors", levels=(S.TOPIC,), max_iter=20)
    again, _ = classify.load_model(spark, classify.save_model(model, str(tmp_path / "m")))
    for df in (rows, odd):
        first, second = (classify.predict(m, df).orderBy("row_id").toPandas() for m in (model, again))
        assert first.equals(second) and len(first) == df.count()
    with pytest.raises(ValueError):
        classify.train(rows, encoder="none")


def test_user_encoder_loads_once_per_worker(spark, where):
    path, loads = where
    rows = texts(spark, 300, 5).repartition(24)
    model = classify.train(rows, encoder=counting_encoder(), files=[path], levels=(S.TOPIC,), max_iter=50)
    got = classify.predict(model, rows).toPandas()
    assert (got["topic"] == got["predicted_topic"]).mean() > 0.95
    pids = [f.split("-")[0] for f in os.listdir(loads)]
    assert 0 < len(pids) == len(set(pids)) <= 8  # 24 tasks in several jobs, at most one load in each of the workers
    encode = lambda batch: [[float(t.count("s")), float(t.count("r")), float(len(t) % 7)] for t in batch]
    encoded = classify.fit_encoder(rows, counting_encoder()).transform(classify.prepare_features(rows)).select("__text", "features").collect()
    want = encode([r["__text"] for r in encoded])
    assert [list(r["features"].toArray()) for r in encoded] == want


def test_user_encoder_is_saved_by_name(spark, where, tmp_path):
    path, _ = where
    rows = texts(spark, 40, 6)
    stage = encoders.user_encoder(lambda: (lambda batch: [[1.0] for _ in batch]))
    with pytest.raises(ValueError):
        stage.write()
    named = encoders.UserEncoder(letter_model, inputCol="__text", outputCol="features")
    named.write().overwrite().save(str(tmp_path / "e"))
    again = encoders.UserEncoder.load(str(tmp_path / "e"))
    prepared = classify.prepare_features(rows)
    first, second = (m.transform(prepared).select("row_id", "features").orderBy("row_id").collect() for m in (named, again))
    assert first == second
    short = encoders.user_encoder(lambda: (lambda batch: [[1.0]]))
    with pytest.raises(Exception, match="every text"):
        short.transform(prepared).collect()

