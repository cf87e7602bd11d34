"""Properties against brute force, on a frame in which one class holds a third of all rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import labelled
from labelloom import schema as S
from labelloom.functions import ranking
from labelloom.operators import balance, pairs, similarity, split
from labelloom.session import materialise

N = 240


def _row(i):
    if i % 3 == 0:
        return (i, "hot name", "hot text", "hot", "hot")
    return (i, f"name {i % 17}", f"text {i % 29}", f"d{i % 4}", f"c{i % 5}")


@pytest.fixture(scope="module")
def skewed(spark):
    return labelled(spark, [_row(i) for i in range(N)]).repartition(7).cache()


@pytest.fixture(scope="module")
def local():
    return [_row(i) for i in range(N)]


def _classes(local):
    groups = {}
    for r in local:
        groups.setdefault((r[3], r[4]), []).append(r[0])
    return groups


def test_order_rank_is_the_row_number(skewed, local):
    got = {r["row_id"]: (r["rank"], r["n"]) for r in ranking.order_rank(skewed, S.CLASS, "row_id", size_out="n").collect()}
    for ids in _classes(local).values():
        for place, row_id in enumerate(sorted(ids)):
            assert got[row_id] == (place, len(ids))
    whole = {r["row_id"]: r["rank"] for r in ranking.order_rank(skewed, [], "row_id").collect()}
    assert whole == {i: i for i in range(N)}


def test_hash_rank_is_a_permutation_per_group(skewed, local):
    got = ranking.hash_rank(skewed, S.CLASS, seed=1, salt="x", id_col="row_id").collect()
    by_class = {}
    for r in got:
        by_class.setdefault((r["domain"], r["topic"]), []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by_class.values())


@pytest.mark.parametrize("cap", [1, 10, 79, 80, 500])
def test_cap_split_is_a_partition(skewed, local, cap):
    out = split.cap_split(skewed, cap).collect()
    assert sorted(r["row_id"] for r in out) == list(range(N))
    for (d, c), ids in _classes(local).items():
        train = [r for r in out if (r["domain"], r["topic"]) == (d, c) and r["split"] == "train"]
        assert len(train) == min(cap, len(ids))


def test_splits_do_not_depend_on_partitioning(spark, skewed):
    again = skewed.repartition(3, "description")
    for op in (
        lambda d: split.cap_split(d, 10),
        lambda d: split.train_test_split(d, 0.3),
        lambda d: pairs.negative_pairs(d, 50).withColumnRenamed("id1", "row_id"),
    ):
        assert sorted(map(str, op(skewed).collect())) == sorted(map(str, op(again).collect()))


@pytest.mark.parametrize("n", [0, 1, 37, N, N + 5])
def test_sample_n_is_exact(skewed, n):
    assert ranking.sample_n(skewed, n, id_col="row_id", seed=3).count() == min(n, N)


def test_bucket_count_does_not_change_results(spark, skewed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(str, split.cap_split(skewed, 10).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert sorted(map(str, split.cap_split(skewed, 10).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_positive_pairs_are_all_unordered_pairs(skewed, local):
    got = sorted((r["id1"], r["id2"]) for r in pairs.positive_pairs(skewed).collect())
    want = sorted(p for ids in _classes(local).values() for p in itertools.combinations(sorted(ids), 2))
    assert got == want
    assert int(pairs.positive_total(skewed).first()["pairs"]) == len(want)
    assert pairs.positive_pair_runs(skewed).agg(F.sum("pairs")).first()[0] == len(want)


NEGATIVE = {
    "all": lambda a, b: (a[3], a[4]) != (b[3], b[4]),
    "same": lambda a, b: a[3] == b[3] and a[4] != b[4],
    "other": lambda a, b: a[3] != b[3] and a[4] != b[4],
}


@pytest.mark.parametrize("strategy", sorted(NEGATIVE))
@pytest.mark.parametrize("n", [1, 100, 10**9])
def test_negative_draws_are_distinct_valid_and_complete(skewed, local, strategy, n):
    rows = {r[0]: r for r in local}
    valid = {frozenset((a[0], b[0])) for a, b in itertools.combinations(local, 2) if NEGATIVE[strategy](a, b)}
    got = [frozenset((r["id1"], r["id2"])) for r in pairs.negative_pairs(skewed, n, strategy=strategy).collect()]
    assert len(got) == len(set(got)) == min(n, len(valid))
    assert set(got) <= valid
    assert all(len(p) == 2 for p in got) and rows


def test_negative_draws_are_spread_over_anchors(skewed, local):
    got = pairs.negative_pairs(skewed, 4000).collect()
    touched = {r["id1"] for r in got} | {r["id2"] for r in got}
    assert len(touched) == N


def test_hard_negatives_have_the_quota_per_topic_pair(skewed, local):
    sizes = {k: len(v) for k, v in _classes(local).items()}
    got = {}
    for r in pairs.hard_negative_pairs(skewed).collect():
        got[(r["domain"], r["topic1"], r["topic2"])] = got.get((r["domain"], r["topic1"], r["topic2"]), 0) + 1
    want = {}
    for d in {k[0] for k in sizes}:
        for a, b in itertools.combinations(sorted(c for x, c in sizes if x == d), 2):
            quota = int(min(sizes[(d, a)], sizes[(d, b)]) * 0.5)
            if quota:
                want[(d, a, b)] = quota
    assert got == want
    assert pairs.hard_negative_total(skewed).first()[0] == sum(want.values())


def test_hard_negatives_of_many_topics_meet_in_bounded_groups(spark):
    """One domain of 10,000 topics: no group of many rows, the exact number, and equal pairs whatever the blocks."""
    rows = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.lit("n").alias("attribute_name"), F.lit("t").alias("description"), F.lit("d").alias("domain"),
        (F.col("id") % 10_000).cast("string").alias("topic"),
    )
    groups = pairs.hard_negative_tasks(rows).groupBy("domain", "rank", "a", "b", "first").count().agg(F.max("count"), F.count("*")).first()
    assert groups[0] < 1.5 * pairs.HARD_BLOCK and groups[1] > 300
    assert pairs.hard_negative_total(rows).first()[0] == 10_000 * 9_999 // 2
    few = rows.filter("row_id % 10000 < 40")
    whole, cut = (sorted(map(tuple, pairs.hard_negative_pairs(few, block=b).collect())) for b in (512, 6))
    assert whole == cut and len(whole) == 40 * 39 // 2


def test_mix_keeps_its_quotas(spark):
    a = spark.createDataFrame([(i, i + 100) for i in range(10)], "id1 long, id2 long")
    b = spark.createDataFrame([(i, i + 200) for i in range(30)], "id1 long, id2 long")
    for total, topic, text in ((7, 3, 4), (40, 10, 30), (100, 10, 30), (0, 0, 0)):
        got = {r["kind"]: r["count"] for r in pairs.mix_similar_negatives(a, b, total).groupBy("kind").count().collect()}
        assert (got.get("topic", 0), got.get("text", 0)) == (topic, text)


@pytest.mark.parametrize("n", [0, 1, 37, 5_000, 19_999, 30_000])
def test_first_candidates_hold_the_sample(spark, n):
    """Of 20,000 rows in 4 tasks, small batches: the sample is that of all rows, and the rows left follow n."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "100")
    try:
        rows = spark.range(0, 20_000, 1, 4).select(F.col("id").cast("string").alias("k"), F.col("id").alias("__x"))
        left = materialise(ranking.first_candidates(rows, n, id_col="k", seed=3, salt="t"))
        want = {r["k"] for r in ranking.sample_n(rows, n, id_col="k", seed=3, salt="t").collect()}
        assert {r["k"] for r in ranking.sample_n(left, n, id_col="k", seed=3, salt="t").collect()} == want
        assert len(want) == min(n, 20_000) <= left.count()
        if n < 100:
            assert left.count() < 4 * (100 + n * 8)
        assert left.columns == rows.columns
    finally:
        spark.conf.set(size, old)


def test_first_candidates_without_rows_or_limit(spark):
    none = spark.createDataFrame([], "k string")
    assert ranking.first_candidates(none, 5, id_col="k", seed=1).count() == 0
    some = spark.range(10).select(F.col("id").cast("string").alias("k"))
    assert ranking.sample_n(ranking.first_candidates(some, F.lit(None), id_col="k", seed=1), 0, id_col="k", seed=1).count() == 0


def test_replication_matches_the_cyclic_rule(skewed, local):
    top = max(len(v) for v in _classes(local).values())
    texts = {r[0]: r[2] for r in local}
    got = {(r["domain"], r["topic"], r["i"]): r for r in balance.replicate(skewed).collect()}
    want = {}
    for (d, c), ids in _classes(local).items():
        ids = sorted(ids)
        for i in range(top - len(ids)):
            want[(d, c, i)] = f"Replicated ({i + 1}): {texts[ids[i % len(ids)]]}"
    assert {k: r["description"] for k, r in got.items()} == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_the_plain_join(spark, skewed, how):
    from labelloom.functions.joins import join_hot

    names = [("hot name", "m1"), ("hot name", "m2"), (None, "m3"), ("unused", "m4")] + [(f"name {i}", f"x{i}") for i in range(9)]
    right = spark.createDataFrame(names, "attribute_name string, master string")
    left = skewed.withColumn("attribute_name", F.when(F.col("row_id") % 7 != 0, F.col("attribute_name")))
    got = join_hot(left, right, "attribute_name", how)
    want = left.join(right, "attribute_name", how)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    salted = got._jdf.queryExecution().analyzed().toString()
    assert "__salt" in salted


def _vectors(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    points = base[rng.integers(0, 6, n)] + 0.35 * rng.normal(size=(n, dims))
    points[:copies] = points[0]
    return points


@pytest.mark.parametrize("threshold,pivots,block", [(0.8, 1, 500), (0.8, 9, 500), (0.8, 9, 11), (0.9, 25, 7), (0.3, 12, 20)])
def test_similarity_join_equals_brute_force(spark, threshold, pivots, block):
    points = _vectors(150, 8, 5, copies=50)
    df = spark.createDataFrame([(i, p.tolist(), str(i % 3)) for i, p in enumerate(points)], "row_id long, vector array<double>, topic string")
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    sims = np.round(units @ units.T, 9)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if sims[i, j] > threshold}
    got = [(r["id1"], r["id2"]) for r in similarity.similarity_pairs(df, threshold, pivots=pivots, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_copies_pair_once_with_their_number(spark):
    rows = [(i, [1.0, 0.0], "a" if i < 40 else "b") for i in range(60)] + [(60, [1.0, 0.1], "a"), (61, [0.0, 1.0], "a")]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>, topic string")
    got = {(r["id1"], r["id2"]): (r["copies1"], r["copies2"]) for r in similarity.similar_text_pairs(df, 0.8).collect()}
    assert got == {(0, 40): (40, 20), (40, 60): (20, 1)}


@pytest.mark.parametrize("block", [1000, 13])
def test_top_k_equals_brute_force(spark, block):
    points = _vectors(90, 6, 9, copies=10)
    keys = ["hot" if i % 3 else "cold" for i in range(90)]
    df = spark.createDataFrame([(i, k, p.tolist()) for i, (k, p) in enumerate(zip(keys, points))], "row_id long, k string, vector array<double>")
    got = {}
    for r in similarity.knn_join(df, 4, keys=["k"], block=block).collect():
        got.setdefault(r["row_id"], {})[r["rank"]] = r["neighbour_id"]
    sq = (points**2).sum(1)
    dist = np.round(2 * points @ points.T - sq[:, None] - sq[None, :], 9)
    for i in range(90):
        order = sorted((j for j in range(90) if j != i and keys[j] == keys[i]), key=lambda j: (-dist[i, j], j))[:4]
        assert [got[i][r] for r in (1, 2, 3, 4)] == order


def test_info_nce_of_one_tuple(spark):
    slots = spark.createDataFrame(
        [(0, "anchor", 0, 1, "d", "c"), (0, "positive", 0, 2, "d", "c"), (0, "negative", 0, 3, "d", "c"), (0, "negative", 1, 4, "d", "c")],
        "tuple_id long, role string, slot long, id long, domain string, topic string",
    )
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "row_id long, vector array<double>"
    )
    z = np.array([0.8, 0.0, -1.0]) / 0.5
    want = -z[0] + math.log(np.exp(z).sum())
    assert abs(pairs.info_nce(slots, vectors, temperature=0.5).first()["loss"] - want) < 1e-6


def test_pair_score_is_spearman(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    points = rng.normal(size=(30, 4))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    chosen = [(i, j, float((i + j) % 2)) for i, j in itertools.combinations(range(30), 2)]
    df = spark.createDataFrame(chosen, "id1 long, id2 long, label double")
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "row_id long, vector array<double>")
    sims = pd.Series([round(float(points[i] @ points[j]), 9) for i, j, _ in chosen])
    want = sims.rank().corr(pd.Series([l for *_, l in chosen]).rank())
    got = pairs.pair_score(df, vectors).first()
    assert got["pairs"] == len(chosen) and abs(got["spearman"] - want) < 1e-6
