"""Kept vector index, pruned nearest-neighbour search and the hashed similarity join, against brute force."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.operators import lsh, similarity, vectorindex

VECTORS = "row_id long, k string, vector array<double>"


def clustered(rng, groups, size, dims=16, spread=0.05):
    middles = rng.normal(size=(groups, dims)) * 3
    return np.concatenate([m + spread * rng.normal(size=(size, dims)) for m in middles])


def frame(spark, vectors, keys=None, first=0):
    rows = [(first + i, keys[i] if keys else "a", [float(x) for x in v] if v is not None else None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTORS)


def brute(queries, base, k, metric, allowed=None):
    """[(query, base, rank)] with ties to the smaller base."""
    out = []
    for i, q in enumerate(queries):
        scores = [round(float(q @ b), 9) if metric == "dot" else -round(float(((q - b) ** 2).sum()), 9) for b in base]
        order = [j for j in sorted(range(len(base)), key=lambda j: (-scores[j], j)) if allowed is None or allowed(i, j)]
        out += [(i, j, r + 1) for r, j in enumerate(order[:k])]
    return sorted(out)


def rows_of(found):
    return sorted((r["query_id"], r["base_id"], r["rank"]) for r in found.collect())


@pytest.mark.parametrize("metric", ["dot", "l2"])
@pytest.mark.parametrize("cells,block", [(1, 2048), (12, 2048), (12, 7)])
def test_exact_search_equals_brute_force(spark, metric, cells, block):
    rng = np.random.default_rng(cells + block)
    base = np.round(np.concatenate([clustered(rng, 6, 25), rng.normal(size=(30, 16)), np.zeros((2, 16)), np.ones((3, 16))]), 3)
    queries = np.round(np.concatenate([base[::9], rng.normal(size=(5, 16)), np.zeros((1, 16)), -base[:3]]), 3)
    q = frame(spark, queries).withColumnRenamed("row_id", "query_id")
    index = vectorindex.build_index(frame(spark, base), cells=cells, block=block)
    assert rows_of(vectorindex.search(index, q, 4, metric=metric, block=block)) == brute(queries, base, 4, metric)
    assert index.cells.count.sum() == len(base)


def test_few_cells_are_met_and_read(spark):
    """On clustered vectors each query meets a few of the cells, and the scan names only their folders."""
    rng = np.random.default_rng(5)
    base = clustered(rng, 30, 40)
    index = vectorindex.build_index(frame(spark, base), cells=30)
    queries = frame(spark, base[::40]).withColumnRenamed("row_id", "query_id")
    options = {"query_id": "query_id", "vector": "vector", "probes": None, "exclude_self": False, "block": 2048}
    rounds = vectorindex.search_rounds(index, queries, 5, metric="l2", **options)
    assert rows_of(rounds["result"]) == brute(base[::40], base, 5, "l2")
    met = rounds["first"].count() + rounds["second"].count()
    assert met <= 3 * queries.count() < queries.count() * len(index.cells.centres) / 5
    scan = index.read_cells([1, 4])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "cell#" in scan.split("PartitionFilters")[1]
    read = {f.split("cell=")[1].split("/")[0] for f in index.read_cells([1, 4]).inputFiles()}
    assert read <= {str(c) for c in range(30)} and index.read_cells([1, 4]).select("cell").distinct().count() == 2


def test_index_is_kept_and_grows(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = np.round(clustered(rng, 8, 30), 3)
    keys = [["x", "y", None][i % 3] for i in range(len(base))]
    rows = frame(spark, base, keys)
    index = vectorindex.build_index(rows.filter("row_id < 100"), str(tmp_path / "index"), keys=["k"], cells=8)
    vectorindex.append(index, rows.filter("row_id >= 100"))
    again = vectorindex.load_index(spark, index.path)
    assert again.cells.count.sum() == len(base) and np.array_equal(again.cells.centres, index.cells.centres)
    got = vectorindex.knn_join_indexed(rows, 4, again)
    want = brute(base, base, 4, "l2", lambda i, j: i != j and keys[i] == keys[j] and keys[i] is not None)
    assert sorted((r["row_id"], r["neighbour_id"], r["rank"]) for r in got.collect()) == want
    same = similarity.knn_join(rows, 4, keys=["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.collect()))


def test_probed_search_finds_most_neighbours(spark):
    rng = np.random.default_rng(7)
    base = clustered(rng, 10, 60, spread=0.6)
    index = vectorindex.build_index(frame(spark, base), cells=20)
    rows = frame(spark, base)
    exact = {(r["row_id"], r["neighbour_id"]) for r in vectorindex.knn_join_indexed(rows, 5, index).collect()}
    probed = {(r["row_id"], r["neighbour_id"]) for r in vectorindex.knn_join_indexed(rows, 5, index, probes=4).collect()}
    assert len(exact & probed) >= 0.9 * len(exact) and len(exact) == 5 * len(base)


def test_index_of_nothing_and_of_null_vectors(spark):
    none = frame(spark, [None, None])
    some = frame(spark, [np.ones(4), None, np.zeros(4)])
    empty = vectorindex.build_index(none)
    assert vectorindex.search(empty, some, 3, query_id="row_id").count() == 0
    index = vectorindex.build_index(some, cells=4)
    assert vectorindex.search(index, none, 3, query_id="row_id").count() == 0
    assert rows_of(vectorindex.search(index, some, 3, query_id="row_id", metric="dot")) == [(0, 0, 1), (0, 2, 2), (2, 0, 1), (2, 2, 2)]


def test_keyless_searches_go_through_cells(spark):
    """Nearest original of all, and templates beyond the broadcast size: same rows, no block product of all queries."""
    rng = np.random.default_rng(9)
    base, made = np.round(clustered(rng, 12, 20), 3), np.round(clustered(np.random.default_rng(9), 12, 5), 3)
    originals, points = frame(spark, base), frame(spark, made).withColumnRenamed("row_id", "synthetic_id")
    for cells in (None, 12):
        got = similarity.nearest_original(points, originals, cells=cells)
        assert sorted((r["synthetic_id"], r["row_id"], 1) for r in got.collect()) == brute(made, base, 1, "dot")
    templates = frame(spark, base).withColumnRenamed("row_id", "template_id").select("template_id", "vector")
    small, large = (similarity.nearest_template(frame(spark, made), templates, 3, max_floats=n, cells=12) for n in (10**7, 0))
    assert sorted(map(tuple, small.select("row_id", "template_id", "rank").collect())) == sorted(map(tuple, large.select("row_id", "template_id", "rank").collect()))


# --- hashed join -------------------------------------------------------------------------------


def pairs_above(vectors, threshold):
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    sims = np.round(unit @ unit.T, 9)
    return {(int(i), int(j)) for i, j in np.argwhere(sims > threshold) if i < j}


@pytest.mark.parametrize("threshold,bits,block", [(0.8, 10, 2048), (0.9, None, 2048), (0.8, 6, 9)])
def test_hashed_join_recall_and_no_false_pair(spark, threshold, bits, block):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(120, 24))
    near = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0.3, 0.5, 0.7)])
    vectors = np.concatenate([base, near, np.zeros((2, 24))])
    want = pairs_above(vectors, threshold)
    got = [(r["id1"], r["id2"]) for r in lsh.lsh_pairs(frame(spark, vectors), threshold, bits=bits, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 100
    assert len(set(got) & want) >= 0.95 * len(want)


def test_hashed_text_pairs_collapse_copies_and_skip_one_topic(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 8))
    rows = [(3 * i + c, [float(x) for x in v], f"t{c % 2}") for i, v in enumerate(base) for c in range(3)] + [(900, None, "t0")]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>, topic string")
    exact, found = (similarity.similar_text_pairs(df, 0.8, recall=r).select("id1", "id2", "topic1", "topic2", "copies1", "copies2") for r in (None, 0.999))
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, found.collect())) and exact.count() >= 40


@pytest.mark.parametrize("rows", [1 << 25, 20_000])
def test_pairs_of_blocks_are_those_of_the_buckets(spark, monkeypatch, rows):
    """A low threshold sends a vector to hundreds of buckets, or to a few blocks: the same pairs, also where ids and vectors repeat."""
    rng = np.random.default_rng(15)
    vectors = rng.normal(size=(150, 6))
    data = [(k if k % 10 else 7, [float(x) for x in v], f"t{k % 3}" if k % 7 else None) for k, v in enumerate([*vectors, *vectors[:20]])]
    df = spark.createDataFrame(data, "row_id long, vector array<double>, topic string").repartition(4)
    plan = lsh.plan(0.3, 20_000)
    assert plan[0] * (2 + plan[2]) > 2 * lsh.FEW_COPIES and lsh.cell_blocks(120_000, *plan[::2]) < 64
    monkeypatch.setattr(lsh, "CELL_LOOKS", rows)
    shown = {}
    for form, few in (("buckets", 1 << 30), ("blocks", 1)):
        monkeypatch.setattr(lsh, "FEW_COPIES", few)
        for differ in (None, "topic"):
            found = lsh.lsh_pairs(df, 0.5, recall=0.6, bits=5, probes=2, block=40, differ=differ)
            assert ("FlatMapCoGroups" in found._jdf.queryExecution().toString()) == (form == "buckets")
            shown[form, differ] = sorted((r["id1"], r["id2"], round(r["similarity"], 9)) for r in found.collect())
    for differ in (None, "topic"):
        assert shown["buckets", differ] == shown["blocks", differ] and len(shown["blocks", differ]) > 500


def test_hot_bucket_is_cut_into_blocks(spark):
    """A third of all vectors in one bucket: blocks bound every task."""
    rng = np.random.default_rng(13)
    hot = np.ones((60, 8)) + 0.01 * rng.normal(size=(60, 8))
    vectors = np.concatenate([hot, rng.normal(size=(120, 8))])
    want = pairs_above(vectors, 0.95)
    got = {(r["id1"], r["id2"]) for r in lsh.lsh_pairs(frame(spark, vectors), 0.95, bits=5, block=10).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_hash_plan():
    for threshold, bits in ((0.8, 12), (0.5, 6), (0.95, 20)):
        tables, b, probes = lsh.plan(threshold, 10**6, bits=bits)
        chance = lsh.meeting_chance(threshold, b, probes)
        assert b == bits and 1 - (1 - chance) ** tables >= lsh.RECALL
    assert lsh.plan(0.8, 10**9)[1] > lsh.plan(0.8, 10**4)[1]
    with pytest.raises(ValueError):
        lsh.plan(0.05, 10**9, bits=24)
    with pytest.raises(ValueError):
        lsh.plan(0.8, 10, recall=1.0)


def test_buckets_differ_in_the_least_sure_bits():
    rng = np.random.default_rng(14)
    vectors, planes = rng.normal(size=(50, 6)), rng.normal(size=(6, 7))
    at = lsh.buckets(vectors, planes, 7, 3)
    products = vectors @ planes
    for i in range(50):
        bit = 1 << int(np.abs(products[i]).argmin())
        assert at[i, 0] == sum(1 << b for b in range(7) if products[i, b] > 0) and at[i, 1] == at[i, 0] ^ bit and len(set(at[i])) == 4


def test_no_rows(spark):
    assert lsh.lsh_pairs(frame(spark, [None]), 0.8).count() == 0
    assert lsh.lsh_pairs(frame(spark, [np.ones(3)]).filter(F.lit(False)), 0.8).count() == 0


def test_visits_of_a_batch_leave_in_pieces(spark, monkeypatch):
    """A vector may visit every cell: what a task returns at once must not grow with the number of cells."""
    rng = np.random.default_rng(16)
    df = frame(spark, rng.normal(size=(60, 4)))
    made = []
    kept = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema, *a, **k: (made.append(run), kept(self, run, schema, *a, **k))[1])
    similarity.similarity_pairs(df, 0.1, pivots=30)
    to_cells = next(f for f in made if f.__name__ == "to_cells")
    rows = pd.DataFrame({"__id": np.arange(2000), "__v": list(rng.normal(size=(2000, 4))), "__c": None})
    pieces = list(to_cells(iter([rows])))
    assert max(map(len, pieces)) <= similarity.SENT < sum(map(len, pieces)) and pieces[0]["__home"].all()
    assert sum(p["__home"].sum() for p in pieces) == 2000
    cells = vectorindex.CellBounds(rng.normal(size=(20, 4)), np.ones(20, np.int64), np.ones(20), np.ones(20), np.ones(20))
    made.clear()
    index = SimpleNamespace(cells=cells)
    vectorindex._visits(index, df.selectExpr("row_id AS __id", "vector AS __v"), "l2", 12, False)
    pieces = list(made[0](iter([rows.drop(columns="__c")])))
    assert max(map(len, pieces)) <= similarity.SENT and sum(map(len, pieces)) == 12 * 2000
