import numpy as np
import pytest

from labelloom.operators import lsh, similarity

TOPICS = "row_id long, vector array<double>, topic string"


def rows_of(spark, vectors, ids=None):
    data = [(int(ids[k]) if ids is not None else k, [float(x) for x in v], f"t{k % 3}" if k % 7 else None) for k, v in enumerate(vectors)]
    return spark.createDataFrame(data, TOPICS).repartition(3)


def units(n, d, seed=0):
    v = np.random.default_rng(seed).standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold,inclusive", [(0.3, False), (0.01, False), (0.6, True)])
@pytest.mark.parametrize("one_side", [False, True])
def test_single_precision_loses_no_pair(monkeypatch, threshold, inclusive, one_side):
    monkeypatch.setattr(similarity, "CELL_SCORES", 700)
    monkeypatch.setattr(similarity, "PIECE", 50)
    v = units(90, 16)
    v[3], v[4], v[5] = 0, np.nan, [threshold, np.sqrt(1 - threshold**2), *[0] * 14]  # a pair at the threshold itself, with row 6
    v[6] = [1, *[0] * 15]
    left, right = (v, v) if one_side else (v, v[20:])
    with np.errstate(invalid="ignore"):
        sims = np.round(left @ right.T, similarity.DIGITS)
        want = {(int(i), int(j)) for i, j in np.argwhere(sims >= threshold if inclusive else sims > threshold) if not one_side or i < j}
    got = [(int(i), int(j), s) for found in similarity.pairs_above(left, right, threshold, inclusive=inclusive, one_side=one_side) for i, j, s in zip(*found)]
    assert len(got) == len(want) > 0 and {(i, j) for i, j, _ in got} == want
    assert got == sorted(got) and all(abs(s - sims[i, j]) < 2e-9 for i, j, s in got)


@pytest.mark.parametrize("recall", [None, 0.6])
def test_pairs_of_texts_are_not_joined(spark, monkeypatch, recall):
    """Topic and copies come with the pairs: no join may send every pair through a shuffle."""
    monkeypatch.setattr(lsh, "FEW_COPIES", 1)
    v = units(60, 8)
    df = rows_of(spark, np.concatenate([v, v[:9]]))
    found = similarity.similar_text_pairs(df, 0.3, recall=recall)
    assert found.columns == ["id2", "id1", "similarity", "topic1", "copies1", "topic2", "copies2"]
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line]
    assert not any("id1" in line or "id2" in line for line in joins)
    entries = {}
    for r in df.collect():
        key = (tuple(r["vector"]), r["topic"])
        n, least = entries.get(key, (0, r["row_id"]))
        entries[key] = n + 1, min(least, r["row_id"])
    known = {i: (topic, n) for (_, topic), (n, i) in entries.items()}
    for r in found.collect():
        assert r["id1"] < r["id2"] and (r["topic1"], r["copies1"], r["topic2"], r["copies2"]) == (*known[r["id1"]], *known[r["id2"]])
    want = sum(round(float(np.dot(a, b)), 9) > 0.3 for (a, s), (_, i) in entries.items() for (b, t), (_, j) in entries.items() if i < j and s != t)
    assert found.count() == want if recall is None else 0 < found.count() <= want


def test_repeated_ids_still_join_every_entry(spark):
    v = units(30, 6)
    df = rows_of(spark, v, [k % 20 for k in range(30)])
    found = similarity.similar_text_pairs(df, 0.2).collect()
    assert {(r["id1"], r["topic1"]) for r in found if r["id1"] == 2} == {(2, "t2"), (2, "t1")}
    assert found[0].asDict().keys() == {"id2", "id1", "similarity", "topic1", "copies1", "topic2", "copies2"}


@pytest.mark.parametrize("bits,probes", [(4, 4), (9, 2), (12, 16)])
def test_looks_are_the_buckets(bits, probes):
    vectors, rng = units(50, 10), np.random.default_rng(1)
    directions = rng.standard_normal((6, 10, bits))
    own, into = lsh.looks(vectors, directions, bits, probes)
    masks = lsh.flips(bits) @ (1 << np.arange(bits))
    opened = np.unpackbits(into, axis=2)[:, :, : len(masks)].astype(bool)
    for t, planes in enumerate(directions):
        at = lsh.buckets(vectors, planes, bits, probes)
        assert (own[t] == at[:, 0]).all()
        assert [set(own[t, k] ^ masks[opened[t, k]]) for k in range(50)] == [set(x) for x in at]
    i, j = (x.ravel() for x in np.indices((50, 50)))
    for other in (True, False):
        found = lsh.met((own, into), (own, into), i, j, np.full(len(i), other), bits)
        looked = [[set(x[0 if other else 1 :]) for x in lsh.buckets(vectors, planes, bits, probes)] for planes in directions]
        assert found.tolist() == [any(own[t, b] in looked[t][a] or own[t, a] in looked[t][b] for t in range(6)) for a, b in zip(i, j)]


def test_vectors_are_sent_to_few_blocks():
    tables, bits, probes = lsh.plan(0.3, 615_000, recall=0.98)
    assert lsh.cell_blocks(615_000, tables, probes, bits=bits, width=64) <= 16
    assert lsh.cell_blocks(10_000, 4, 1, bits=24, width=1 << 20) == 2500


def test_agreement_counts_missing_and_other_pairs():
    def stream(pairs, *cuts):
        for part in np.split(np.array(pairs, dtype=float).reshape(-1, 3), cuts):
            yield part[:, 0].astype(int), part[:, 1].astype(int), part[:, 2]

    exact = [(0, 1, 0.5), (0, 4, 0.5), (1, 2, 0.5), (3, 0, 0.5), (3, 9, 0.25)]
    for given, want in (
        (exact, [5, 5, 0]), ([], [5, 0, 0]), (exact[1:4], [5, 3, 0]), ([(0, 0, 0.5), *exact, (7, 7, 0.5)], [5, 5, 2]), ([(0, 1, 0.6), (1, 2, 0.5)], [5, 1, 1])
    ):
        for cuts in ((), (1,), (2, 2, 3)):
            assert lsh.agreement(stream(exact, 2), stream(given, *cuts), 10).tolist() == want
    assert lsh.agreement(stream([]), stream(exact), 10).tolist() == [0, 0, 5]


def test_recall_is_counted_where_blocks_meet(spark, monkeypatch):
    """The joins are compared in the tasks of the blocks, without a shuffle of pairs, and the counts are those of the two sets."""
    v = units(120, 6)
    df = rows_of(spark, np.concatenate([v, v[:10]]))
    exact, given = ({(r["id1"], r["id2"], round(r["similarity"], 6)) for r in similarity.similar_text_pairs(df, 0.5, recall=r, block=40).collect()} for r in (None, 0.6))
    shown = []
    for few in (1 << 30, 1):
        monkeypatch.setattr(lsh, "FEW_COPIES", few)
        counted = similarity.compare_text_pairs(df, 0.5, recall=0.6, block=40)
        assert ("pair#" in counted._jdf.queryExecution().toString()) == (few > 1)
        shown.append(tuple(counted.first()))
    assert shown[0] == shown[1] == (len(exact), len(exact & given), 0) and 0 < len(given) < len(exact)
