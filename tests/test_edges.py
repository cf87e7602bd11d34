"""Edge cases of the operators on small hand-made frames."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import labelled
from labelloom import schema as S
from labelloom.functions import text as X
from labelloom.operators import balance, dedup, enrich, evaluate, generate, pairs, prepare, profile, similarity, smote, split, tracking
from labelloom.sources.readers import parse_definitions, require_columns


@pytest.fixture(scope="module")
def nulls(spark):
    return labelled(
        spark,
        [
            (1, "a", "x", "d1", "c1"),
            (2, "a", "x", "d1", "c1"),
            (3, "a", "y", "d1", None),
            (4, None, "y", "d2", "c1"),
            (5, None, "y", "d2", "c2"),
            (6, "b", None, "d2", "c2"),
            (7, "b", "z", None, "c2"),
            (8, "c", "z", "d2", "c2"),
        ],
    )


def test_duplicate_stats_count_null_members_as_their_own_class(nulls):
    row = dedup.duplicate_stats(nulls).first()
    assert (row["total"], row["rows_in_dup_groups"], row["rows_removed"]) == (8, 2, 1)
    # name a: (d1, c1) and (d1, null); name b: (d2, c2) and (null, c2); null names never count
    assert row["partial_duplicate_rows"] == 3 + 2


def test_keep_first_takes_the_lowest_row_and_keeps_null_keys(nulls):
    assert {r["row_id"] for r in dedup.keep_first(nulls).collect()} == {1, 3, 4, 5, 6, 7, 8}


def test_class_operators_ignore_unknown_classes(nulls):
    counts = {(r["domain"], r["topic"]): r["n"] for r in profile.class_counts(nulls).collect()}
    assert counts == {("d1", "c1"): 2, ("d2", "c1"): 1, ("d2", "c2"): 3}
    card = profile.cardinalities(nulls).first()
    assert (card["total"], card["domains"], card["topics"], card["classes"]) == (8, 2, 2, 3)


def test_distribution_counts_null_topics_for_their_domain(nulls):
    rows = {(r["domain"], r["topic"]): r for r in profile.distribution(nulls).collect()}
    assert rows[("d1", "c1")]["domain_count"] == 3
    assert rows[("d1", "c1")]["domain_pct"] == round(300 / 8, 6)
    assert rows[("d1", "c1")]["topic_pct"] == round(200 / 3, 6)


def test_drop_incomplete(nulls):
    assert {r["row_id"] for r in prepare.drop_incomplete(nulls).collect()} == {1, 2, 8}
    assert prepare.incomplete_counts(nulls).first()["dropped"] == 5


def test_missing_column_is_named(nulls):
    with pytest.raises(ValueError, match="topic"):
        require_columns(nulls.drop("topic"), S.LABELLED_COLUMNS)


def test_text_spec(spark):
    df = spark.createDataFrame([("a: b",), ("plain",), ("x:y: z ",), (" : \tq",)], "value string")
    got = [(r[S.NAME], r[S.DESCRIPTION]) for r in prepare.parse_text_spec(df, "value").collect()]
    assert got == [("a", "b"), ("unknown", "plain"), ("x", "y: z"), ("", "q")]


def test_after_prefix(spark):
    p = S.REWRITE_PREFIX
    df = spark.createDataFrame([(f"{p} one {p} two",), ("none",), (f"so {p}\n three ",), (p,)], "t string")
    assert [r[0] for r in df.select(X.after_prefix(F.col("t"))).collect()] == ["one", "none", "three", ""]


def test_labels_with_separators(spark):
    df = spark.createDataFrame([("a_b_c",), ("plain",)], "label string")
    d, c = X.split_label("label")
    assert [tuple(r) for r in df.select(d, c).collect()] == [("a", "b_c"), ("plain", None)]


def test_definitions_rules(spark):
    lines = ["# note", "", " d | c | first ", "d|c|second", "no separator", "a|b|c|d", "e||x"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    good, bad = parse_definitions(df)
    assert {tuple(r) for r in good.collect()} == {("d", "c", "second"), ("e", "", "x")}
    assert {r["value"] for r in bad.collect()} == {"no separator", "a|b|c|d"}


@pytest.mark.parametrize("n,expected_train", [(1, 1), (4, 4), (5, 5), (6, 5)])
def test_cap_is_strict(spark, n, expected_train):
    df = labelled(spark, [(i, f"n{i}", "t", "d", "c") for i in range(n)])
    out = split.cap_split(df, 5)
    assert split.training_part(out).count() == expected_train
    assert split.evaluation_part(out).count() == n - expected_train


def test_empty_input_keeps_schema(spark):
    empty = labelled(spark, [])
    out = balance.balance(empty, cap=5)
    assert out.columns == [*S.LABELLED_COLUMNS, "split", "origin"]
    assert out.count() == 0
    assert profile.balance_summary(out).first()["training"] == 0
    assert pairs.positive_pairs(empty).count() == 0
    assert pairs.negative_pairs(empty).count() == 0
    assert split.train_test_split(empty).count() == 0


def test_one_row_label_goes_to_both_sides(spark):
    df = labelled(spark, [(1, "a", "t", "d", "one")] + [(i, f"n{i}", "t", "d", "many") for i in range(2, 23)])
    got = split.split_per_label(df).groupBy("topic", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {
        ("one", "train"): 1, ("one", "val"): 1, ("many", "val"): math.ceil(2.1), ("many", "train"): 18,
    }


@pytest.mark.parametrize("n,k", [(1, 1), (2, 2), (3, 2), (4, 3), (10, 3), (11, 6)])
def test_context_steps(spark, n, k):
    df = labelled(spark, [(i, f"n{i}", f"t{i}", "d", "c") for i in range(n)])
    plan = generate.plan_batches(df, cap=n + 7)
    assert {r["k"] for r in plan.collect()} == {k}
    assert plan.count() == 2
    context = generate.context_sample(df, plan).groupBy("batch_id").agg(F.countDistinct("row_id").alias("n")).collect()
    assert all(r["n"] == k for r in context)


RESPONSE_LINES = [
    ('{"attribute_name": "good_one", "description": "x"}', True, True),
    ('{"attribute_name": "Bad Name", "description": "x"}', True, False),
    ('{"attribute_name": "no_text"}', False, False),
    ('{"attribute_name": null, "description": "x"}', True, False),
    ('{"attribute_name": "extra", "description": "x", "more": [1]}', True, True),
    ('[{"attribute_name": "listed", "description": "x"}]', False, False),
    ('{"attribute_name": "tail", "description": "x"} thanks', False, False),
    ("{'attribute_name': 'quotes', 'description': 'x'}", False, False),
    ("not json", False, False),
    ("", False, False),
    ('{"attribute_name": "a_1", "description": ""}', True, True),
]


@pytest.mark.parametrize("line,both,snake", RESPONSE_LINES)
def test_response_lines(spark, line, both, snake):
    df = spark.createDataFrame([("d", "c", 1, f"  {line}  \n\n")], S.RESPONSE_SCHEMA)
    assert generate.parse_responses(df, "all_or_nothing", 1).count() == int(both)
    assert generate.parse_responses(df, "per_line").count() == int(snake)


def test_batch_is_all_or_nothing(spark):
    good = '{"attribute_name": "a%d", "description": "x"}'
    df = spark.createDataFrame(
        [("d", "c", 1, "\n".join(good % i for i in range(3))), ("d", "c", 2, "\n".join(good % i for i in range(2))), ("d", "c", 3, None)],
        S.RESPONSE_SCHEMA,
    )
    assert {r["batch_id"] for r in generate.parse_responses(df, "all_or_nothing", 3).collect()} == {1}


def test_generated_rows_never_repeat_originals_or_each_other(spark):
    df = labelled(spark, [(1, "a1", "x", "d", "c"), (2, "a2", "x", "d", "c")])
    lines = "\n".join(f'{{"attribute_name": "a{i}", "description": "x"}}' for i in (1, 3, 3, 4, 5))
    responses = spark.createDataFrame([("d", "c", 1, lines)], S.RESPONSE_SCHEMA)
    accepted = generate.accept_generated(df, responses, cap=4).collect()
    assert sorted(r[S.NAME] for r in accepted) == ["a3", "a4"]
    stats = generate.generation_stats(df, responses, cap=4).first()
    assert (stats["needed"], stats["generated"], stats["duplicates_avoided"], stats["shortfall"]) == (2, 2, 2, 0)
    assert (stats["ok_batches"], stats["failed_batches"], stats["success_pct"]) == (1, 0, 100.0)


def test_dynamic_balance_reaches_the_target_in_every_class(spark):
    rows, i = [], 0
    for topic, n in (("many", 5), ("some", 3), ("one", 1), ("single", 1)):
        for _ in range(n):
            rows.append((i, f"n{i}", f"text {i}", "d_x", topic))
            i += 1
    df = labelled(spark, rows)
    out = balance.dynamic_balance(df)
    assert {r["count"] for r in out.groupBy("topic").count().collect()} == {5}
    replicated = out.filter("origin = 'replicated'").orderBy(S.NAME).collect()
    assert [r[S.DESCRIPTION] for r in replicated] == ["Replicated (1): text 5", "Replicated (2): text 6"]
    assert replicated[0][S.NAME] == "synthetic_d_x_some_0"
    vectors = df.select("row_id", F.array(*[F.sin(F.col("row_id") * k + 1.0) for k in range(4)]).alias("vector"))
    smoted = balance.dynamic_balance(df, vectors=vectors)
    assert {r["count"] for r in smoted.groupBy("topic").count().collect()} == {5}
    texts = smoted.filter("origin = 'smote'").collect()
    assert sorted(r[S.DESCRIPTION][:28] for r in texts) == ["SMOTE Generated (1): Based o", "SMOTE Generated (2): Based o"]


def test_explode_copies_crosses_chunk_bounds(spark):
    df = spark.range(2).withColumn("n", F.lit(balance.CHUNK) + F.col("id"))
    out = balance.explode_copies(df, F.col("n"), ["id"], "i").groupBy("id").agg(
        F.count("*").alias("c"), F.countDistinct("i").alias("d"), F.max("i").alias("m")
    )
    assert sorted(tuple(r) for r in out.collect()) == [
        (0, balance.CHUNK, balance.CHUNK, balance.CHUNK - 1), (1, balance.CHUNK + 1, balance.CHUNK + 1, balance.CHUNK),
    ]


def test_report_with_one_sided_labels(spark):
    df = spark.createDataFrame(
        [("a", "x", "a", "x"), ("a", "x", "b", "x"), ("c", "y", "b", "x")],
        "domain string, topic string, predicted_domain string, predicted_topic string",
    )
    report = {(r["level"], r["kind"], r["label"]): r for r in evaluate.classification_report(df).collect()}
    assert report[("domain", "label", "b")]["support"] == 0
    assert report[("domain", "label", "b")]["recall"] == 0.0
    assert report[("domain", "label", "c")]["precision"] == 0.0
    assert report[("domain", "label", "a")]["f1"] == round(2 / 3, 6)
    assert report[("domain", "macro avg", None)]["f1"] == round(2 / 9, 6)
    assert report[("topic", "accuracy", None)]["f1"] == round(2 / 3, 6)
    assert {r["level"]: r["accuracy"] for r in evaluate.accuracy(df).collect()}["domain"] == round(1 / 3, 6)


def test_best_experiment_ties_and_missing(spark):
    df = spark.createDataFrame(
        [(1, "m1", {"other": 1.0}), (2, "m2", {"acc": 0.5}), (3, "m3", {"acc": 0.9}), (4, "m4", {"acc": 0.9})],
        "seq long, path string, metrics map<string,double>",
    )
    assert tracking.best_experiment(df, "acc").first()["path"] == "m3"
    assert tracking.best_experiment(df.filter("seq = 1"), "acc").first()["path"] == "m1"


def test_map_batches_keeps_rows_and_checks_answers(spark):
    df = spark.range(10).withColumn("t", F.col("id").cast("string"))
    out = enrich.map_batches(df, lambda ts: [t + "!" for t in ts], "t", 3)
    assert {(r["id"], r["mapped"]) for r in out.collect()} == {(i, f"{i}!") for i in range(10)}
    with pytest.raises(Exception, match="answer every text"):
        enrich.map_batches(df, lambda ts: ts[:-1], "t", 3).collect()


def test_enrich_falls_back_and_aligns(spark):
    def rewrite(prompt):
        if "Description: bad" in prompt:
            raise RuntimeError("no")
        return "Standardized Description: " + prompt.split("Description: ")[1].split("\n")[0].upper()

    df = labelled(spark, [(1, "a", "good", "d", "c"), (2, "b", "bad", "d", "c"), (3, None, "good", "d", "c"), (4, "a", "good", "d", "e")])
    out = {r["row_id"]: r for r in enrich.enrich_text(df, rewrite, retries=2).collect()}
    assert len(out) == 4
    assert out[1][S.PROCESSED] == out[3][S.PROCESSED] == out[4][S.PROCESSED] == "GOOD"
    assert (out[2][S.PROCESSED], out[2]["rewrite_status"], out[2]["attempts"]) == ("bad", "failed", 2)
    assert enrich.enrich_text(df, rewrite, enabled=False) is df


def test_similarity_edges(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [0.0, 0.0], "b"), (5, [0.0, 1.0], "a"), (6, [1.0, 0.01], "b")]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>, topic string")
    got = {(r["id1"], r["id2"]) for r in similarity.similarity_pairs(df, 0.8).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (1, 6), (2, 6), (3, 6)}
    differ = {(r["id1"], r["id2"]) for r in similarity.similarity_pairs(df, 0.8, differ="topic").collect()}
    assert differ == {(1, 3), (2, 3), (1, 6), (2, 6)}
    with pytest.raises(ValueError):
        similarity.similarity_pairs(df, 0.0)


def test_template_ties_take_the_first_label(spark):
    t = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "template_id string, vector array<double>")
    rows = spark.createDataFrame([(1, [3.0, 0.0])], "row_id long, vector array<double>")
    for limit in (similarity.BROADCAST_FLOATS, 0):
        got = similarity.nearest_template(rows, t, 2, max_floats=limit).orderBy("rank").collect()
        assert [(r["template_id"], r["confidence"]) for r in got] == [("a", 1.0), ("b", 1.0)]


def test_smote_points_lie_between_their_ends(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "d", "big" if i < 12 else "small", rng.normal(size=5).tolist()) for i in range(16)]
    df = spark.createDataFrame(rows, "row_id long, domain string, topic string, vector array<double>")
    values = {r[0]: np.array(r[3]) for r in rows}
    for k in (None, 2):
        made = smote.smote_vectors(df, keys=S.CLASS, neighbours=k).collect()
        assert len(made) == 8 and {r["i"] for r in made} == set(range(4, 12))
        for r in made:
            x, y = values[r["base_id"]], values[r["neighbour_id"]]
            assert r["base_id"] != r["neighbour_id"] and min(r["base_id"], r["neighbour_id"]) >= 12
            assert np.allclose(r["vector"], x + r["lambda"] * (y - x)) and 0 <= r["lambda"] < 1


def test_tuples_without_other_text_are_left_out(spark):
    df = labelled(
        spark,
        [(1, "a", "same", "d", "one"), (2, "a", "same", "d", "one")] + [(i, "n", f"t{i % 3}", "d", "two") for i in range(3, 9)],
    )
    slots = pairs.contrastive_slots(df, 40).collect()
    texts = {r["row_id"]: r[S.DESCRIPTION] for r in df.collect()}
    anchors = {r["tuple_id"]: r["id"] for r in slots if r["role"] == "anchor"}
    assert anchors and all(a >= 3 for a in anchors.values())
    for t, a in anchors.items():
        mine = [r for r in slots if r["tuple_id"] == t]
        positives = [r["id"] for r in mine if r["role"] == "positive"]
        negatives = [r["id"] for r in mine if r["role"] == "negative"]
        assert len(positives) == 4 and len(set(positives)) == 4 and all(texts[p] != texts[a] and p >= 3 for p in positives)
        assert len(negatives) == 8 and set(negatives) <= {1, 2}


def test_map_batches_holds_pieces_of_a_batch():
    class Frame:
        schema = T.StructType([T.StructField("t", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    run = enrich.map_batches(Frame(), lambda ts: [f"{t}!" for t in ts], "t", 30)
    texts = [None, *map(str, range(1000))]
    pieces = list(run(iter([pa.record_batch({"t": pa.array(texts, pa.string())})])))
    assert max(p.num_rows for p in pieces) <= enrich.PIECE_ROWS
    assert [x for p in pieces for x in p.column("mapped").to_pylist()] == [f"{t}!" for t in texts]


def test_positive_pairs_meet_in_blocks_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 4)
    sizes = {"x": 9, "y": 1, "z": 4, "w": 13}
    rows = [(100 * c + k, "n", "d", "dom", t) for c, (t, n) in enumerate(sizes.items()) for k in range(n)] + [(900, "n", "d", None, "x"), (901, "n", "d", "dom", None)]
    found = pairs.positive_pairs(labelled(spark, rows))
    got = sorted((r["id1"], r["id2"]) for r in found.collect())
    assert got == [(100 * c + i, 100 * c + j) for c, n in enumerate(sizes.values()) for i in range(n) for j in range(i + 1, n)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join [" in line)
    assert "SortMergeJoin" in joined and "__mate#" not in joined.split("Inner")[0]
