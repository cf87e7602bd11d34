"""The physical plans that the operators are meant to have."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelloom.operators import dedup, generate, pairs, profile, split
from labelloom.plans import views as V
from labelloom.session import materialise

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# queries whose plan is fixed before any model is fitted
FITTED = {"predict_logistic", "predict_trees", "predict_forest", "predict_text", "evaluate_model", "train_and_predict_file"}
PLANNED = sorted(name for name in set(QUERIES) - FITTED if not re.match(r"op\d+_|pipeline$", name))


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_or_nested_loop_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_no_pinning_to_one_machine():
    source = "\n".join(p.read_text() for p in pathlib.Path(__file__).parent.parent.joinpath("labelloom").rglob("*.py"))
    for banned in ("localCheckpoint", "crossJoin", ".rdd", "coalesce(1).write.parquet"):
        assert banned not in source


def test_counts_read_two_columns_and_combine_before_the_shuffle(spark, sf):
    text = plan(profile.class_counts(V.attributes(spark, sf)))
    assert re.search(r"ReadSchema: struct<p_brand:string,p_type:string>", text)
    assert "partial_count" in text and text.count("Exchange") == 1
    assert "IsNotNull(p_brand)" in text


def test_cap_split_does_not_shuffle_wide_rows(spark, sf):
    df = split.cap_split(V.doc_attributes(spark, sf), 10)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final
    assert "hashpartitioning" not in final


def test_cuts_read_keys_and_id_only(spark, sf):
    from labelloom.functions.ranking import hash_cuts

    cuts = hash_cuts(V.doc_attributes(spark, sf), ["domain"], lambda n: F.least(n, F.lit(5)), seed=1, salt="x", id_col="row_id")
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(cuts)))
    assert schemas and all("text" not in s for s in schemas)


def test_keep_first_prunes_on_the_map_side(spark, sf):
    text = plan(dedup.keep_first(V.attributes(spark, sf)))
    assert re.search(r"WindowGroupLimit.*Partial", text)
    assert text.count("Exchange hashpartitioning") == 1


def test_pair_joins_are_equi_joins_on_places(spark, sf):
    text = plan(pairs.positive_pairs(materialise(V.attributes(spark, sf))))
    assert re.search(r"(SortMergeJoin|HashJoin) \[domain#\d+, topic#\d+, __mate", text)
    hard = plan(pairs.hard_negative_pairs(V.attributes(spark, sf)))
    assert re.search(r"(SortMergeJoin|HashJoin) \[domain#\d+, rank#\d+L, a#\d+, b#\d+\]", hard)


@pytest.mark.parametrize(
    "name", ["cap_split", "split_per_label", "replicate", "negatives_domain_mix", "accept_generated", "contrastive_tuples", "known_pairs_only"]
)
def test_same_rows_without_any_broadcast(spark, sf, name):
    want = sorted(map(str, QUERIES[name](spark, sf).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        df = QUERIES[name](spark, sf)
        assert "BroadcastHashJoin" not in plan(df)
        assert sorted(map(str, df.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_prompts_group_bounded_lists_only(spark, sf):
    rows = V.attributes(spark, sf)
    planned = generate.plan_batches(rows, 15)
    sizes = generate.context_sample(rows, planned).groupBy("domain", "topic", "batch_id").count()
    assert sizes.agg(F.max("count")).first()[0] <= 6
