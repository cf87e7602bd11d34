"""Model queries. Fitted numbers have no SQL form; the rows scored, the labels that may be predicted and
the comparison with the majority rate have, and so has a nearest-template route whose encoder counts letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.operators import classify, split
from labelloom.operators.encoders import DIMENSIONS
from labelloom.plans import views as V
from labelloom.plans.catalogue.sql import h, using
from labelloom.plans.template_route import predict_templates
from labelloom.session import materialise

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = split.train_test_split(rows)
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


def judged(predicted: DataFrame, train: DataFrame) -> DataFrame:
    """Scored rows; is each predicted label one of training, and are more topics right than the majority rate gives."""
    rows = materialise(predicted.select(S.ROW_ID, *S.CLASS, *[f"predicted_{level}" for level in S.CLASS]))
    out = rows
    for level in S.CLASS:
        labels = train.select(F.col(level).alias(f"predicted_{level}")).distinct().withColumn(f"known_{level}", F.lit(True))
        out = out.join(labels, f"predicted_{level}", "left").withColumn(f"known_{level}", F.coalesce(f"known_{level}", F.lit(False)))
    right = rows.agg(F.count_if(F.col(S.TOPIC) == F.col("predicted_topic"))).scalar()
    majority = rows.groupBy(S.TOPIC).count().agg(F.max("count")).scalar()
    return out.select(S.ROW_ID, *S.CLASS, "known_domain", "known_topic", (right > majority).alias("better_topic"))


def _predict(spark, sf, head, **options):
    train, test = _split(V.decided_vectors(spark, sf))
    model = classify.train(train, head, vector="vector", **options)
    return judged(classify.predict(model, test, vector="vector"), train)


def _text_model(spark, sf, **options):
    train, test = _split(V.attributes(spark, sf))
    return judged(classify.predict(classify.train(train, **options), test), train)


def letter_model():
    """A user encoder: how often each letter occurs, for batches of texts."""
    return lambda texts: [[float(t.lower().count(c)) for c in LETTERS] for t in texts]


def _encoder_gain(spark, sf):
    """Do word vectors learned from the text tell more topics right than as many buckets of hashed words."""
    train, test = _split(V.attributes(spark, sf))
    right = []
    for options in ({"encoder": "vectors"}, {"encoder": "words", "n_features": DIMENSIONS}):
        scored = classify.predict(classify.train(train, levels=(S.TOPIC,), **options), test)
        right.append(scored.agg(F.count_if(F.col(S.TOPIC) == F.col("predicted_topic"))).first()[0])
    return test.agg(F.count(F.lit(1)).alias("rows"), F.lit(right[0] > right[1]).alias("vectors_better"))


def _evaluate(spark, sf):
    """Per level and label of the report: its support in the test rows, and whether its scores are shares."""
    train, test = _split(V.decided_vectors(spark, sf))
    report = classify.evaluate(classify.train(train, vector="vector"), test, vector="vector")
    shares = F.lit(True)
    for score in ("precision", "recall", "f1"):
        shares = shares & F.col(score).between(0.0, 1.0)
    labels = report.filter("kind = 'label'")
    return labels.select("level", "label", F.col("support").cast("bigint").alias("support"), shares.alias("shares"))


def letter_encoder(df: DataFrame, text: str, out: str) -> DataFrame:
    """How often each letter occurs: an encoder that SQL can repeat."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(out, F.array(*[F.regexp_count(lowered, F.lit(c)).cast("double") for c in LETTERS]))


def _templates(spark, sf):
    """Templates with repeated classes: the last of a class, by row, wins."""
    made = V.attributes(spark, sf).select(
        S.ROW_ID, F.col(S.DOMAIN).alias("domain_name"), F.col(S.TOPIC).alias("topic_name"), F.col(S.DESCRIPTION).alias("topic_definition")
    )
    ranked = predict_templates(V.attributes(spark, sf), made, encoder=letter_encoder)
    return ranked.filter("rank = 1").select(S.ROW_ID, F.round("confidence", 6).alias("confidence"))


def _index(spark, sf):
    rows = V.attributes(spark, sf).select(S.ROW_ID, *S.CLASS)
    for level in S.CLASS:
        rows = classify.index_labels(rows, level).transform(rows)
    return rows


def _features(spark, sf):
    """Of each row: the number of words of any weight (``size`` is in every row, so it has none), and its length."""
    made = classify.featurize(V.attributes(spark, sf), 1 << 14)
    values = F.filter(F.unwrap_udt("features")["values"], lambda x: x != 0)  # of the sparse rows as they are
    return made.select(S.ROW_ID, F.size(values).cast("bigint").alias("words"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


_TEST = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {h('split', 'row_id')}, row_id) AS place, count(*) OVER () AS total FROM {{source}})
  WHERE place <= ceil(total * 0.2::DOUBLE)"""
_JUDGED = "SELECT row_id, domain, topic, true AS known_domain, true AS known_topic, true AS better_topic FROM "

QUERIES = {
    "index_labels": _index,
    "featurize": _features,
    "predict_logistic": lambda s, d: _predict(s, d, "logistic"),
    "predict_trees": lambda s, d: _predict(s, d, "trees"),
    "predict_forest": lambda s, d: _predict(s, d, "forest"),
    "predict_text": _text_model,
    "predict_text_vectors": lambda s, d: _text_model(s, d, encoder="vectors"),
    "predict_text_user_encoder": lambda s, d: _text_model(s, d, encoder=letter_model),
    "encoder_gain": _encoder_gain,
    "evaluate_model": _evaluate,
    "predict_templates": _templates,
}

_COUNTED = ", ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in LETTERS)

ORACLES = {
    "index_labels": using("attributes")
    + """SELECT row_id, domain, topic, (dense_rank() OVER (ORDER BY domain) - 1)::DOUBLE AS domain_index,
         (dense_rank() OVER (ORDER BY topic) - 1)::DOUBLE AS topic_index FROM attributes""",
    "predict_logistic": using("decided") + _JUDGED + "(" + _TEST.format(source="decided") + ")",
    "predict_forest": using("decided") + _JUDGED + "(" + _TEST.format(source="decided") + ")",
    "predict_trees": using("decided") + _JUDGED + "(" + _TEST.format(source="decided") + ")",
    "predict_text": using("attributes") + _JUDGED + "(" + _TEST.format(source="attributes") + ")",
    "predict_text_vectors": using("attributes") + _JUDGED + "(" + _TEST.format(source="attributes") + ")",
    "predict_text_user_encoder": using("attributes") + _JUDGED + "(" + _TEST.format(source="attributes") + ")",
    "encoder_gain": using("attributes") + "SELECT count(*) AS rows, true AS vectors_better FROM (" + _TEST.format(source="attributes") + ")",
    "evaluate_model": using("decided", test=_TEST.format(source="decided"))
    + """SELECT level, label, support, true AS shares FROM (
           SELECT 'domain' AS level, domain AS label, count(*) AS support FROM test GROUP BY domain
           UNION ALL SELECT 'topic', topic, count(*) FROM test GROUP BY topic)""",
    "predict_templates": using(
        "attributes",
        latest="SELECT domain, topic, max_by(description, row_id) AS d FROM attributes GROUP BY 1, 2",
        base=f"""SELECT [{_COUNTED}]::DOUBLE[] AS v FROM (SELECT lower('In the domain of ' || domain || ', this attribute represents '
                 || topic || ' which is defined as ' || d) AS t FROM latest)""",
        queries=f"SELECT row_id, [{_COUNTED}]::DOUBLE[] AS v FROM (SELECT row_id, lower(description) AS t FROM attributes)",
    )
    + """SELECT row_id, round(max(list_dot_product(q.v, b.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(b.v, b.v))), 6) AS confidence
         FROM queries q, base b GROUP BY row_id""",
    "featurize": using("attributes")
    + """SELECT row_id, len(list_distinct(list_filter(regexp_split_to_array(lower(description), '\\W+'), lambda w: w NOT IN ('', 'size'))))::BIGINT AS words,
         1.0::DOUBLE AS norm2 FROM attributes""",
}
