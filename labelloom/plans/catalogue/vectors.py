"""Similarity, nearest-neighbour and SMOTE queries over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.vectors import squared_norm
from labelloom.operators import pairs, similarity, smote, vectorindex
from labelloom.plans import views as V
from labelloom.plans.catalogue.sql import h, u, using
from labelloom.session import materialise

TEXT_AT = 0.3  # the tables hold no pair above the default .8
TOPIC_AT = 0.05  # nor two class means above the default .7
CELLS = 16
PROBES = 12  # these vectors hardly cluster: a neighbour may lie in most cells


def _six_digits(similarity):
    """``round`` to six digits, half up, of a positive number of nine: in doubles, where ``round`` makes a decimal of every pair."""
    return F.floor((F.rint(F.col(similarity) * 1e9) + 500) / 1000) / F.lit(1e6)


def _text_pairs(spark, sf):
    found = similarity.similar_text_pairs(V.vectors(spark, sf), TEXT_AT)
    return found.withColumn("similarity", _six_digits("similarity"))


def _topic_pairs(spark, sf):
    found = similarity.similar_topic_pairs(V.centroids(spark, sf), V.vectors(spark, sf), TOPIC_AT)
    return found.withColumn("similarity", F.round("similarity", 6))


def _mix(spark, sf):
    rows = V.vectors(spark, sf).agg(F.count(F.lit(1))).scalar()
    return pairs.mix_similar_negatives(_topic_pairs(spark, sf), _text_pairs(spark, sf), rows)


def _nearest_template(spark, sf, **options):
    templates = V.centroids(spark, sf).withColumnRenamed(S.TOPIC, "template_id")
    return similarity.nearest_template(V.vectors(spark, sf), templates, **options).withColumn(
        "confidence", F.round("confidence", 6)
    )


def _knn(spark, sf):
    return similarity.knn_join(V.vectors(spark, sf), 5, keys=S.CLASS).withColumn("distance2", F.round("distance2", 6))


def _points(spark, sf, **options):
    made = smote.smote_vectors(V.vectors(spark, sf), keys=S.CLASS, **options)
    return made.select(
        *S.CLASS, "n", "i", "base_id", "neighbour_id",
        F.round("lambda", 9).alias("lambda"),
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(squared_norm(F.col("vector")), 6).alias("norm2"),
    )


def _nearest_original(spark, sf):
    rows = V.vectors(spark, sf)
    made = smote.smote_vectors(rows, keys=S.CLASS).withColumn(
        "synthetic_id", F.concat_ws("|", S.DOMAIN, S.TOPIC, "i")
    )
    found = similarity.nearest_original(made, rows, keys=S.CLASS)
    return found.withColumn("dot", F.round("dot", 6))


def _text_pairs_lsh(spark, sf):
    found = similarity.similar_text_pairs(V.vectors(spark, sf), TEXT_AT, recall=0.98)
    return found.withColumn("similarity", _six_digits("similarity"))


def _lsh_recall(spark, sf):
    """Pairs above the threshold, and whether the buckets give 90 % of them and none besides."""
    met = similarity.compare_text_pairs(V.vectors(spark, sf), TEXT_AT, recall=0.98)
    return met.select(F.col("true").alias("pairs"), (F.col("hit") >= 0.9 * F.col("true")).alias("recalled"), (F.col("other") == 0).alias("none_else"))


def _index(spark, sf):
    """A kept index of the first half of the rows, the second half appended later, opened again from its files."""
    rows = V.vectors(spark, sf)
    later = F.col(S.ROW_ID) % 2 == 1
    index = vectorindex.build_index(rows.filter(~later), keys=S.CLASS, cells=CELLS)
    vectorindex.append(index, rows.filter(later))
    return vectorindex.load_index(spark, index.path)


def _knn_indexed(spark, sf, **options):
    found = vectorindex.knn_join_indexed(V.vectors(spark, sf), 5, _index(spark, sf), **options)
    return found.withColumn("distance2", F.round("distance2", 6))


def _knn_recall(spark, sf):
    """Neighbours in all, and whether the probed cells alone give 90 % of them."""
    keys = [S.ROW_ID, "neighbour_id"]
    probed = _knn_indexed(spark, sf, probes=PROBES).select(*keys, F.lit(True).alias("hit"))
    both = _knn(spark, sf).join(probed, keys, "left")
    n = F.count(F.lit(1))
    return both.agg(n.alias("neighbours"), (F.count("hit") >= 0.9 * n).alias("recalled"))


def _nearest_original_all(spark, sf):
    rows = V.vectors(spark, sf)
    made = materialise(smote.smote_vectors(rows, keys=S.CLASS).withColumn("synthetic_id", F.concat_ws("|", S.DOMAIN, S.TOPIC, "i")))
    return similarity.nearest_original(made, rows, cells=CELLS).withColumn("dot", F.round("dot", 6))


def _texts(spark, sf):
    rows = V.vector_texts(spark, sf)
    return smote.smote_texts(rows.drop("vector"), rows.select(S.ROW_ID, "vector"))


def _simple_texts(spark, sf):
    rows = V.vector_texts(spark, sf)
    return smote.simple_smote_texts(rows.drop("vector"), rows.select(S.ROW_ID, "vector"))


QUERIES = {
    "similar_text_pairs": _text_pairs,
    "similar_text_pairs_lsh": _text_pairs_lsh,
    "similar_text_pairs_recall": _lsh_recall,
    "similar_topic_pairs": _topic_pairs,
    "mix_similar_negatives": _mix,
    "nearest_template_top3": _nearest_template,
    "nearest_template_top3_shuffled": lambda s, d: _nearest_template(s, d, max_floats=0, cells=4),
    "knn_join": _knn,
    "knn_join_indexed": _knn_indexed,
    "knn_join_probed": lambda s, d: _knn_indexed(s, d, probes=PROBES),
    "knn_join_recall": _knn_recall,
    "smote_vectors": _points,
    "smote_vectors_knn": lambda s, d: _points(s, d, neighbours=5),
    "nearest_original": _nearest_original,
    "nearest_original_all": _nearest_original_all,
    "smote_to_text": _texts,
    "smote_to_text_simple": _simple_texts,
}

_TEXT_PAIRS = f"""
SELECT a.row_id AS id1, b.row_id AS id2, a.topic AS topic1, b.topic AS topic2, 1::BIGINT AS copies1,
       1::BIGINT AS copies2, round(s, 6) AS similarity
FROM (SELECT x.row_id AS i, y.row_id AS j, round(list_dot_product(x.unit_vector, y.unit_vector), 9) AS s
      FROM units x JOIN units y ON x.row_id < y.row_id AND x.topic <> y.topic)
JOIN units a ON a.row_id = i JOIN units b ON b.row_id = j WHERE s > {TEXT_AT}::DOUBLE"""

_TOPIC_PAIRS = f"""
SELECT x.topic AS topic1, y.topic AS topic2, a.row_id AS id1, b.row_id AS id2, round(s, 6) AS similarity
FROM (SELECT p.topic AS c1, q.topic AS c2,
             round(list_dot_product(p.vector, q.vector) / sqrt(list_dot_product(p.vector, p.vector))
                   / sqrt(list_dot_product(q.vector, q.vector)), 9) AS s
      FROM centroids p JOIN centroids q ON p.topic < q.topic)
JOIN centroids x ON x.topic = c1 JOIN centroids y ON y.topic = c2
JOIN heads a ON a.topic = c1 JOIN heads b ON b.topic = c2 WHERE s >= {TOPIC_AT}::DOUBLE"""

_HEADS = """
SELECT topic, row_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY row_id) AS rn FROM vectors)
WHERE rn <= 2"""

_TEMPLATES = """
SELECT row_id, template_id, round(s, 6) AS confidence, rank FROM (
  SELECT row_id, template_id, s, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, template_id) AS rank
  FROM (SELECT v.row_id, c.topic AS template_id,
               round(list_dot_product(v.unit_vector, c.vector) / sqrt(list_dot_product(c.vector, c.vector)), 9) AS s
        FROM units v, centroids c)) WHERE rank <= 3"""

_NEIGHBOURS = """
SELECT row_id, neighbour_id, distance2, rank FROM (
  SELECT row_id, neighbour_id, -s AS distance2, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, neighbour_id) AS rank
  FROM (SELECT a.row_id, b.row_id AS neighbour_id, round(2 * list_dot_product(a.vector, b.vector)
               - list_dot_product(a.vector, a.vector) - list_dot_product(b.vector, b.vector), 9) AS s
        FROM vectors a JOIN vectors b ON a.domain = b.domain AND a.topic = b.topic AND a.row_id <> b.row_id))
WHERE rank <= 5"""

_VIEWS = {
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY row_id) - 1 AS place,
               count(*) OVER (PARTITION BY domain, topic) AS n FROM vectors""",
    "wanted": """
        SELECT domain, topic, n, unnest(range(n, top)) AS i FROM (
          SELECT domain, topic, count(*) AS n, max(count(*)) OVER () AS top FROM vectors GROUP BY 1, 2) WHERE n > 1""",
    "based": f"""
        SELECT w.*, r.row_id AS base_id, r.vector AS x, r.place, {u('smote_lambda', 'w.domain', 'w.topic', 'w.i')} AS lam
        FROM wanted w JOIN numbered r ON r.domain = w.domain AND r.topic = w.topic
         AND r.place = {h('smote_base', 'w.domain', 'w.topic', 'w.i')} % w.n""",
    "synthetic": f"""
        SELECT b.domain, b.topic, b.n, b.i, b.base_id, r.row_id AS neighbour_id, b.lam,
               list_transform(list_zip(b.x, r.vector), lambda e: e[1] + b.lam * (e[2] - e[1])) AS vector
        FROM based b JOIN numbered r ON r.domain = b.domain AND r.topic = b.topic
         AND r.place = (b.place + {h('smote_neighbour', 'b.domain', 'b.topic', 'b.i')} % (b.n - 1) + 1) % b.n""",
}

_KNN_SYNTHETIC = f"""
SELECT b.domain, b.topic, b.n, b.i, b.base_id, k.neighbour_id, b.lam,
       list_transform(list_zip(b.x, r.vector), lambda e: e[1] + b.lam * (e[2] - e[1])) AS vector
FROM based b JOIN neighbours k ON k.row_id = b.base_id
 AND k.rank = {h('smote_neighbour', 'b.domain', 'b.topic', 'b.i')} % least(5, b.n - 1) + 1
JOIN vectors r ON r.row_id = k.neighbour_id"""

_SCALARS = """
SELECT domain, topic, n, i, base_id, neighbour_id, round(lam, 9) AS "lambda", round(list_sum(vector), 6) AS total,
       round(list_dot_product(vector, vector), 6) AS norm2 FROM {source}"""


def _nearest(source: str, condition: str) -> str:
    return f"""
SELECT domain, topic, n, i, row_id, d FROM (
  SELECT s.domain, s.topic, s.n, s.i, v.row_id, round(list_dot_product(s.vector, v.vector), 9) AS d,
         row_number() OVER (PARTITION BY s.domain, s.topic, s.i
                            ORDER BY round(list_dot_product(s.vector, v.vector), 9) DESC, v.row_id) AS rn
  FROM {source} s JOIN vectors v ON {condition}) WHERE rn = 1"""


_IN_CLASS = "s.domain = v.domain AND s.topic = v.topic"
_NAMED = "'vector ' || row_id::VARCHAR || ' of topic ' || (SELECT t.topic FROM vectors t WHERE t.row_id = x.row_id)"

_KNN = using("vectors") + "SELECT row_id, neighbour_id, round(distance2, 6) AS distance2, rank FROM (" + _NEIGHBOURS + ")"

ORACLES = {
    "similar_text_pairs": using("units") + _TEXT_PAIRS,
    "similar_text_pairs_recall": using("units", tp=_TEXT_PAIRS) + "SELECT count(*) AS pairs, true AS recalled, true AS none_else FROM tp",
    "similar_topic_pairs": using("centroids", heads=_HEADS) + _TOPIC_PAIRS,
    "mix_similar_negatives": using("units", "centroids", heads=_HEADS, tp=_TEXT_PAIRS, cp=_TOPIC_PAIRS)
    + f""", ranked AS (
           SELECT id1, id2, 'topic' AS kind, 0.0::DOUBLE AS label,
                  row_number() OVER (ORDER BY {h('mix_topic', "id1 || '|' || id2")}, id1 || '|' || id2) AS rn FROM cp
           UNION ALL
           SELECT id1, id2, 'text', 0.0::DOUBLE,
                  row_number() OVER (ORDER BY {h('mix_text', "id1 || '|' || id2")}, id1 || '|' || id2) FROM tp)
         SELECT id1, id2, kind, label FROM ranked, (SELECT count(*) AS total FROM vectors), (SELECT count(*) AS c FROM cp)
         WHERE CASE kind WHEN 'topic' THEN rn <= total // 2 ELSE rn <= total - least(total // 2, c) END""",
    "nearest_template_top3": using("units", "centroids") + _TEMPLATES,
    "nearest_template_top3_shuffled": using("units", "centroids") + _TEMPLATES,
    "knn_join": _KNN,
    "knn_join_indexed": _KNN,
    "knn_join_recall": using("vectors") + "SELECT count(*) AS neighbours, true AS recalled FROM (" + _NEIGHBOURS + ")",
    "smote_vectors": using("vectors", **_VIEWS) + _SCALARS.format(source="synthetic"),
    "smote_vectors_knn": using("vectors", **_VIEWS, neighbours=_NEIGHBOURS, near=_KNN_SYNTHETIC) + _SCALARS.format(source="near"),
    "nearest_original": using("vectors", **_VIEWS)
    + "SELECT domain || '|' || topic || '|' || i::VARCHAR AS synthetic_id, row_id, round(d, 6) AS dot FROM ("
    + _nearest("synthetic", _IN_CLASS) + ")",
    "nearest_original_all": using("vectors", **_VIEWS)
    + "SELECT domain || '|' || topic || '|' || i::VARCHAR AS synthetic_id, row_id, round(d, 6) AS dot FROM ("
    + _nearest("synthetic", "true") + ")",
    "smote_to_text": using("vectors", **_VIEWS)
    + f"""SELECT row_id AS source_id, i, 'synthetic_' || domain || '_' || topic || '_' || i::VARCHAR AS attribute_name,
          'SMOTE Generated (' || (i - n + 1)::VARCHAR || '): Based on ' || {_NAMED} AS description, domain, topic
          FROM ({_nearest('synthetic', _IN_CLASS)}) x""",
    "smote_to_text_simple": using("vectors", **_VIEWS, neighbours=_NEIGHBOURS, near=_KNN_SYNTHETIC)
    + f"""SELECT row_id AS source_id, 'synthetic_' || ((SELECT count(*) FROM vectors)
            + row_number() OVER (ORDER BY md5(domain || '|' || topic), i) - 1)::VARCHAR AS attribute_name,
          'SYNTHETIC - Based on: ' || {_NAMED} AS description, domain, topic
          FROM ({_nearest('near', 'true')}) x""",
}
