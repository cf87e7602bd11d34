"""Distribution, duplicate, preparation and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions import text as X
from labelloom.functions.ranking import head_per_group, sample_n
from labelloom.operators import dedup, prepare, profile, split
from labelloom.operators.generate import plan_batches
from labelloom.plans import views as V
from labelloom.plans.catalogue.sql import h, u, using
from labelloom.session import materialise
from labelloom.sources.readers import parse_definitions


def _text_functions(spark, sf):
    turns = V.table(spark, sf, "conversations")
    rewritten = F.when(
        F.col("turn") % 2 == 0, F.concat(F.lit("Here. "), F.lit(S.REWRITE_PREFIX), F.lit("  "), F.col("text"))
    ).otherwise(F.col("text"))
    frame = turns.select(
        "conv_id", "turn", F.col("role").alias(S.NAME), F.col("text").alias(S.DESCRIPTION), rewritten.alias("raw"),
        F.concat(F.col("role"), F.lit("_a_b")).alias("label"),
    )
    domain, topic = X.split_label("label")
    return frame.select(
        "conv_id",
        "turn",
        X.attribute_text().alias("attribute_text"),
        X.sample_identity().alias("identity"),
        X.after_prefix(F.col("raw")).alias("after_prefix"),
        X.class_label(S.NAME, "label").alias("class_label"),
        domain.alias("label_domain"),
        topic.alias("label_topic"),
        X.is_snake_case(F.col("label")).alias("snake"),
        X.is_synthetic("label").alias("synthetic"),
    )


def near_exact(spark, sf, estimated):
    """The exact total, and whether each estimate lies within four standard errors of the exact number."""
    exact = profile.cardinalities(V.attributes(spark, sf)).select(F.struct(*profile.SKETCHED)).scalar()
    error = 4 * 1.04 / 2 ** (profile.SKETCH_BITS / 2)
    return estimated.select("total", *[(F.abs(F.col(c) - exact[c]) <= error * exact[c]).alias(c) for c in profile.SKETCHED])


def _sketched(spark, sf):
    """Sketches of sixteen chunks, united."""
    chunks = profile.cardinality_sketches(V.attributes(spark, sf).withColumn("chunk", F.col(S.ROW_ID) % 16), ["chunk"])
    return near_exact(spark, sf, profile.united_cardinalities(materialise(chunks)))


QUERIES = {
    "distribution": lambda s, d: profile.distribution(V.attributes(s, d)),
    "distribution_documents": lambda s, d: profile.distribution(V.doc_attributes(s, d)),
    "ordered_report": lambda s, d: profile.ordered_report(profile.distribution(V.attributes(s, d))),
    "class_counts": lambda s, d: profile.class_counts(V.attributes(s, d)),
    "cardinalities": lambda s, d: profile.cardinalities(V.attributes(s, d)),
    "cardinalities_sketched": _sketched,
    "domain_counts": lambda s, d: profile.domain_counts(V.attributes(s, d), dedup.keep_first(V.attributes(s, d))),
    "topic_share": lambda s, d: profile.topic_share(dedup.keep_first(V.attributes(s, d))),
    "label_stats": lambda s, d: profile.label_stats(V.attributes(s, d)),
    "target_size": lambda s, d: profile.target_size(V.attributes(s, d)),
    "class_need": lambda s, d: profile.class_need(V.attributes(s, d), 15),
    "phase_counts": lambda s, d: profile.phase_counts(
        {"initial": V.attributes(s, d), "deduplicated": dedup.keep_first(V.attributes(s, d))}
    ),
    "texts_by_class": lambda s, d: profile.texts_by_class(V.doc_attributes(s, d)),
    "duplicate_stats": lambda s, d: dedup.duplicate_stats(V.attributes(s, d)),
    "partial_duplicates": lambda s, d: dedup.partial_duplicates(V.attributes(s, d)),
    "keep_first": lambda s, d: dedup.keep_first(V.attributes(s, d)),
    "full_row_dedup": lambda s, d: dedup.full_row_dedup(V.doc_attributes(s, d)),
    "distinct_classes": lambda s, d: dedup.distinct_values(V.attributes(s, d), *S.CLASS),
    "build_labelled": lambda s, d: prepare.build_labelled(V.taxonomy(s, d), V.master(s, d)),
    "drop_incomplete": lambda s, d: prepare.drop_incomplete(prepare.build_labelled(V.taxonomy(s, d), V.master(s, d))),
    "incomplete_counts": lambda s, d: prepare.incomplete_counts(prepare.build_labelled(V.taxonomy(s, d), V.master(s, d))),
    "with_attribute_name": lambda s, d: prepare.with_attribute_name(V.doc_attributes(s, d).drop(S.NAME)),
    "parse_text_spec": lambda s, d: prepare.parse_text_spec(V.text_specs(s, d), "value").drop("value"),
    "mask_labels": lambda s, d: prepare.mask_labels(V.attributes(s, d)),
    "mask_counts": lambda s, d: prepare.mask_counts(prepare.mask_labels(V.attributes(s, d))),
    "assign_batches": lambda s, d: prepare.assign_batches(V.attributes(s, d), 50),
    "render_template": lambda s, d: prepare.template_texts(V.templates(s, d)),
    "with_definition": lambda s, d: prepare.with_definition(V.attributes(s, d), V.definitions(s, d)),
    "with_template": lambda s, d: prepare.with_template(
        V.attributes(s, d),
        V.definitions(s, d).select(
            F.col(S.DOMAIN).alias("domain_name"), F.col(S.TOPIC).alias("topic_name"), F.col("definition").alias("topic_definition")
        ),
    )[0],
    "missing_templates": lambda s, d: prepare.with_template(
        V.attributes(s, d),
        V.definitions(s, d).select(
            F.col(S.DOMAIN).alias("domain_name"), F.col(S.TOPIC).alias("topic_name"), F.col("definition").alias("topic_definition")
        ),
    )[1],
    "read_definitions": lambda s, d: parse_definitions(V.definition_lines(s, d))[0],
    "definition_rejects": lambda s, d: parse_definitions(V.definition_lines(s, d))[1],
    "text_functions": _text_functions,
    "known_pairs_only": lambda s, d: prepare.known_pairs_only(V.predictions(s, d), V.doc_attributes(s, d)),
    "cap_split": lambda s, d: split.cap_split(V.attributes(s, d), 15),
    "cap_split_documents": lambda s, d: split.cap_split(V.doc_attributes(s, d), 10),
    "train_test_split": lambda s, d: split.train_test_split(V.doc_attributes(s, d)),
    "train_test_split_fast": lambda s, d: split.train_test_split(V.doc_attributes(s, d), exact=False),
    "split_per_label": lambda s, d: split.split_per_label(V.fine_attributes(s, d)),
    "head_per_group": lambda s, d: head_per_group(V.attributes(s, d), [S.DOMAIN], S.ROW_ID, 2),
    "sample_n": lambda s, d: sample_n(V.attributes(s, d), 100, id_col=S.ROW_ID, seed=S.SEED),
    "plan_batches": lambda s, d: plan_batches(V.attributes(s, d), 15),
}

_SHARE = """
SELECT domain, (sum(n) OVER (PARTITION BY domain))::BIGINT AS domain_count,
       round((sum(n) OVER (PARTITION BY domain))::DOUBLE * 100::DOUBLE / (sum(n) OVER ())::DOUBLE, 6) AS domain_pct,
       topic, n AS topic_count,
       round(n::DOUBLE * 100::DOUBLE / (sum(n) OVER (PARTITION BY domain))::DOUBLE, 6) AS topic_pct
FROM (SELECT domain, topic, count(*) AS n FROM {source} GROUP BY 1, 2)"""

_TEMPLATE = "'In the domain of ' || domain || ', this attribute represents ' || topic || ' which is defined as ' || {d}"

_LINES = f"""
SELECT row_id AS line_no, CASE {h('line', 'row_id')} % 10 WHEN 0 THEN '# ' || attribute_name WHEN 1 THEN '   '
       WHEN 2 THEN domain || ' has no separator'
       ELSE domain || ' | ' || topic || '|' || description || ' ' END AS value FROM attributes"""

_SPLIT_BY_RANK = """
SELECT row_id, attribute_name, description, domain, topic,
       CASE WHEN rn <= {want} THEN '{first}' ELSE '{rest}' END AS split
FROM (SELECT *, row_number() OVER ({part} ORDER BY {hash}, row_id) AS rn, count(*) OVER ({part}) AS n FROM {source})"""

ORACLES = {
    "distribution": using("attributes") + _SHARE.format(source="attributes"),
    "distribution_documents": using("docs") + _SHARE.format(source="docs"),
    "ordered_report": using("attributes") + _SHARE.format(source="attributes"),
    "class_counts": using("attributes") + "SELECT domain, topic, count(*) AS n FROM attributes GROUP BY 1, 2",
    "cardinalities": using("attributes")
    + """SELECT count(*) AS total, count(DISTINCT domain) AS domains, count(DISTINCT topic) AS topics,
         (SELECT count(*) FROM (SELECT DISTINCT domain, topic FROM attributes)) AS classes FROM attributes""",
    "cardinalities_sketched": using("attributes") + "SELECT count(*) AS total, true AS domains, true AS topics, true AS classes FROM attributes",
    "domain_counts": using("attributes", "kept")
    + """SELECT 'before' AS phase, domain, count(*) AS n FROM attributes GROUP BY domain
         UNION ALL SELECT 'after', domain, count(*) FROM kept GROUP BY domain""",
    "topic_share": using("kept")
    + """SELECT domain, topic, n, round(n::DOUBLE * 100::DOUBLE / (sum(n) OVER (PARTITION BY domain))::DOUBLE, 6) AS pct
         FROM (SELECT domain, topic, count(*) AS n FROM kept GROUP BY 1, 2)""",
    "label_stats": using("counts")
    + """SELECT 'attributes_per_label' AS stat, domain, topic, n AS value FROM counts
         UNION ALL SELECT 'total_labels', NULL, NULL, count(*) FROM counts
         UNION ALL SELECT 'total_attributes', NULL, NULL, sum(n)::BIGINT FROM counts""",
    "target_size": using("counts") + "SELECT max(n) AS target FROM counts",
    "class_need": using("counts")
    + "SELECT domain, topic, n, greatest(15 - n, 0)::BIGINT AS need, greatest(n - 15, 0)::BIGINT AS overflow FROM counts",
    "phase_counts": using("attributes", "kept")
    + """SELECT domain, topic, count(*) AS n, 'initial' AS phase FROM attributes GROUP BY 1, 2
         UNION ALL SELECT domain, topic, count(*), 'deduplicated' FROM kept GROUP BY 1, 2""",
    "texts_by_class": using("docs")
    + """SELECT row_id, domain, topic, description AS text,
         row_number() OVER (PARTITION BY domain, topic ORDER BY row_id) - 1 AS text_no,
         count(*) OVER (PARTITION BY domain, topic) AS n FROM docs""",
    "duplicate_stats": using("attributes")
    + """SELECT count(*) AS total, count(*) FILTER (c > 1) AS rows_in_dup_groups,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT attribute_name, domain, topic FROM attributes)) AS rows_removed,
         count(*) FILTER (attribute_name IN (SELECT attribute_name FROM attributes GROUP BY 1
             HAVING count(DISTINCT (domain, topic)) > 1)) AS partial_duplicate_rows
         FROM (SELECT *, count(*) OVER (PARTITION BY attribute_name, domain, topic) AS c FROM attributes)""",
    "partial_duplicates": using("attributes")
    + """SELECT attribute_name, count(DISTINCT (domain, topic)) AS variants, count(*) AS rows FROM attributes
         GROUP BY 1 HAVING count(DISTINCT (domain, topic)) > 1""",
    "keep_first": using("kept") + "SELECT * FROM kept",
    "full_row_dedup": using("docs") + "SELECT DISTINCT attribute_name, description, domain, topic FROM docs",
    "distinct_classes": using("attributes") + "SELECT DISTINCT domain, topic FROM attributes",
    "build_labelled": using("labelled") + "SELECT * FROM labelled",
    "drop_incomplete": using("complete") + "SELECT * FROM complete",
    "incomplete_counts": using("labelled", "complete")
    + """SELECT count(*) AS total, count(*) - (SELECT count(*) FROM complete) AS dropped,
         (SELECT count(*) FROM complete) AS kept FROM labelled""",
    "with_attribute_name": using("docs")
    + """SELECT row_id, description, domain, topic,
         (row_number() OVER (ORDER BY row_id) - 1)::VARCHAR AS attribute_name FROM docs""",
    "parse_text_spec": """
        SELECT conv_id, turn,
          CASE WHEN instr(v, ':') > 0 THEN trim(substr(v, 1, instr(v, ':') - 1), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))
               ELSE 'unknown' END AS attribute_name,
          trim(CASE WHEN instr(v, ':') > 0 THEN substr(v, instr(v, ':') + 1) ELSE v END,
               ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS description
        FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN role || ' : ' || text ELSE text END AS v FROM conversations)""",
    "mask_labels": using("attributes")
    + f"""SELECT row_id, attribute_name, description, CASE WHEN mask IN ('domain', 'both') THEN '' ELSE domain END AS domain,
          CASE WHEN mask IN ('topic', 'both') THEN '' ELSE topic END AS topic, mask
          FROM (SELECT *, CASE WHEN k < 0.3::DOUBLE THEN 'domain' WHEN k < 0.6::DOUBLE THEN 'topic'
                ELSE 'both' END AS mask FROM (SELECT *, {u('mask', 'row_id')} AS k FROM attributes))""",
    "mask_counts": using("attributes")
    + f"""SELECT CASE WHEN k < 0.3::DOUBLE THEN 'domain' WHEN k < 0.6::DOUBLE THEN 'topic' ELSE 'both' END AS mask,
          count(*) AS n FROM (SELECT {u('mask', 'row_id')} AS k FROM attributes) GROUP BY 1""",
    "assign_batches": using("attributes")
    + "SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 50 AS batch_id FROM attributes",
    "render_template": using("attributes")
    + f"""SELECT domain, topic, {_TEMPLATE.format(d='d')} AS template
          FROM (SELECT domain, topic, min(description) AS d FROM attributes GROUP BY 1, 2)""",
    "with_definition": using("attributes", "definitions")
    + """SELECT domain, topic, row_id, attribute_name, description, coalesce(definition, '') AS definition
         FROM attributes LEFT JOIN definitions USING (domain, topic)""",
    "with_template": using("attributes", "definitions")
    + f"""SELECT domain, topic, row_id, attribute_name, description, {_TEMPLATE.format(d='definition')} AS template
          FROM attributes JOIN definitions USING (domain, topic)""",
    "missing_templates": using("attributes", "definitions")
    + """SELECT domain, topic, row_id, attribute_name, description FROM attributes a WHERE NOT EXISTS
         (SELECT 1 FROM definitions d WHERE d.domain = a.domain AND d.topic = a.topic)""",
    "read_definitions": using("attributes", lines=_LINES)
    + """SELECT domain, topic, definition FROM (
           SELECT trim(split_part(value, '|', 1)) AS domain, trim(split_part(value, '|', 2)) AS topic,
                  trim(split_part(value, '|', 3)) AS definition,
                  row_number() OVER (PARTITION BY trim(split_part(value, '|', 1)), trim(split_part(value, '|', 2))
                                     ORDER BY line_no DESC) AS rn
           FROM lines WHERE trim(value) <> '' AND NOT starts_with(value, '#') AND len(string_split(value, '|')) = 3)
         WHERE rn = 1""",
    "definition_rejects": using("attributes", lines=_LINES)
    + """SELECT line_no, value FROM lines WHERE trim(value) <> '' AND NOT starts_with(value, '#')
         AND len(string_split(value, '|')) <> 3""",
    "text_functions": """
        SELECT conv_id, turn, role || ' ' || text AS attribute_text, role || '_' || text AS identity,
          CASE WHEN turn % 2 = 0 OR contains(text, 'Standardized Description:')
               THEN trim(split_part(CASE WHEN turn % 2 = 0 THEN 'Here. Standardized Description:  ' || text ELSE text END,
                                    'Standardized Description:', 2), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))
               ELSE text END AS after_prefix,
          role || '_' || role || '_a_b' AS class_label, role AS label_domain, 'a_b' AS label_topic,
          regexp_full_match(role || '_a_b', '[a-z][a-z0-9_]*') AS snake, starts_with(role, 'synthetic_') AS synthetic
        FROM conversations""",
    "known_pairs_only": using("predictions")
    + """SELECT predicted_domain, predicted_topic, row_id, domain, topic FROM predictions p WHERE EXISTS
         (SELECT 1 FROM documents t WHERE t.lang = p.predicted_domain AND t.source = p.predicted_topic)""",
    "cap_split": using("split15") + "SELECT * FROM split15",
    "cap_split_documents": using("docs")
    + _SPLIT_BY_RANK.format(want="10", first="train", rest="eval", part="PARTITION BY domain, topic", hash=h("cap", "row_id"), source="docs"),
    "train_test_split": using("docs")
    + _SPLIT_BY_RANK.format(want="ceil(n::DOUBLE * 0.2::DOUBLE)", first="test", rest="train", part="", hash=h("split", "row_id"), source="docs"),
    "train_test_split_fast": using("docs")
    + f"""SELECT row_id, attribute_name, description, domain, topic,
          CASE WHEN {u('split', 'row_id')} < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split FROM docs""",
    "split_per_label": using("fine")
    + f"""SELECT row_id, attribute_name, description, domain, topic, unnest(
            CASE WHEN n = 1 THEN ['train', 'val'] WHEN rn <= ceil(n::DOUBLE * 0.1::DOUBLE) THEN ['val'] ELSE ['train'] END) AS split
          FROM (SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY {h('val', 'row_id')}, row_id) AS rn,
                count(*) OVER (PARTITION BY domain, topic) AS n FROM fine)""",
    "head_per_group": using("attributes")
    + """SELECT row_id, attribute_name, description, domain, topic FROM (
         SELECT *, row_number() OVER (PARTITION BY domain ORDER BY row_id) AS rn FROM attributes) WHERE rn <= 2""",
    "sample_n": using("attributes")
    + f"SELECT * FROM attributes ORDER BY {h('sample', 'row_id')}, row_id LIMIT 100",
    "plan_batches": using("needs15")
    + """SELECT domain, topic, n, need, unnest(range(1, ceil(need / 5.0)::BIGINT + 1)) AS batch_id, 5::BIGINT AS batch_size,
         least(CASE WHEN n <= 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 10 THEN 3 ELSE 6 END, n)::BIGINT AS k FROM needs15""",
}
