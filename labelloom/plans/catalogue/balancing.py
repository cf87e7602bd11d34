"""Balancing and generation queries."""

from __future__ import annotations

from labelloom import schema as S
from labelloom.operators import balance, enrich, generate, profile
from labelloom.plans import views as V
from labelloom.plans.catalogue.sql import h, using


def _checked(prompt: str) -> str:
    """Stand-in for a user's rewrite function: repeats the description with a mark."""
    text = next(line for line in prompt.split("\n") if line.startswith("Description: "))
    return f"Answer. {S.REWRITE_PREFIX} {text.removeprefix('Description: ')} (checked)"


def _echo(prompt: str) -> str:
    """Stand-in for a user's generator: the first line of the prompt."""
    return prompt.split("\n")[0]


def _doubled(texts):
    return [f"{t} / {t}" for t in texts]


def _plan(spark, sf):
    return generate.plan_batches(V.attributes(spark, sf), 15)


QUERIES = {
    "replicate": lambda s, d: balance.replicate(V.attributes(s, d)),
    "augment_single": lambda s, d: balance.augment_single(V.fine_attributes(s, d), 4),
    "dynamic_balance": lambda s, d: balance.dynamic_balance(V.attributes(s, d)),
    "balanced_training_set": lambda s, d: balance.balance(V.attributes(s, d), V.responses(s, d), 15),
    "balance_summary": lambda s, d: profile.balance_summary(balance.balance(V.attributes(s, d), V.responses(s, d), 15)),
    "balance_report": lambda s, d: profile.balance_report(balance.balance(V.attributes(s, d), V.responses(s, d), 15)),
    "parse_responses_strict": lambda s, d: generate.parse_responses(V.responses(s, d)),
    "parse_responses_per_line": lambda s, d: generate.parse_responses(V.responses(s, d), "per_line"),
    "drop_used": lambda s, d: generate.drop_used(
        generate.parse_responses(V.responses(s, d)), V.attributes(s, d), generate.IDENTITY
    ),
    "accept_generated": lambda s, d: generate.accept_generated(V.attributes(s, d), V.responses(s, d), cap=15),
    "accept_generated_per_line": lambda s, d: generate.accept_generated(
        V.attributes(s, d), V.responses(s, d), cap=15, mode="per_line"
    ),
    "generation_stats": lambda s, d: generate.generation_stats(V.attributes(s, d), V.responses(s, d), cap=15),
    "generation_stats_per_line": lambda s, d: generate.generation_stats(
        V.attributes(s, d), V.responses(s, d), cap=15, mode="per_line"
    ),
    "context_sample": lambda s, d: generate.context_sample(V.attributes(s, d), _plan(s, d)),
    "prompts": lambda s, d: generate.build_prompts(
        V.attributes(s, d), _plan(s, d), definitions=V.definitions(s, d), used=V.attributes(s, d)
    ),
    "enrich_text": lambda s, d: enrich.enrich_text(V.attributes(s, d), _checked).drop("attempts"),
    "map_batches": lambda s, d: enrich.map_batches(V.doc_attributes(s, d), _doubled, S.DESCRIPTION, 50),
    "generate_responses": lambda s, d: enrich.generate_responses(
        generate.build_prompts(V.attributes(s, d), _plan(s, d)), _echo
    ),
}

_COPIES = """
SELECT source_id, i, n, 'synthetic_' || domain || '_' || topic || '_' || i::VARCHAR AS attribute_name, description, domain, topic
FROM (SELECT c.domain, c.topic, c.n, unnest(range(0, (SELECT max(n) FROM counts) - c.n)) AS i FROM counts c) w
JOIN (SELECT row_id AS source_id, description, domain, topic,
             row_number() OVER (PARTITION BY domain, topic ORDER BY row_id) - 1 AS place FROM attributes) r
USING (domain, topic) WHERE r.place = w.i % w.n"""

_REPLICATED = "'Replicated (' || (i + 1)::VARCHAR || '): ' || description"

_VARIANT = f"""CASE {h('variant', 'source_id', 'i')} % 3 WHEN 0 THEN 'Alternative ' || (i + 1)::VARCHAR || ': ' || description
     WHEN 1 THEN 'Variant ' || (i + 1)::VARCHAR || ' of: ' || description ELSE 'Similar to: ' || description END"""

_PLAN = """
SELECT domain, topic, n, need, unnest(range(1, ceil(need / 5.0)::BIGINT + 1)) AS batch_id,
       least(CASE WHEN n <= 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 10 THEN 3 ELSE 6 END, n)::BIGINT AS k FROM needs15"""

_CONTEXT = f"""
SELECT domain, topic, batch_id, slot, row_id, attribute_name, description
FROM (SELECT *, lo + {h('context', 'domain', 'topic', 'batch_id', 'slot')} % (hi - lo) AS place
      FROM (SELECT *, slot * n // k AS lo, (slot + 1) * n // k AS hi
            FROM (SELECT *, unnest(range(0, k)) AS slot FROM plan)))
JOIN (SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY row_id) - 1 AS place FROM attributes)
USING (domain, topic, place)"""


def _stats(parsed: str, fresh: str) -> str:
    return using("needs15", "response_lines", parsed, fresh) + f"""
SELECT domain, topic, n AS original, need AS needed, least(coalesce(f, 0), need)::BIGINT AS generated,
       coalesce(ok, 0)::BIGINT AS ok_batches, coalesce(batches - ok, 0)::BIGINT AS failed_batches,
       (coalesce(v, 0) - coalesce(f, 0))::BIGINT AS duplicates_avoided,
       round(CASE WHEN batches > 0 THEN ok::DOUBLE * 100::DOUBLE / batches::DOUBLE ELSE 0::DOUBLE END, 6) AS success_pct,
       (need - least(coalesce(f, 0), need))::BIGINT AS shortfall
FROM needs15 LEFT JOIN (
    SELECT domain, topic, count(*) AS batches, sum(v)::BIGINT AS v, sum(f)::BIGINT AS f, count(*) FILTER (f > 0) AS ok
    FROM (SELECT domain, topic, batch_id,
            (SELECT count(*) FROM {parsed} p WHERE p.domain = b.domain AND p.topic = b.topic AND p.batch_id = b.batch_id) AS v,
            (SELECT count(*) FROM {fresh} p WHERE p.domain = b.domain AND p.topic = b.topic AND p.batch_id = b.batch_id) AS f
          FROM (SELECT DISTINCT domain, topic, batch_id FROM response_lines) b)
    GROUP BY 1, 2) USING (domain, topic)"""


def _prompt(definition: str, names: str) -> str:
    return f"""'Write 5 new attributes of the class ' || domain || ' / ' || topic || '.' || {definition} || {names}
      || chr(10) || examples || chr(10)
      || 'Use snake_case names, clear descriptions, and repeat none of the names above.' || chr(10)
      || 'Answer with 5 lines of JSON only: {{"attribute_name": "...", "description": "..."}}'"""


_EXAMPLES = """
SELECT domain, topic, batch_id, string_agg('Example ' || (slot + 1)::VARCHAR || ':' || chr(10) || 'Attribute: '
       || attribute_name || chr(10) || 'Description: ' || description, chr(10) ORDER BY slot) AS examples
FROM context GROUP BY 1, 2, 3"""

_NAMES = """
SELECT domain, topic, string_agg(attribute_name, ', ' ORDER BY attribute_name) AS names
FROM (SELECT DISTINCT domain, topic, attribute_name FROM attributes) GROUP BY 1, 2"""

ORACLES = {
    "replicate": using("attributes", "counts", copies=_COPIES)
    + f"SELECT source_id, i, attribute_name, {_REPLICATED} AS description, domain, topic FROM copies",
    "augment_single": using("fine")
    + f"""SELECT source_id, i, 'synthetic_' || domain || '_' || topic || '_' || i::VARCHAR AS attribute_name,
          {_VARIANT} AS description, domain, topic
          FROM (SELECT row_id AS source_id, description, domain, topic, unnest(range(0, 3)) AS i
                FROM (SELECT *, count(*) OVER (PARTITION BY domain, topic) AS n FROM fine) WHERE n = 1)""",
    "dynamic_balance": using("attributes", "counts", copies=_COPIES)
    + f"""SELECT source_id, attribute_name, CASE WHEN n = 1 THEN {_VARIANT} ELSE {_REPLICATED} END AS description,
          domain, topic, CASE WHEN n = 1 THEN 'variation' ELSE 'replicated' END AS origin FROM copies
          UNION ALL SELECT row_id, attribute_name, description, domain, topic, 'original' FROM attributes""",
    "balanced_training_set": using("balanced15") + "SELECT * FROM balanced15",
    "balance_summary": using("balanced15")
    + """SELECT count(*) FILTER (origin = 'original') AS original, count(*) FILTER (split = 'train') AS training,
         count(*) FILTER (split = 'eval') AS evaluation, count(*) FILTER (origin = 'generated') AS generated FROM balanced15""",
    "balance_report": using("balanced15")
    + """SELECT 'totals' AS section, NULL AS domain, NULL AS topic, unnest(['original', 'training', 'evaluation', 'generated']) AS metric,
           unnest([count(*) FILTER (origin = 'original'), count(*) FILTER (split = 'train'), count(*) FILTER (split = 'eval'),
                   count(*) FILTER (origin = 'generated')])::DOUBLE AS value FROM balanced15
         UNION ALL
         SELECT 'classes', domain, topic, unnest(['original', 'training', 'evaluation']),
           unnest([count(*) FILTER (origin = 'original'), count(*) FILTER (split = 'train'), count(*) FILTER (split = 'eval')])::DOUBLE
         FROM balanced15 GROUP BY domain, topic""",
    "parse_responses_strict": using("strict") + "SELECT * FROM strict",
    "parse_responses_per_line": using("per_line") + "SELECT * FROM per_line",
    "drop_used": using("fresh_strict") + "SELECT * FROM fresh_strict",
    "accept_generated": using("accepted_strict") + "SELECT * FROM accepted_strict",
    "accept_generated_per_line": using("accepted_line") + "SELECT * FROM accepted_line",
    "generation_stats": _stats("strict", "fresh_strict"),
    "generation_stats_per_line": _stats("per_line", "fresh_line"),
    "context_sample": using("needs15", plan=_PLAN) + _CONTEXT,
    "prompts": using("needs15", "definitions", plan=_PLAN, context=_CONTEXT, examples=_EXAMPLES, names=_NAMES)
    + "SELECT domain, topic, batch_id, 5::BIGINT AS batch_size, "
    + _prompt(
        "CASE WHEN definition IS NOT NULL THEN chr(10) || 'Definition: ' || definition ELSE '' END",
        "chr(10) || 'Names already in use: ' || names",
    )
    + " AS prompt FROM examples LEFT JOIN definitions USING (domain, topic) LEFT JOIN names USING (domain, topic)",
    "enrich_text": using("attributes")
    + """SELECT *, 'ok' AS rewrite_status, description || ' (checked)' AS processed_description FROM attributes""",
    "map_batches": using("docs") + "SELECT *, description || ' / ' || description AS mapped FROM docs",
    "generate_responses": using("needs15", plan=_PLAN)
    + "SELECT domain, topic, batch_id, 'Write 5 new attributes of the class ' || domain || ' / ' || topic || '.' AS response FROM plan",
}
