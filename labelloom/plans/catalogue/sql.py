"""Shared fragments of the oracle SQL: the same views and the same seeded hash, written for DuckDB."""

from __future__ import annotations

SEED = 42


def h(salt: str, *columns: str) -> str:
    parts = ", ".join([f"'{SEED}'", f"'{salt}'", *columns])
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT"


def u(salt: str, *columns: str) -> str:
    return f"({h(salt, *columns)}::DOUBLE / 4503599627370496.0::DOUBLE)"


VIEWS = {
    "attributes": """
        SELECT p_partkey AS row_id, p_name AS attribute_name,
               p_type || ' ' || p_name || ' size ' || p_size::VARCHAR AS description,
               p_brand AS domain, p_type AS topic
        FROM part""",
    "fine": """
        SELECT p_partkey AS row_id, p_name AS attribute_name,
               p_type || ' ' || p_name || ' size ' || p_size::VARCHAR AS description,
               p_brand AS domain, p_name || ' ' || p_size::VARCHAR AS topic
        FROM part""",
    "docs": """
        SELECT doc_id AS row_id, source AS attribute_name, text AS description, lang AS domain, source AS topic
        FROM documents""",
    "kept": """
        SELECT row_id, attribute_name, description, domain, topic FROM (
            SELECT *, row_number() OVER (PARTITION BY attribute_name, domain, topic ORDER BY row_id) AS rn
            FROM attributes) WHERE rn = 1""",
    "master": f"""
        SELECT attribute_name, CASE WHEN {h('master', 'attribute_name')} % 11 <> 0 THEN d END AS description
        FROM (SELECT attribute_name, min(description) AS d FROM attributes GROUP BY 1)
        WHERE {h('master', 'attribute_name')} % 7 <> 0""",
    "labelled": """
        SELECT t.row_id, t.attribute_name, m.description, t.domain, t.topic
        FROM attributes t JOIN master m USING (attribute_name)""",
    "complete": """
        SELECT * FROM labelled WHERE attribute_name IS NOT NULL AND description IS NOT NULL
        AND domain IS NOT NULL AND topic IS NOT NULL""",
    "vectors": """
        SELECT vec_id AS row_id, embedding::DOUBLE[] AS vector, (label % 2)::VARCHAR AS domain,
               label::VARCHAR AS topic
        FROM embeddings""",
    "decided": """
        SELECT row_id, CASE WHEN vector[4] > 0 THEN 'up' ELSE 'down' END AS domain,
               CASE WHEN vector[1] >= vector[2] AND vector[1] >= vector[3] THEN 'first' WHEN vector[2] >= vector[3] THEN 'second' ELSE 'third' END AS topic
        FROM vectors""",
    "centroids": """
        SELECT topic, list(x ORDER BY pos) AS vector FROM (
            SELECT topic, pos, avg(vector[pos]) AS x
            FROM vectors, range(1, 65) r(pos) GROUP BY topic, pos)
        GROUP BY topic""",
    "units": """
        SELECT *, [x / sqrt(list_dot_product(vector, vector)) FOR x IN vector] AS unit_vector FROM vectors""",
    "counts": "SELECT domain, topic, count(*) AS n FROM attributes GROUP BY 1, 2",
    "capped": f"""
        SELECT row_id, attribute_name, description, domain, topic FROM (
            SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY {h('cap', 'row_id')}, row_id) AS rn
            FROM attributes) WHERE rn <= 500""",
    "definitions": f"""
        SELECT domain, topic, 'Parts such as ' || min(description) AS definition
        FROM attributes GROUP BY 1, 2 HAVING {h('definition', 'domain', 'topic')} % 5 <> 0""",
    "split15": f"""
        SELECT row_id, attribute_name, description, domain, topic,
               CASE WHEN rn <= 15 THEN 'train' ELSE 'eval' END AS split FROM (
            SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY {h('cap', 'row_id')}, row_id) AS rn
            FROM attributes)""",
    "response_lines": f"""
        SELECT domain, topic, place, place // 5 + 1 AS batch_id, place % 5 AS line_no,
          CASE kind
            WHEN 0 THEN 'Sure, here is ' || snake
            WHEN 1 THEN '{{"attribute_name": "' || snake || '"}}'
            WHEN 2 THEN '{{"attribute_name": "' || upper(snake) || '", "description": "' || description || '"}}'
            WHEN 3 THEN '{{"attribute_name": "' || attribute_name || '", "description": "' || description || '"}}'
            ELSE '{{"attribute_name": "' || snake || '", "description": "new ' || description || '"}}' END AS line
        FROM (SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY row_id) - 1 AS place,
                     {h('response', 'row_id')} % 16 AS kind,
                     replace(attribute_name, ' ', '_') || '_' || (row_id % 50)::VARCHAR AS snake
              FROM attributes)""",
    "parsed": """
        SELECT domain, topic, batch_id, line_no, line ->> '$.attribute_name' AS attribute_name,
               line ->> '$.description' AS description
        FROM (SELECT * FROM response_lines WHERE json_valid(line))
        WHERE list_contains(json_keys(line), 'attribute_name') AND list_contains(json_keys(line), 'description')""",
    "strict": """
        SELECT domain, topic, batch_id, line_no, attribute_name, description FROM (
            SELECT *, count(*) OVER (PARTITION BY domain, topic, batch_id) AS c FROM parsed) WHERE c = 5""",
    "per_line": "SELECT * FROM parsed WHERE regexp_full_match(attribute_name, '[a-z][a-z0-9_]*')",
    "fresh_strict": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY attribute_name, description
                                         ORDER BY domain, topic, batch_id, line_no) AS rn FROM strict) s
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM attributes a
            WHERE a.attribute_name = s.attribute_name AND a.description = s.description)""",
    "fresh_line": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY domain, topic, attribute_name
                                         ORDER BY batch_id, line_no) AS rn FROM per_line) s
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM attributes a WHERE a.domain = s.domain
            AND a.topic = s.topic AND a.attribute_name = s.attribute_name)""",
    "needs15": "SELECT domain, topic, n, 15 - n AS need FROM counts WHERE n < 15",
    "accepted_strict": """
        SELECT * EXCLUDE (rn, need, n) FROM (
            SELECT f.*, row_number() OVER (PARTITION BY domain, topic ORDER BY batch_id, line_no) AS rn
            FROM fresh_strict f) JOIN needs15 USING (domain, topic) WHERE rn <= need""",
    "accepted_line": """
        SELECT * EXCLUDE (rn, need, n) FROM (
            SELECT f.*, row_number() OVER (PARTITION BY domain, topic ORDER BY batch_id, line_no) AS rn
            FROM fresh_line f) JOIN needs15 USING (domain, topic) WHERE rn <= need""",
    "balanced15": """
        SELECT attribute_name, description, domain, topic, split, 'original' AS origin FROM split15
        UNION ALL
        SELECT attribute_name, description, domain, topic, 'train', 'generated' FROM accepted_strict""",
    "predictions": f"""
        SELECT doc_id AS row_id, lang AS domain, source AS topic,
               CASE WHEN k % 5 = 0 THEN 'xx' WHEN k % 5 = 1 THEN 'en' ELSE lang END AS predicted_domain,
               CASE WHEN k % 7 = 0 THEN 'nowhere' WHEN k % 7 = 1 THEN source || 's' ELSE source END AS predicted_topic
        FROM (SELECT *, {h('prediction', 'doc_id')} AS k FROM documents)""",
    "levels": """
        SELECT 'domain' AS level, domain AS "true", predicted_domain AS predicted FROM predictions
        UNION ALL SELECT 'topic', topic, predicted_topic FROM predictions""",
    "positions": """
        SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY row_id) - 1 AS place,
               row_number() OVER (ORDER BY md5(domain), md5(topic), row_id) - 1 AS pos,
               count(*) OVER (PARTITION BY domain, topic) AS n
        FROM capped""",
    "positives": "SELECT sum(n - 1 - place)::BIGINT AS p FROM positions",
}

NEEDS = {
    "kept": ["attributes"], "master": ["attributes"], "labelled": ["attributes", "master"], "complete": ["labelled"],
    "centroids": ["vectors"], "decided": ["vectors"], "units": ["vectors"], "counts": ["attributes"], "capped": ["attributes"],
    "definitions": ["attributes"], "split15": ["attributes"], "response_lines": ["attributes"],
    "parsed": ["response_lines"], "strict": ["parsed"], "per_line": ["parsed"],
    "fresh_strict": ["strict", "attributes"], "fresh_line": ["per_line", "attributes"], "needs15": ["counts"],
    "accepted_strict": ["fresh_strict", "needs15"], "accepted_line": ["fresh_line", "needs15"],
    "balanced15": ["split15", "accepted_strict"], "levels": ["predictions"], "positions": ["capped"],
    "positives": ["positions"],
}


def using(*views: str, **extra: str) -> str:
    """A WITH clause of the named views, their requirements first, then the extra ones in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for view in views:
        add(view)
    parts = [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
