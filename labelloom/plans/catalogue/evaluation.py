"""Metric and tracking queries."""

from __future__ import annotations

from labelloom.operators import evaluate, tracking
from labelloom.plans import views as V
from labelloom.plans.catalogue.sql import using

QUERIES = {
    "accuracy": lambda s, d: evaluate.accuracy(V.predictions(s, d)),
    "confusion": lambda s, d: evaluate.confusion(V.predictions(s, d)),
    "classification_report": lambda s, d: evaluate.classification_report(V.predictions(s, d)),
    "best_experiment": lambda s, d: tracking.best_experiment(V.experiments(s, d), "domain_accuracy"),
    "metric_history": lambda s, d: tracking.metric_last(V.metric_values(s, d)),
}

_SCORES = """
SELECT level, label, tp, support, called, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0::DOUBLE END AS f
FROM (SELECT *, CASE WHEN called > 0 THEN tp::DOUBLE / called::DOUBLE ELSE 0::DOUBLE END AS p,
                CASE WHEN support > 0 THEN tp::DOUBLE / support::DOUBLE ELSE 0::DOUBLE END AS r
      FROM (SELECT level, label, count(*) FILTER ("true" = label AND predicted = label) AS tp,
                   count(*) FILTER ("true" = label) AS support, count(*) FILTER (predicted = label) AS called
            FROM levels JOIN (SELECT level AS l, "true" AS label FROM levels UNION SELECT level, predicted FROM levels) x
            ON x.l = levels.level GROUP BY 1, 2))"""

ORACLES = {
    "accuracy": using("levels")
    + """SELECT level, count(*) AS rows, round(avg(CASE WHEN "true" = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
         FROM levels GROUP BY level""",
    "confusion": using("levels") + """SELECT level, "true", predicted, count(*) AS n FROM levels GROUP BY 1, 2, 3""",
    "classification_report": using("levels", scores=_SCORES)
    + """SELECT level, 'label' AS kind, label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM scores
         UNION ALL SELECT level, 'accuracy', NULL, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6),
           round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6), round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6), sum(support)::BIGINT
         FROM scores GROUP BY level
         UNION ALL SELECT level, 'macro avg', NULL, round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT
         FROM scores GROUP BY level
         UNION ALL SELECT level, 'weighted avg', NULL, round(sum(p * support) / sum(support)::DOUBLE, 6),
           round(sum(r * support) / sum(support)::DOUBLE, 6), round(sum(f * support) / sum(support)::DOUBLE, 6), sum(support)::BIGINT
         FROM scores GROUP BY level""",
    "best_experiment": """
        SELECT path, v AS value FROM (
          SELECT 'model_' || o_custkey::VARCHAR AS path, o_custkey,
                 CASE WHEN o_custkey % 10 = 3 THEN '-inf'::DOUBLE ELSE round(avg(o_totalprice) / 1000, 0) END AS v
          FROM orders GROUP BY o_custkey)
        ORDER BY v DESC, o_custkey LIMIT 1""",
    "metric_history": """
        SELECT phase, metric, max(epoch) AS epoch, arg_max(value, epoch) AS value, count(*) AS epochs FROM (
          SELECT CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS phase, event_type AS metric,
                 event_id // 100 AS epoch, max(value) AS value FROM events GROUP BY 1, 2, 3)
        GROUP BY 1, 2""",
}
