"""Column names, required sets and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

ROW_ID = "row_id"
NAME = "attribute_name"
DESCRIPTION = "description"
PROCESSED = "processed_description"
DOMAIN = "domain"
TOPIC = "topic"
CLASS = [DOMAIN, TOPIC]

LABELLED_COLUMNS = [NAME, DESCRIPTION, DOMAIN, TOPIC]
TRAINING_COLUMNS = [DESCRIPTION, DOMAIN, TOPIC]
DEDUP_COLUMNS = [NAME, DOMAIN, TOPIC]
TAXONOMY_COLUMNS = [NAME, DOMAIN, TOPIC]
MASTER_COLUMNS = [NAME, DESCRIPTION]
TEMPLATE_COLUMNS = ["domain_name", "topic_name", "topic_definition"]

LABELLED_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LABELLED_COLUMNS])
TEMPLATE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TEMPLATE_COLUMNS])
RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField(DOMAIN, T.StringType()),
        T.StructField(TOPIC, T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("response", T.StringType()),
    ]
)

# They must equal the published behaviour for results to match.
CLASS_CAP = 500
GENERATION_BATCH = 5
MASK_SHARES = (0.3, 0.3, 0.4)
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.1
SEED = 42
HARD_NEGATIVE_RATIO = 0.5
SAME_DOMAIN_SHARE = 0.7
OTHER_DOMAIN_SHARE = 0.3
TEXT_SIMILARITY = 0.8
TOPIC_SIMILARITY = 0.7
TEMPERATURE = 0.07
POSITIVES_PER_ANCHOR = 4
NEGATIVES_PER_ANCHOR = 8
TEMPLATE_TOP_K = 3
SNAKE_CASE = "^[a-z][a-z0-9_]*$"
REWRITE_PREFIX = "Standardized Description:"
TEMPLATE_TEXT = (
    "In the domain of {domain}, this attribute represents {topic} which is defined as {definition}"
)
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
