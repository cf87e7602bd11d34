"""The given tables seen as the engine's inputs. All views read whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import schema as S
from labelloom.functions.hashing import hash_int
from labelloom.functions.vectors import mean_vector


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled attributes: parts, with brand as domain and type as topic."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias(S.ROW_ID),
        F.col("p_name").alias(S.NAME),
        F.concat_ws(" ", "p_type", "p_name", F.lit("size"), F.col("p_size").cast("string")).alias(S.DESCRIPTION),
        F.col("p_brand").alias(S.DOMAIN),
        F.col("p_type").alias(S.TOPIC),
    )


def doc_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled long texts: documents, with language as domain and source as topic."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias(S.ROW_ID),
        F.col("source").alias(S.NAME),
        F.col("text").alias(S.DESCRIPTION),
        F.col("lang").alias(S.DOMAIN),
        F.col("source").alias(S.TOPIC),
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes(spark, sf_dir).select(S.ROW_ID, *S.TAXONOMY_COLUMNS)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition per name; every seventh name (by hash) is unknown, every eleventh has no text."""
    names = attributes(spark, sf_dir).groupBy(S.NAME).agg(F.min(S.DESCRIPTION).alias(S.DESCRIPTION))
    h = hash_int(S.SEED, "master", S.NAME)
    return names.filter(h % 7 != 0).select(
        S.NAME, F.when(h % 11 != 0, F.col(S.DESCRIPTION)).alias(S.DESCRIPTION)
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded rows: domain is the parity of the label, topic the label."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias(S.ROW_ID),
        F.col("embedding").cast("array<double>").alias("vector"),
        (F.col("label") % 2).cast("string").alias(S.DOMAIN),
        F.col("label").cast("string").alias(S.TOPIC),
    )


def decided_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded rows with labels that the vector decides: the axis, of the first three, that it is nearest to, and a sign."""
    x = lambda k: F.get("vector", F.lit(k))
    axis = F.when((x(0) >= x(1)) & (x(0) >= x(2)), "first").when(x(1) >= x(2), "second").otherwise("third")
    return vectors(spark, sf_dir).withColumns({S.DOMAIN: F.when(x(3) > 0, "up").otherwise("down"), S.TOPIC: axis})


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mean vector per topic: the templates of the vector queries."""
    return mean_vector(vectors(spark, sf_dir), [S.TOPIC], "vector")


def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded rows with a name and a text, for the text form of synthetic vectors."""
    rows = vectors(spark, sf_dir)
    number = F.col(S.ROW_ID).cast("string")
    return rows.select(
        S.ROW_ID,
        F.concat(F.lit("vec_"), number).alias(S.NAME),
        F.concat(F.lit("vector "), number, F.lit(" of topic "), F.col(S.TOPIC)).alias(S.DESCRIPTION),
        *S.CLASS,
        "vector",
    )


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition per class, except for every fifth class (by hash)."""
    classes = attributes(spark, sf_dir).groupBy(*S.CLASS).agg(F.min(S.DESCRIPTION).alias("__d"))
    return classes.filter(hash_int(S.SEED, "definition", *S.CLASS) % 5 != 0).select(
        *S.CLASS, F.concat(F.lit("Parts such as "), F.col("__d")).alias("definition")
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = attributes(spark, sf_dir).groupBy(*S.CLASS).agg(F.min(S.DESCRIPTION).alias("__d"))
    return classes.select(
        F.col(S.DOMAIN).alias("domain_name"), F.col(S.TOPIC).alias("topic_name"), F.col("__d").alias("topic_definition")
    )


def definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition text lines made from parts: good ones, comments, blanks, and malformed ones."""
    rows = attributes(spark, sf_dir)
    kind = hash_int(S.SEED, "line", S.ROW_ID) % 10
    good = F.concat(F.col(S.DOMAIN), F.lit(" | "), F.col(S.TOPIC), F.lit("|"), F.col(S.DESCRIPTION), F.lit(" "))
    value = (
        F.when(kind == 0, F.concat(F.lit("# "), F.col(S.NAME)))
        .when(kind == 1, F.lit("   "))
        .when(kind == 2, F.concat(F.col(S.DOMAIN), F.lit(" has no separator")))
        .otherwise(good)
    )
    return rows.select(F.col(S.ROW_ID).alias("line_no"), value.alias("value"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generator answers derived from parts: five JSON lines per batch of a class, some of them bad.

    One line in 16 each is not JSON, misses a key, or has a name that is not snake_case; one in 16
    repeats an original row.
    """
    rows = attributes(spark, sf_dir)
    kind = hash_int(S.SEED, "response", S.ROW_ID) % 16
    snake = F.concat(F.replace(F.col(S.NAME), F.lit(" "), F.lit("_")), F.lit("_"), (F.col(S.ROW_ID) % 50).cast("string"))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = (
        F.when(kind == 0, F.concat(F.lit("Sure, here is "), snake))
        .when(kind == 1, F.concat(F.lit('{"attribute_name": '), quote(snake), F.lit("}")))
        .when(
            kind == 2,
            F.concat(F.lit('{"attribute_name": '), quote(F.upper(snake)), F.lit(', "description": '), quote(F.col(S.DESCRIPTION)), F.lit("}")),
        )
        .when(
            kind == 3,
            F.concat(F.lit('{"attribute_name": '), quote(F.col(S.NAME)), F.lit(', "description": '), quote(F.col(S.DESCRIPTION)), F.lit("}")),
        )
        .otherwise(
            F.concat(F.lit('{"attribute_name": '), quote(snake), F.lit(', "description": '), quote(F.concat(F.lit("new "), F.col(S.DESCRIPTION))), F.lit("}"))
        )
    )
    from labelloom.functions.ranking import order_rank

    placed = order_rank(rows, S.CLASS, S.ROW_ID, out="place")
    return (
        placed.select(*S.CLASS, F.floor(F.col("place") / 5).cast("bigint").alias("__b"), "place", line.alias("line"))
        .groupBy(*S.CLASS, (F.col("__b") + 1).alias("batch_id"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda e: e["line"]), "\n").alias("response"))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a seeded stand-in prediction: right, neighbour's, or never-true labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    h = hash_int(S.SEED, "prediction", "doc_id")
    return docs.select(
        F.col("doc_id").alias(S.ROW_ID),
        F.col("lang").alias(S.DOMAIN),
        F.col("source").alias(S.TOPIC),
        F.when(h % 5 == 0, F.lit("xx")).when(h % 5 == 1, F.lit("en")).otherwise(F.col("lang")).alias("predicted_domain"),
        F.when(h % 7 == 0, F.lit("nowhere")).when(h % 7 == 1, F.concat(F.col("source"), F.lit("s"))).otherwise(F.col("source")).alias("predicted_topic"),
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment records derived from orders: one per customer, metric from the mean order price."""
    orders = table(spark, sf_dir, "orders")
    runs = orders.groupBy("o_custkey").agg(
        F.round(F.avg("o_totalprice") / 1000, 0).alias("__v"), F.count(F.lit(1)).alias("__n")
    )
    missing = F.col("o_custkey") % 10 == 3
    return runs.select(
        F.col("o_custkey").alias("seq"),
        F.concat(F.lit("model_"), F.col("o_custkey").cast("string")).alias("path"),
        F.when(missing, F.create_map(F.lit("runs"), F.col("__n").cast("double")))
        .otherwise(F.create_map(F.lit("domain_accuracy"), F.col("__v"), F.lit("runs"), F.col("__n").cast("double")))
        .alias("metrics"),
    )


def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A (phase, metric, epoch, value) history from events: one epoch per hundred events."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.when(F.col("user_id") % 5 == 0, "val").otherwise("train").alias("phase"),
        F.col("event_type").alias("metric"),
        F.floor(F.col("event_id") / 100).cast("bigint").alias("epoch"),
    ).agg(F.max("value").alias("value"))


def fine_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled attributes with many tiny classes: the topic is name and size."""
    return attributes(spark, sf_dir).withColumn(
        S.TOPIC, F.concat_ws(" ", S.NAME, F.element_at(F.split(S.DESCRIPTION, " "), -1))
    )


def text_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name: text`` inputs from conversation turns (role as name where the turn number is even)."""
    turns = table(spark, sf_dir, "conversations")
    spec = F.when(F.col("turn") % 2 == 0, F.concat(F.col("role"), F.lit(" : "), F.col("text"))).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", spec.alias("value"))
