"""Label distributions, cardinalities and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom import schema as S
from labelloom.session import materialise


def with_class(df: DataFrame) -> DataFrame:
    """Rows whose class is known: grouping by class drops null labels."""
    return df.filter(F.col(S.DOMAIN).isNotNull() & F.col(S.TOPIC).isNotNull())


def class_counts(df: DataFrame) -> DataFrame:
    return with_class(df).groupBy(*S.CLASS).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame) -> DataFrame:
    """Per class: domain count and share of all rows, topic count and share of its domain.

    The rows are read once, into partial counts; the class table is written, because the total and
    the shares both read it. Rows without a topic count for their domain, rows without a domain
    only for the total.
    """
    counts = materialise(df.groupBy(*S.CLASS).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    by_domain = Window.partitionBy(S.DOMAIN)
    return (
        counts.withColumn("domain_count", F.sum("n").over(by_domain))
        .filter(F.col(S.DOMAIN).isNotNull() & F.col(S.TOPIC).isNotNull())
        .select(
            S.DOMAIN,
            "domain_count",
            F.round(F.col("domain_count") * 100.0 / total, 6).alias("domain_pct"),
            S.TOPIC,
            F.col("n").alias("topic_count"),
            F.round(F.col("n") * 100.0 / F.col("domain_count"), 6).alias("topic_pct"),
        )
    )


def ordered_report(distribution_df: DataFrame) -> DataFrame:
    """Report order: biggest domain first, then biggest topic, names on ties."""
    return distribution_df.orderBy(
        F.desc("domain_count"), S.DOMAIN, F.desc("topic_count"), S.TOPIC
    )


def domain_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows per domain before and after a step."""
    tagged = [
        d.filter(F.col(S.DOMAIN).isNotNull()).select(F.lit(phase).alias("phase"), S.DOMAIN)
        for phase, d in (("before", before), ("after", after))
    ]
    return tagged[0].unionByName(tagged[1]).groupBy("phase", S.DOMAIN).agg(F.count(F.lit(1)).alias("n"))


def topic_share(df: DataFrame) -> DataFrame:
    """Share of each topic within its domain."""
    return distribution(df).select(
        S.DOMAIN, S.TOPIC, F.col("topic_count").alias("n"), F.col("topic_pct").alias("pct")
    )


def cardinalities(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Total rows, distinct domains, topics and classes in one row.

    The exact form first reduces rows to classes with a combinable count, so the distinct counts
    only see the class table.
    """
    if approximate:
        return df.agg(
            F.count(F.lit(1)).alias("total"),
            F.approx_count_distinct(S.DOMAIN).alias("domains"),
            F.approx_count_distinct(S.TOPIC).alias("topics"),
            F.approx_count_distinct(
                F.when(F.col(S.DOMAIN).isNotNull() & F.col(S.TOPIC).isNotNull(), F.struct(*S.CLASS))
            ).alias("classes"),
        )
    counts = df.groupBy(*S.CLASS).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(S.DOMAIN).isNotNull() & F.col(S.TOPIC).isNotNull()
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
        F.countDistinct(S.DOMAIN).alias("domains"),
        F.countDistinct(S.TOPIC).alias("topics"),
        F.count(F.when(known, F.lit(1))).alias("classes"),
    )


SKETCH_BITS = 12  # a sketch has 2**SKETCH_BITS registers; its standard error is about 1.04 / sqrt of that
SKETCHED = ["domains", "topics", "classes"]


def cardinality_sketches(df: DataFrame, keys: list[str] | None = None, *, bits: int = SKETCH_BITS) -> DataFrame:
    """Per ``keys`` (a chunk): ``total`` rows, and mergeable sketches of the different domains, topics and classes.

    A sketch is a few kilobytes whatever the rows, so sketches are kept beside the chunks, and united without reading them again.
    """
    known = F.col(S.DOMAIN).isNotNull() & F.col(S.TOPIC).isNotNull()
    # the length of the first part tells equal joined texts of different classes apart
    pair = F.when(known, F.concat_ws("|", F.length(S.DOMAIN), S.DOMAIN, S.TOPIC))
    values = {"domains": F.col(S.DOMAIN), "topics": F.col(S.TOPIC), "classes": pair}
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("total"), *[F.hll_sketch_agg(v, bits).alias(c) for c, v in values.items()])


def united_cardinalities(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``cardinalities`` of all rows behind the sketches (per ``keys``): total exactly, the others as estimates."""
    united = sketches.groupBy(*(keys or [])).agg(F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"), *[F.hll_union_agg(c).alias(c) for c in SKETCHED])
    return united.select(*(keys or []), "total", *[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).cast("bigint").alias(c) for c in SKETCHED])


def target_size(df: DataFrame) -> DataFrame:
    """Size of the largest class, as a one-row frame."""
    return class_counts(df).agg(F.max("n").alias("target"))


def class_need(df: DataFrame, cap: int = S.CLASS_CAP) -> DataFrame:
    """Per class: rows missing up to the cap, and rows beyond it."""
    return class_counts(df).select(
        *S.CLASS,
        "n",
        F.greatest(F.lit(cap) - F.col("n"), F.lit(0)).cast("bigint").alias("need"),
        F.greatest(F.col("n") - F.lit(cap), F.lit(0)).cast("bigint").alias("overflow"),
    )


def label_stats(df: DataFrame) -> DataFrame:
    """Number of labels, number of attributes, and attributes per label (long form)."""
    counts = materialise(class_counts(df))
    totals = counts.agg(
        F.count(F.lit(1)).alias("total_labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_attributes")
    )
    per_label = counts.select(F.lit("attributes_per_label").alias("stat"), *S.CLASS, F.col("n").alias("value"))
    overall = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("total_labels").alias("stat"), F.col("total_labels").alias("value")),
                F.struct(F.lit("total_attributes").alias("stat"), F.col("total_attributes").alias("value")),
            )
        ).alias("e")
    ).select(
        "e.stat", F.lit(None).cast("string").alias(S.DOMAIN), F.lit(None).cast("string").alias(S.TOPIC), "e.value"
    )
    return overall.unionByName(per_label)


def phase_counts(phases: dict[str, DataFrame]) -> DataFrame:
    """Class counts of several phases in one table (the statistics sink)."""
    tagged = [class_counts(d).withColumn("phase", F.lit(name)) for name, d in phases.items()]
    return reduce(DataFrame.unionByName, tagged)


def texts_by_class(df: DataFrame) -> DataFrame:
    """Rows of each class numbered from 0: the indexed form of a label -> texts map.

    A class stays many rows, because a list per class would put a whole class into one record.
    """
    from labelloom.functions.ranking import order_rank
    from labelloom.functions.text import effective_text

    rows = with_class(df).select(S.ROW_ID, *S.CLASS, effective_text(df).alias("text"))
    return order_rank(rows, S.CLASS, S.ROW_ID, out="text_no", size_out="n")


def _balance_counts(split: DataFrame) -> DataFrame:
    return split.groupBy(*S.CLASS).agg(
        F.count(F.when(F.col("origin") == "original", 1)).alias("original"),
        F.count(F.when(F.col("split") == "train", 1)).alias("training"),
        F.count(F.when(F.col("split") == "eval", 1)).alias("evaluation"),
    )


def _balance_totals(counts: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    sums = counts.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("original", "training", "evaluation")])
    return sums.withColumn("generated", F.col("training") - (F.col("original") - F.col("evaluation")))


def balance_summary(split: DataFrame) -> DataFrame:
    """Original, training, evaluation and generated rows of a balanced set (one row).

    Expects the ``split`` and ``origin`` columns of ``balance``.
    """
    return _balance_totals(_balance_counts(split))


def balance_report(split: DataFrame) -> DataFrame:
    """Totals and class distributions as (section, domain, topic, metric, value) rows."""
    counts = materialise(_balance_counts(split))

    def long(df: DataFrame, section: str, metrics: tuple[str, ...]) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return df.select(F.lit(section).alias("section"), *S.CLASS, F.explode(F.array(*cells)).alias("e")).select(
            "section", *S.CLASS, "e.metric", "e.value"
        )

    none = F.lit(None).cast("string")
    totals = _balance_totals(counts).withColumns({S.DOMAIN: none, S.TOPIC: none})
    metrics = ("original", "training", "evaluation")
    return long(totals, "totals", (*metrics, "generated")).unionByName(long(counts, "classes", metrics))
