"""Planning, prompting and accepting externally generated rows.

The generator itself is a user function (see ``enrich.generate_responses``); its answers are a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom import schema as S
from labelloom.functions.hashing import hash_mod
from labelloom.functions.ranking import order_rank
from labelloom.functions.text import is_snake_case, strip
from labelloom.operators.balance import explode_copies
from labelloom.operators.prepare import with_definition
from labelloom.operators.profile import class_need, with_class
from labelloom.session import materialise

IDENTITY = [S.NAME, S.DESCRIPTION]
NAME_IN_CLASS = [S.DOMAIN, S.TOPIC, S.NAME]


def context_size(n: Column, fixed: int | None = None) -> Column:
    """Examples shown per prompt: by class size (1, 2, 3 or 6), or ``min(fixed, n)``."""
    if fixed is not None:
        return F.least(F.lit(fixed).cast("bigint"), n)
    # Steps of the class size.
    steps = F.when(n <= 1, 1).when(n <= 3, 2).when(n <= 10, 3).otherwise(6)
    return F.least(steps.cast("bigint"), n)


def plan_batches(
    df: DataFrame,
    cap: int = S.CLASS_CAP,
    batch_size: int = S.GENERATION_BATCH,
    *,
    fixed_context: int | None = None,
) -> DataFrame:
    """One row per generation request: ceil(need / batch_size) per short class."""
    needs = class_need(df, cap).filter("need > 0").drop("overflow")
    requests = explode_copies(needs, F.ceil(F.col("need") / F.lit(float(batch_size))), S.CLASS, "batch_id")
    return requests.select(
        *S.CLASS,
        "n",
        "need",
        (F.col("batch_id") + 1).alias("batch_id"),
        F.lit(batch_size).cast("bigint").alias("batch_size"),
        context_size(F.col("n"), fixed_context).alias("k"),
    )


def context_sample(
    df: DataFrame, plan: DataFrame, *, seed: int = S.SEED, id_col: str = S.ROW_ID
) -> DataFrame:
    """k different example rows of the class for each planned batch.

    Slot t takes a seeded place from the t-th of k equal strata of the class, so places never repeat
    and each is found by one equi-join on (class, place).
    """
    slots = plan.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    low = F.floor(F.col("slot") * F.col("n") / F.col("k"))
    high = F.floor((F.col("slot") + 1) * F.col("n") / F.col("k"))
    place = low + hash_mod(high - low, seed, "context", *S.CLASS, "batch_id", "slot")
    wanted = slots.select(*S.CLASS, "batch_id", "slot", place.cast("bigint").alias("place"))
    planned = materialise(plan.select(*S.CLASS).distinct())
    short = with_class(df).select(id_col, *S.LABELLED_COLUMNS).join(planned, S.CLASS, "left_semi")
    rows = order_rank(short, S.CLASS, id_col, out="place", bounds_from=df)
    return wanted.join(rows, [*S.CLASS, "place"]).drop("place")


def build_prompts(
    df: DataFrame,
    plan: DataFrame,
    *,
    definitions: DataFrame | None = None,
    used: DataFrame | None = None,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """One prompt per planned batch.

    A batch shows at most six examples. ``used`` (domain, topic, attribute_name) lists names to avoid;
    only classes below the cap are planned, so such a list is shorter than the cap.
    """
    plan = materialise(plan)
    examples = (
        context_sample(df, plan, seed=seed, id_col=id_col)
        .groupBy(*S.CLASS, "batch_id")
        .agg(F.array_sort(F.collect_list(F.struct("slot", S.NAME, S.DESCRIPTION))).alias("__examples"))
    )
    numbered = F.transform(
        F.col("__examples"),
        lambda e, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit(":\nAttribute: "), F.coalesce(e[S.NAME], F.lit("")),
            F.lit("\nDescription: "), F.coalesce(e[S.DESCRIPTION], F.lit("")),
        ),
    )
    rows = plan.join(examples, [*S.CLASS, "batch_id"]).withColumn("__context", F.array_join(numbered, "\n"))
    if definitions is not None:
        rows = with_definition(rows, definitions)
    else:
        rows = rows.withColumn("definition", F.lit(""))
    if used is not None:
        planned = plan.select(*S.CLASS).distinct()
        names = (
            used.select(*NAME_IN_CLASS).distinct().join(planned, S.CLASS, "left_semi")
            .groupBy(*S.CLASS)
            .agg(F.array_join(F.array_sort(F.collect_list(S.NAME)), ", ").alias("__names"))
        )
        rows = rows.join(names, S.CLASS, "left")
    else:
        rows = rows.withColumn("__names", F.lit(None).cast("string"))
    defined = F.when(F.col("definition") != "", F.concat(F.lit("\nDefinition: "), F.col("definition"))).otherwise("")
    avoid = F.when(F.col("__names").isNotNull(), F.concat(F.lit("\nNames already in use: "), F.col("__names"))).otherwise("")
    size = F.col("batch_size").cast("string")
    prompt = F.concat(
        F.lit("Write "), size, F.lit(" new attributes of the class "), F.col(S.DOMAIN), F.lit(" / "), F.col(S.TOPIC),
        F.lit("."), defined, avoid, F.lit("\n"), F.col("__context"),
        F.lit("\nUse snake_case names, clear descriptions, and repeat none of the names above.\nAnswer with "), size,
        F.lit(' lines of JSON only: {"attribute_name": "...", "description": "..."}'),
    )
    return rows.select(*S.CLASS, "batch_id", "batch_size", prompt.alias("prompt"))


def _json_objects(responses: DataFrame) -> DataFrame:
    """Non-blank response lines, numbered, with the two fields and whether both keys are present.

    A line counts only when it is one complete JSON object: it must also parse as the sole member of
    an array, which rules out trailing text.
    """
    lines = responses.select(
        *S.CLASS, "batch_id", F.posexplode(F.split(F.coalesce(F.col("response"), F.lit("")), "\n")).alias("line_no", "line")
    ).withColumn("line", strip(F.col("line")))
    wrapped = F.concat(F.lit("["), F.col("line"), F.lit("]"))
    keys = F.json_object_keys("line")
    sole = F.try_parse_json(wrapped).isNotNull() & (F.json_array_length(wrapped) == 1)
    both = sole & F.array_contains(keys, S.NAME) & F.array_contains(keys, S.DESCRIPTION)
    return lines.filter(F.col("line") != "").select(
        *S.CLASS,
        "batch_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.get_json_object("line", "$." + S.NAME).alias(S.NAME),
        F.get_json_object("line", "$." + S.DESCRIPTION).alias(S.DESCRIPTION),
        F.coalesce(both, F.lit(False)).alias("__both"),
    )


def parse_responses(
    responses: DataFrame, mode: str = "all_or_nothing", expected: int = S.GENERATION_BATCH
) -> DataFrame:
    """Valid generated rows with their batch and line.

    ``all_or_nothing``: a batch counts only when exactly ``expected`` of its lines carry both keys.
    ``per_line``: every line with both keys and a snake_case name counts.
    """
    rows = _json_objects(responses).filter("__both").drop("__both")
    if mode == "per_line":
        return rows.filter(F.coalesce(is_snake_case(F.col(S.NAME)), F.lit(False)))
    if mode != "all_or_nothing":
        raise ValueError(f"unknown mode: {mode}")
    batch = Window.partitionBy(*S.CLASS, "batch_id")
    return rows.withColumn("__valid", F.count(F.lit(1)).over(batch)).filter(F.col("__valid") == expected).drop("__valid")


def drop_used(candidates: DataFrame, used: DataFrame, identity: list[str]) -> DataFrame:
    """Candidates not yet used: repeats among themselves go (first batch and line stays), then an anti join.

    Nulls are equal in the identity, as for a set of tuples. The used table is first reduced to the
    identities that occur among the candidates: with few candidates Spark broadcasts them, and the
    large used table is only scanned.
    """
    first = Window.partitionBy(*identity).orderBy(*S.CLASS, "batch_id", "line_no")
    unique = materialise(
        candidates.withColumn("__rn", F.row_number().over(first)).filter("__rn <= 1").drop("__rn")
    )

    def same(left: str, right: str) -> Column:
        terms = [F.col(left + c).eqNullSafe(F.col(right + c)) for c in identity]
        return reduce(lambda a, b: a & b, terms)

    wanted = unique.select(*[F.col(c).alias(f"__w_{c}") for c in identity])
    taken = (
        used.select(*[F.col(c).alias(f"__u_{c}") for c in identity])
        .join(wanted, same("__u_", "__w_"), "left_semi")
        .distinct()
    )
    return unique.join(taken, same("", "__u_"), "left_anti")


def accept_generated(
    df: DataFrame,
    responses: DataFrame,
    *,
    cap: int = S.CLASS_CAP,
    mode: str = "all_or_nothing",
    batch_size: int = S.GENERATION_BATCH,
) -> DataFrame:
    """Validated, unused generated rows: the first ``need`` of each short class.

    Uniqueness is by (name, description) over everything in ``all_or_nothing`` mode, by name within
    the class in ``per_line`` mode. All originals count as used from the start.
    """
    identity = IDENTITY if mode == "all_or_nothing" else NAME_IN_CLASS
    fresh = drop_used(parse_responses(responses, mode, batch_size), df, identity)
    needs = class_need(df, cap).filter("need > 0").select(*S.CLASS, "need")
    place = Window.partitionBy(*S.CLASS).orderBy("batch_id", "line_no")
    # need never exceeds the cap, so the literal bound loses nothing and prunes on the map side
    return (
        fresh.withColumn("__rn", F.row_number().over(place))
        .filter(F.col("__rn") <= cap)
        .join(needs, S.CLASS)
        .filter(F.col("__rn") <= F.col("need"))
        .select(*S.LABELLED_COLUMNS, "batch_id", "line_no")
    )


def generation_stats(
    df: DataFrame,
    responses: DataFrame,
    *,
    cap: int = S.CLASS_CAP,
    mode: str = "all_or_nothing",
    batch_size: int = S.GENERATION_BATCH,
) -> DataFrame:
    """Per short class: sizes, accepted rows, batch outcomes, duplicates avoided, shortfall."""
    identity = IDENTITY if mode == "all_or_nothing" else NAME_IN_CLASS
    valid = materialise(parse_responses(responses, mode, batch_size))
    fresh = materialise(drop_used(valid, df, identity))
    per_batch_valid = valid.groupBy(*S.CLASS, "batch_id").agg(F.count(F.lit(1)).alias("valid"))
    per_batch_fresh = fresh.groupBy(*S.CLASS, "batch_id").agg(F.count(F.lit(1)).alias("fresh"))
    batches = (
        responses.select(*S.CLASS, "batch_id").distinct()
        .join(per_batch_valid, [*S.CLASS, "batch_id"], "left")
        .join(per_batch_fresh, [*S.CLASS, "batch_id"], "left")
        .groupBy(*S.CLASS)
        .agg(
            F.count(F.when(F.col("fresh") > 0, 1)).alias("ok_batches"),
            F.count(F.when(F.coalesce(F.col("fresh"), F.lit(0)) == 0, 1)).alias("failed_batches"),
            F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"),
            F.coalesce(F.sum("fresh"), F.lit(0)).alias("fresh"),
        )
    )
    zero = F.lit(0).cast("bigint")
    stats = class_need(df, cap).filter("need > 0").drop("overflow").join(batches, S.CLASS, "left")
    tried = F.coalesce(F.col("ok_batches"), zero) + F.coalesce(F.col("failed_batches"), zero)
    made = F.least(F.coalesce(F.col("fresh"), zero), F.col("need"))
    return stats.select(
        *S.CLASS,
        F.col("n").alias("original"),
        F.col("need").alias("needed"),
        made.alias("generated"),
        F.coalesce(F.col("ok_batches"), zero).alias("ok_batches"),
        F.coalesce(F.col("failed_batches"), zero).alias("failed_batches"),
        (F.coalesce(F.col("valid"), zero) - F.coalesce(F.col("fresh"), zero)).alias("duplicates_avoided"),
        F.round(F.when(tried > 0, F.col("ok_batches") * 100.0 / tried).otherwise(0.0), 6).alias("success_pct"),
        (F.col("need") - made).alias("shortfall"),
    )
