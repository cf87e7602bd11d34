"""Contrastive pairs and tuples.

The set of all pairs of a table is quadratic, so it is never built in order to sample from it. Rows get
a position in class order; then the pairs of each row are a range of later positions, whose size is
known. Draws pick places in these ranges, evenly over all pairs and without repetition, and are
resolved by an equi-join on the position.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom import schema as S
from labelloom.functions.hashing import hash_constant, hash_int, hash_mod
from labelloom.functions.joins import as_of_join
from labelloom.functions.ranking import bucket_count, first_candidates, hash_rank, hex_bucket, order_rank, running_total, sample_n
from labelloom.functions.text import effective_text
from labelloom.functions.vectors import dot
from labelloom.operators.profile import class_counts, with_class
from labelloom.session import materialise

PAIR_BLOCK = 512  # places of a class in one block
HARD_BLOCK = 512  # topics of one side in one group
WIDE = "decimal(38,0)"  # numbers of pairs outgrow a bigint


def _whole_div(a: Column, b: Column) -> Column:
    """Floor of a / b for non-negative whole decimals, without rounding."""
    return ((a - a % b) / b).cast(WIDE)


def pair_classes(df: DataFrame) -> DataFrame:
    """Class table: rows before each class and after its domain, and later rows to pair with.

    Classes are ordered by the md5 of domain and topic, which keeps the classes of a domain together
    and gives the running sums even buckets.
    """
    counts = materialise(class_counts(df)).withColumns({"__d": F.md5(S.DOMAIN), "__c": F.md5(S.TOPIC)})
    domains = counts.groupBy(S.DOMAIN, "__d").agg(F.sum("n").alias("__size"))
    placed = running_total(domains, [], hex_bucket("__d"), ["__d"], "__size", out="__first").select(
        S.DOMAIN, "__first", (F.col("__first") + F.col("__size")).alias("domain_end")
    )
    inside = running_total(counts, [S.DOMAIN], hex_bucket("__c"), ["__c"], "n", out="__inside")
    total = counts.agg(F.sum("n")).scalar()
    start = F.col("__first") + F.col("__inside")
    return inside.join(placed, S.DOMAIN).select(
        *S.CLASS,
        "n",
        start.alias("start"),
        "domain_end",
        (total - start - F.col("n")).alias("later_all"),
        (F.col("domain_end") - start - F.col("n")).alias("later_same"),
    )


def _with_other(classes: DataFrame) -> DataFrame:
    """Adds ``later_other`` (rows of later domains with another topic) and ``skipped``: rows of the topic up to the class's domain.

    Both come from a running sum over the classes of a topic, so a topic may recur in any number of domains.
    """
    before = running_total(classes, [S.TOPIC], _class_bucket(), ["start"], "n", out="__before").withColumn("skipped", F.col("__before") + F.col("n"))
    sums = materialise(classes.groupBy(S.TOPIC).agg(F.sum("n").alias("__topic")))
    total = classes.agg(F.sum("n")).scalar()
    later = total - F.col("domain_end") - (F.col("__topic") - F.col("skipped"))
    return before.join(sums, S.TOPIC).withColumn("later_other", later).drop("__topic", "__before")


def _past_own_topic(drawn: DataFrame, classes: DataFrame) -> DataFrame:
    """``pos`` of each draw: place number ``offset`` after its domain, rows of its own topic not counted.

    Without the rows of a topic, positions close up: a class of the topic that starts at s with c rows of the topic before it lies at s - c.
    So the last such class at or below the closed-up place tells how many rows to step over: one as-of join per topic.
    """
    marks = classes.select(S.TOPIC, (F.col("start") + F.col("n") - F.col("skipped")).alias("__place"), F.col("skipped").alias("__over"))
    placed = drawn.withColumn("__place", F.col("domain_end") - F.col("skipped") + F.col("offset"))
    found = as_of_join(placed, marks, S.TOPIC, "__place", "__over")
    return found.withColumn("pos", F.col("__place") + F.coalesce("__over", F.lit(0))).drop("__place", "__over")


@dataclass
class PairSpace:
    """A table laid out for pair draws: its class table, and its rows with their positions.

    Both are written once; draws read them several times.
    """

    classes: DataFrame
    rows: DataFrame


def pair_space(df: DataFrame, id_col: str = S.ROW_ID) -> PairSpace:
    """Rows: (id, domain, topic, place in class, position in class order)."""
    classes = materialise(pair_classes(df))
    placed = order_rank(with_class(df).select(id_col, *S.CLASS), S.CLASS, id_col, out="place", bounds_from=df)
    starts = classes.select(*S.CLASS, "start")
    rows = placed.join(starts, S.CLASS).withColumn("pos", F.col("start") + F.col("place")).drop("start")
    return PairSpace(classes, materialise(rows))


def positive_pair_runs(df: DataFrame, id_col: str = S.ROW_ID) -> DataFrame:
    """All positive pairs in linear space: each row with the run of later places it pairs with.

    The pairs of a row are its class mates at places ``first`` to ``last``; ``pairs`` is their number.
    """
    rows = order_rank(with_class(df).select(id_col, *S.CLASS), S.CLASS, id_col, out="place", size_out="n")
    return rows.select(
        id_col,
        *S.CLASS,
        "place",
        (F.col("place") + 1).alias("first"),
        (F.col("n") - 1).alias("last"),
        (F.col("n") - 1 - F.col("place")).alias("pairs"),
    )


def positive_total(df: DataFrame) -> DataFrame:
    """Number of positive pairs, from the class sizes alone (one row)."""
    return _positive_total(class_counts(df))


def _positive_total(classes: DataFrame) -> DataFrame:
    n = F.col("n").cast(WIDE)
    return classes.agg(
        F.coalesce(F.sum(_whole_div(n * (n - 1), F.lit(2).cast(WIDE))), F.lit(0)).cast(WIDE).alias("pairs")
    )


def drawn_positive_pairs(
    df: DataFrame | PairSpace, n_pairs: int, *, seed: int = S.SEED, id_col: str = S.ROW_ID
) -> DataFrame:
    """Exactly ``n_pairs`` different pairs of one class (fewer only if fewer exist), label 1.0.

    Evenly over all positive pairs of the table, by the same place arithmetic as the negatives: the work
    follows the rows and ``n_pairs``, not the number of pairs.
    """
    space = df if isinstance(df, PairSpace) else pair_space(df, id_col)
    n = F.col("n").cast(WIDE)
    weighted = space.classes.withColumn("__w", _whole_div(n * (n - 1), F.lit(2).cast(WIDE)))
    table = materialise(running_total(weighted, [], _class_bucket(), ["start"], "__w", out="__before"))
    everything = table.agg(F.sum("__w").cast(WIDE)).scalar()
    place = F.col("place").cast(WIDE)
    anchors = space.rows.join(table.select(*S.CLASS, "n", "__before"), S.CLASS).withColumn("later", F.col("n") - 1 - F.col("place"))
    base = F.col("__before") + place * (n - 1) - _whole_div(place * (place - 1), F.lit(2).cast(WIDE))
    drawn = _draws(anchors, "later", base, F.lit(n_pairs), everything, seed, "positive_pairs", id_col)
    left = drawn.select(F.col(id_col).alias("id1"), *S.CLASS, (F.col("pos") + 1 + F.col("offset")).alias("pos"))
    right = space.rows.select("pos", F.col(id_col).alias("id2"))
    return left.join(right, "pos").select("id1", "id2", *S.CLASS, F.lit(1.0).alias("label"))


def _class_bucket() -> Column:
    """Monotone bucket of a class along the position order."""
    return F.floor(F.col("start").cast("double") / (F.col("later_all") + F.col("start") + F.col("n")) * 4096)


def positive_pairs(df: DataFrame, id_col: str = S.ROW_ID) -> DataFrame:
    """Every unordered pair of one class, once, label 1.0.

    Meant for a capped set (``cap_split``), where a row has fewer partners than the cap. Classes are cut into blocks of
    places; a row is sent once for every pair of blocks that it is in, and pairs are made where two blocks meet. So the work follows
    the number of pairs, not the class, and neither side is ever broadcast. For a table with unbounded classes keep the runs, or draw from them.
    """
    runs = positive_pair_runs(df, id_col)
    block = lambda place: F.floor(F.col(place) / F.lit(PAIR_BLOCK)).cast("bigint")
    cell, tasks = [*S.CLASS, "__mate_block", "__block"], bucket_count(df)
    first = runs.filter("pairs > 0").select(
        F.col(id_col).alias("id1"), *S.CLASS, "place", block("place").alias("__block"), F.explode(F.sequence(block("place"), block("last"))).alias("__mate_block")
    )
    second = runs.select(
        F.col(id_col).alias("id2"), *S.CLASS, F.col("place").alias("__mate"), block("place").alias("__mate_block"), F.explode(F.sequence(F.lit(0).cast("bigint"), block("place"))).alias("__block")
    )
    # a fixed number of tasks: the few rows that go in become many pairs
    return (
        first.repartition(tasks, *cell)
        .join(second.repartition(tasks, *cell).hint("merge"), cell)
        .filter(F.col("place") < F.col("__mate"))
        .select("id1", "id2", *S.CLASS, F.lit(1.0).alias("label"))
    )


def _spread(df: DataFrame, id_col: str) -> DataFrame:
    """Narrow rows over all tasks, before each of them grows into many pairs."""
    return df.repartition(bucket_count(df), id_col)


def _draws(anchors: DataFrame, partners: str, base: Column, n_pairs: Column, total: Column, seed: int, salt: str, id_col: str) -> DataFrame:
    """Spread exactly ``min(n_pairs, total)`` draws evenly over the pair ranges of the anchors.

    ``base`` is the number of pairs of all earlier anchors. An anchor with m partners gets
    floor((N(base+m) + u)/M) - floor((N base + u)/M) draws, which sums to N; u is drawn from [0, M) by the
    seed, so every pair is equally likely over the seeds. Draw t falls into the t-th of its equal strata,
    so no partner repeats. Adds ``slot`` and ``offset`` (the drawn partner's number).
    """
    total = total.cast(WIDE)
    start = (F.lit(Decimal(hash_constant(seed, salt))).cast(WIDE) % total).cast(WIDE)
    wide = anchors.withColumn("__m", F.col(partners).cast(WIDE)).withColumn("__base", base.cast(WIDE))
    limit = F.least(n_pairs.cast(WIDE), total)
    share = lambda upto: _whole_div(upto * limit + start, total)
    m = F.col(partners)
    return (
        _spread(wide.filter(m > 0), id_col)
        .withColumn("__q", (share((F.col("__base") + F.col("__m")).cast(WIDE)) - share(F.col("__base"))).cast("bigint"))
        .filter("__q > 0")
        .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__q") - 1)))
        .withColumn("__low", F.expr(f"slot * {partners} div __q"))
        .withColumn("__high", F.expr(f"(slot + 1) * {partners} div __q"))
        .withColumn("offset", F.col("__low") + hash_mod(F.col("__high") - F.col("__low"), seed, salt, id_col, "slot"))
        .drop("__m", "__base", "__q", "__low", "__high")
    )


def negative_pairs(
    df: DataFrame | PairSpace,
    n_pairs: int | None = None,
    *,
    strategy: str = "all",
    share: float = 1.0,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """Exactly ``n_pairs`` different negative pairs, label 0.0 (default: as many as positive pairs).

    ``all``: domain or topic differs. ``same``: same domain, other topic. ``other``: other domain
    and other topic. ``share`` scales the number (rounded down). Fewer come back only when fewer
    exist. Every row costs the same arithmetic, whatever the size of its class.
    """
    column = {"all": "later_all", "same": "later_same", "other": "later_other"}[strategy]
    space = df if isinstance(df, PairSpace) else pair_space(df, id_col)
    classes, rows = space.classes, space.rows
    m = F.col(column).cast(WIDE)
    if strategy == "other":
        classes = materialise(_with_other(classes))
    # pairs that start in a class; positions are in class order, so the start orders the classes
    weighted = classes.withColumn("__w", (F.col("n").cast(WIDE) * m).cast(WIDE))
    table = materialise(running_total(weighted, [], _class_bucket(), ["start"], "__w", out="__before"))
    everything = table.agg(F.sum("__w").cast(WIDE)).scalar()
    if n_pairs is None:
        wanted = _positive_total(classes).scalar()
        scaled = wanted if share == 1.0 else F.floor(wanted.cast("double") * F.lit(share))
    else:
        scaled = F.lit(n_pairs) if share == 1.0 else F.lit(int(n_pairs * share))
    facts = ["n", "start", column, "__before", *(["domain_end", "skipped"] if strategy == "other" else [])]
    anchors = rows.join(table.select(*S.CLASS, *facts), S.CLASS)
    base = F.col("__before") + (F.col("place").cast(WIDE) * m)
    drawn = _draws(anchors, column, base, scaled, everything, seed, "negative_" + strategy, id_col)
    if strategy == "other":
        drawn = _past_own_topic(drawn, classes)
    else:
        drawn = drawn.withColumn("pos", F.col("start") + F.col("n") + F.col("offset"))
    left = drawn.select(
        F.col(id_col).alias("id1"), F.col(S.DOMAIN).alias("domain1"), F.col(S.TOPIC).alias("topic1"), "pos"
    )
    right = rows.select(
        "pos", F.col(id_col).alias("id2"), F.col(S.DOMAIN).alias("domain2"), F.col(S.TOPIC).alias("topic2")
    )
    return left.join(right, "pos").select(
        "id1", "id2", "domain1", "topic1", "domain2", "topic2", F.lit(0.0).alias("label")
    )


def hard_negative_tasks(
    df: DataFrame, ratio: float = S.HARD_NEGATIVE_RATIO, *, seed: int = S.SEED, id_col: str = S.ROW_ID, block: int = HARD_BLOCK
) -> DataFrame:
    """Rows dealt to (domain, rank, a, b): blocks a and b of the topics that have a row of that rank, ``first`` for those of a.

    Rows get a seeded rank in their class; the first floor(ratio * size) of a class take part. A (domain, rank) holds at most one
    row a topic; with more than ``block`` topics they are cut into blocks, and each pair of blocks is a group of its own. So a group
    holds about ``block`` rows of each side, however many topics a domain has.
    """
    ranked = hash_rank(
        with_class(df).select(id_col, *S.CLASS), S.CLASS, seed=seed, salt="hard", id_col=id_col, out="rank", size_out="n"
    ).filter(F.col("rank") < F.floor(F.col("n") * F.lit(ratio)))
    ranked = materialise(ranked.drop("n"))  # read for the sizes and the pairs
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int")
    sizes = materialise(ranked.groupBy(S.DOMAIN, "rank").agg(blocks.alias("__blocks"), F.count(F.lit(1)).alias("__topics")))
    own = hash_mod(F.col("__blocks"), seed, "hard_block", S.TOPIC).cast("int")
    placed = ranked.join(sizes.filter("__topics > 1"), [S.DOMAIN, "rank"]).withColumn("__own", own)
    task = lambda a, b, first: F.struct(a.alias("a"), b.alias("b"), F.lit(first).alias("first"))
    mine, zero = F.col("__own"), F.lit(0)
    tasks = F.concat(
        F.transform(F.sequence(mine, F.col("__blocks") - 1), lambda x: task(mine, x, True)),
        F.transform(F.sequence(zero, mine), lambda x: task(x, mine, False)),
    )
    return placed.select(id_col, *S.CLASS, "rank", F.explode(tasks).alias("t")).select(id_col, *S.CLASS, "rank", "t.a", "t.b", "t.first")


def hard_negative_pairs(
    df: DataFrame, ratio: float = S.HARD_NEGATIVE_RATIO, *, seed: int = S.SEED, id_col: str = S.ROW_ID, block: int = HARD_BLOCK
) -> DataFrame:
    """For each two topics of a domain, floor(ratio * smaller size) pairs across them.

    Rows of equal seeded rank in their classes are pairs; they meet in groups of bounded size (``hard_negative_tasks``).
    """
    dealt = hard_negative_tasks(df, ratio, seed=seed, id_col=id_col, block=block)
    keys = [S.DOMAIN, "rank", "a", "b"]
    left = dealt.filter("first").select(*keys, F.struct(F.col(S.TOPIC).alias("topic"), F.col(id_col).alias("id")).alias("x"))
    right = dealt.filter("not first").select(*keys, F.struct(F.col(S.TOPIC).alias("topic"), F.col(id_col).alias("id")).alias("y"))
    # in a block with itself each pair is met from both sides; blocks apart meet once
    met = left.join(right, keys).filter((F.col("a") < F.col("b")) | (F.col("x.topic") < F.col("y.topic")))
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return met.select(low["id"].alias("id1"), high["id"].alias("id2"), S.DOMAIN, low["topic"].alias("topic1"), high["topic"].alias("topic2"), F.lit(0.0).alias("label"))


def hard_negative_total(df: DataFrame, ratio: float = S.HARD_NEGATIVE_RATIO) -> DataFrame:
    """``n_pairs`` of ``hard_negative_pairs``, from class sizes alone (one row).

    Two topics have as many pairs as the smaller share of the two. So with the topics of a domain by falling share, each adds its share once for
    every topic before it; topics of equal share are one row.
    """
    share = F.floor(F.col("n") * F.lit(ratio)).cast(WIDE)
    sizes = class_counts(df).select(S.DOMAIN, share.alias("m")).filter("m > 0").groupBy(S.DOMAIN, "m").agg(F.count(F.lit(1)).cast(WIDE).alias("c"))
    larger = F.sum("c").over(Window.partitionBy(S.DOMAIN).orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    inside = _whole_div(F.col("c") * (F.col("c") - 1), F.lit(2).cast(WIDE))
    counted = sizes.withColumn("__pairs", F.col("m") * (F.col("c") * larger + inside))
    return counted.agg(F.coalesce(F.sum("__pairs"), F.lit(0)).cast("bigint").alias("n_pairs"))


def domain_mix_negatives(
    df: DataFrame,
    n_pairs: int | None = None,
    *,
    same_share: float = S.SAME_DOMAIN_SHARE,
    other_share: float = S.OTHER_DOMAIN_SHARE,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """Negatives with another topic: 70 % within the domain, 30 % across domains (of the positives)."""
    space = pair_space(df, id_col)
    same = negative_pairs(space, n_pairs, strategy="same", share=same_share, seed=seed, id_col=id_col)
    other = negative_pairs(space, n_pairs, strategy="other", share=other_share, seed=seed, id_col=id_col)
    return same.withColumn("kind", F.lit("same_domain")).unionByName(other.withColumn("kind", F.lit("other_domain")))


def mix_similar_negatives(
    topic_pairs: DataFrame, text_pairs: DataFrame, total: Column | int, *, seed: int = S.SEED
) -> DataFrame:
    """Up to total // 2 pairs of similar topics, then pairs of similar texts up to the total.

    The tasks that find the pairs keep only those that the quota can still take, so neither set of pairs is written whole.
    """
    limit = F.lit(total).cast("bigint") if isinstance(total, int) else total.cast("bigint")
    keyed = lambda d: d.select("id1", "id2", F.concat_ws("|", "id1", "id2").alias("__pair"))
    half = F.floor(limit / 2)
    quota = lambda d, n, salt: materialise(first_candidates(keyed(d), n, id_col="__pair", seed=seed, salt=salt))
    topic_pairs, text_pairs = quota(topic_pairs, half, "mix_topic"), quota(text_pairs, limit, "mix_text")
    by_topic = sample_n(topic_pairs, half, id_col="__pair", seed=seed, salt="mix_topic")
    taken = F.least(half, topic_pairs.agg(F.count(F.lit(1))).scalar())
    by_text = sample_n(text_pairs, limit - taken, id_col="__pair", seed=seed, salt="mix_text")
    tag = lambda d, kind: d.select("id1", "id2", F.lit(kind).alias("kind"), F.lit(0.0).alias("label"))
    return tag(by_topic, "topic").unionByName(tag(by_text, "text"))


def with_texts(pairs: DataFrame, df: DataFrame, id_col: str = S.ROW_ID) -> DataFrame:
    """Add ``text1`` and ``text2``; texts are joined last, so they never travel through a pair join."""
    texts = df.select(F.col(id_col).alias("__id"), effective_text(df).alias("__text"))
    first = texts.select(F.col("__id").alias("id1"), F.col("__text").alias("text1"))
    second = texts.select(F.col("__id").alias("id2"), F.col("__text").alias("text2"))
    return pairs.join(first, "id1").join(second, "id2")


def shuffle_pairs(pairs: DataFrame, *, seed: int = S.SEED) -> DataFrame:
    """Seeded random order. The range partitions of the sort are the shards a trainer reads."""
    return pairs.orderBy(hash_int(seed, "shuffle", "id1", "id2"), "id1", "id2")


# --- contrastive tuples ------------------------------------------------------------------------


def _tuple_rows(df: DataFrame, id_col: str) -> DataFrame:
    """Rows by class and place, equal texts side by side, with the run [run_start, run_end) of their text.

    The place orders by a hash of the text; a text's run is found from counts per text, so copies of
    one text never meet in one task.
    """
    text = F.concat(F.coalesce(F.col(S.NAME), F.lit("")), F.lit(" "), F.coalesce(F.col(S.DESCRIPTION), F.lit("")))
    rows = with_class(df).select(id_col, *S.CLASS, F.md5(text).alias("__t"))
    per_text = rows.groupBy(*S.CLASS, "__t").agg(F.count(F.lit(1)).alias("__c"))
    runs = running_total(per_text, S.CLASS, hex_bucket("__t"), ["__t"], "__c", out="__before")
    inside = order_rank(rows, [*S.CLASS, "__t"], id_col, out="__in")
    return inside.join(runs, [*S.CLASS, "__t"]).select(
        id_col,
        *S.CLASS,
        (F.col("__before") + F.col("__in")).alias("place"),
        F.col("__before").alias("run_start"),
        (F.col("__before") + F.col("__c")).alias("run_end"),
    )


def contrastive_slots(
    df: DataFrame,
    n_tuples: int | None = None,
    *,
    positives: int = S.POSITIVES_PER_ANCHOR,
    negatives: int = S.NEGATIVES_PER_ANCHOR,
    seed: int = S.SEED,
    id_col: str = S.ROW_ID,
) -> DataFrame:
    """Long form of the tuples: (tuple_id, role, slot, id, domain, topic of the anchor).

    Per tuple: a label uniform over labels, an anchor uniform in the label, positives with another
    text than the anchor (different rows while enough exist, else repeated), negatives from uniform
    other labels. Default: one tuple per row. An anchor without another text in its label gives none.
    """
    rows = materialise(_tuple_rows(df, id_col))
    counts = materialise(class_counts(rows))
    marked = counts.withColumns({"__md5": F.md5(F.concat_ws("|", *S.CLASS)), "__one": F.lit(1).cast("bigint")})
    labels = materialise(
        running_total(marked, [], hex_bucket("__md5"), ["__md5", *S.CLASS], "__one", out="label_no").drop("__md5", "__one")
    )
    n_labels = labels.agg(F.count(F.lit(1))).scalar()
    if n_tuples is None:
        tuples = order_rank(with_class(df).select(id_col), [], id_col, out="tuple_id").select("tuple_id")
    else:
        tuples = df.sparkSession.range(n_tuples).select(F.col("id").alias("tuple_id"))
    chosen = tuples.withColumn("label_no", hash_mod(n_labels, seed, "anchor_label", "tuple_id"))
    anchored = materialise(
        chosen.join(labels, "label_no")
        .withColumn("place", hash_mod(F.col("n"), seed, "anchor_row", "tuple_id"))
        .join(rows, [*S.CLASS, "place"])
        .withColumn("m", F.col("n") - (F.col("run_end") - F.col("run_start")))
        .filter("m > 0")
    )
    # a pool with too few rows is repeated until it can fill the slots
    pool = F.when(F.col("m") >= positives, F.col("m")).otherwise(
        F.col("m") * (F.floor(F.lit(positives) / F.col("m")) + 1)
    ).cast("bigint")
    slot = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(positives - 1).cast("bigint")))
    pos = (
        anchored.withColumn("pool", pool)
        .withColumn("slot", slot)
        .withColumn("low", F.expr(f"slot * pool div {positives}"))
        .withColumn("high", F.expr(f"(slot + 1) * pool div {positives}"))
        .withColumn("pick", (F.col("low") + hash_mod(F.col("high") - F.col("low"), seed, "positive", "tuple_id", "slot")) % F.col("m"))
        .withColumn(
            "want", F.when(F.col("pick") < F.col("run_start"), F.col("pick")).otherwise(F.col("pick") + F.col("run_end") - F.col("run_start"))
        )
        .select("tuple_id", "slot", *S.CLASS, "label_no", F.lit("positive").alias("role"), F.col("label_no").alias("want_label"), "want")
    )
    neg_slot = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(negatives - 1).cast("bigint")))
    step = hash_mod(n_labels - 1, seed, "negative_label", "tuple_id", "slot") + 1
    sizes = labels.select(F.col("label_no").alias("want_label"), F.col("n").alias("__size"))
    neg = (
        anchored.filter(n_labels > 1)
        .select("tuple_id", *S.CLASS, "label_no", neg_slot.alias("slot"))
        .withColumn("want_label", (F.col("label_no") + step) % n_labels)
        .join(sizes, "want_label")
        .withColumn("want", hash_mod(F.col("__size"), seed, "negative_row", "tuple_id", "slot"))
        .select("tuple_id", "slot", *S.CLASS, "label_no", F.lit("negative").alias("role"), "want_label", "want")
    )
    numbered = rows.join(labels.select(*S.CLASS, F.col("label_no").alias("want_label")), S.CLASS).select(
        "want_label", F.col("place").alias("want"), F.col(id_col).alias("id")
    )
    found = pos.unionByName(neg).join(numbered, ["want_label", "want"])
    zero = F.lit(0).cast("bigint")
    anchor = anchored.select("tuple_id", F.lit("anchor").alias("role"), zero.alias("slot"), F.col(id_col).alias("id"), *S.CLASS)
    return anchor.unionByName(found.select("tuple_id", "role", "slot", "id", *S.CLASS))


def contrastive_tuples(df: DataFrame, n_tuples: int | None = None, **options) -> DataFrame:
    """One row per tuple: anchor id, class (the key of its template), positive ids, negative ids."""
    slots = contrastive_slots(df, n_tuples, **options)

    def ids(role: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("slot", "id"))))
        return F.transform(listed, lambda e: e["id"])

    return slots.groupBy("tuple_id", *S.CLASS).agg(
        F.max(F.when(F.col("role") == "anchor", F.col("id"))).alias("anchor_id"),
        ids("positive").alias("positive_ids"),
        ids("negative").alias("negative_ids"),
    )


def tuple_losses(
    slots: DataFrame,
    vectors: DataFrame,
    template_vectors: DataFrame | None = None,
    *,
    temperature: float = S.TEMPERATURE,
    id_col: str = S.ROW_ID,
    vector: str = "vector",
) -> DataFrame:
    """InfoNCE loss per tuple: mean over its positives (and its template) of -log softmax.

    ``vectors`` (id, unit vector); ``template_vectors`` (domain, topic, vector) adds the template as
    one more positive.
    """
    anchors = slots.filter("role = 'anchor'").select("tuple_id", F.col("id").alias(id_col)).join(
        vectors.select(id_col, F.col(vector).alias("__a")), id_col
    ).drop(id_col)
    others = slots.filter("role <> 'anchor'").select("tuple_id", "role", F.col("id").alias(id_col)).join(
        vectors.select(id_col, F.col(vector).alias("__b")), id_col
    ).drop(id_col)
    if template_vectors is not None:
        templates = (
            slots.filter("role = 'anchor'")
            .join(template_vectors.select(*S.CLASS, F.col(vector).alias("__b")), S.CLASS)
            .select("tuple_id", F.lit("positive").alias("role"), "__b")
        )
        others = others.unionByName(templates)
    sims = anchors.join(others, "tuple_id").select("tuple_id", "role", (dot("__a", "__b") / temperature).alias("z"))
    is_pos = F.col("role") == "positive"
    # each positive against the negatives: log(exp(p) + sum exp(n)) - p, shifted by the largest
    grouped = sims.groupBy("tuple_id").agg(
        F.max("z").alias("top"),
        F.collect_list(F.when(is_pos, F.col("z"))).alias("pos"),
        F.collect_list(F.when(~is_pos, F.col("z"))).alias("neg"),
    )
    rest = F.aggregate("neg", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("top")))
    with_rest = grouped.withColumn("rest", rest).filter(F.size("pos") > 0)
    total = F.aggregate(
        "pos", F.lit(0.0), lambda acc, p: acc + F.log(F.exp(p - F.col("top")) + F.col("rest")) - (p - F.col("top"))
    )
    return with_rest.select("tuple_id", (total / F.size("pos")).alias("loss"))


def info_nce(slots: DataFrame, vectors: DataFrame, template_vectors: DataFrame | None = None, **options) -> DataFrame:
    """Mean loss over all tuples (one row)."""
    losses = tuple_losses(slots, vectors, template_vectors, **options)
    return losses.agg(F.count(F.lit(1)).alias("tuples"), F.round(F.avg("loss"), 6).alias("loss"))


# --- pair agreement ----------------------------------------------------------------------------


def average_rank(counts: DataFrame, value: str, low: float, high: float, out: str, weight: str = "n") -> DataFrame:
    """(value, ``out``): tie-averaged rank of each value of a count table, prefix-summed by bucket; limits are known."""
    buckets = bucket_count(counts)
    share = (F.col(value) - F.lit(low)) / F.lit(high - low)
    bucket = F.least(F.greatest(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    sums = counts.groupBy(value).agg(F.sum(weight).alias("__c")).withColumn("__spot", bucket)
    ranked = running_total(sums, [], F.col("__spot"), [value], "__c", out="__before")
    return ranked.select(value, (F.col("__before") + (F.col("__c") + 1) / 2.0).alias(out))


def pair_score(pairs: DataFrame, vectors: DataFrame, *, id_col: str = S.ROW_ID, vector: str = "vector") -> DataFrame:
    """Spearman agreement of pair cosine with the 0/1 label (one row).

    Pairs are reduced to counts of (cosine, label) once; ranks and the correlation are weighted sums of
    these counts.
    """
    a = vectors.select(F.col(id_col).alias("id1"), F.col(vector).alias("__a"))
    b = vectors.select(F.col(id_col).alias("id2"), F.col(vector).alias("__b"))
    scored = pairs.join(a, "id1").join(b, "id2").select(F.round(dot("__a", "__b"), 9).alias("sim"), "label")
    counts = materialise(scored.groupBy("sim", "label").agg(F.count(F.lit(1)).alias("n")))
    ranked = counts.join(average_rank(counts, "sim", -1.0, 1.0, "x"), "sim").join(average_rank(counts, "label", 0.0, 1.0, "y"), "label")
    middle = (counts.agg(F.sum("n").cast("double")).scalar() + 1.0) / 2.0
    x, y, n = F.col("x") - middle, F.col("y") - middle, F.col("n")
    sums = ranked.agg(F.sum("n").alias("pairs"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    return sums.select("pairs", F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 6).alias("spearman"))
