"""Benchmark decontamination: a prefix-filtered set join with exact verification. DataFrame functions only.

A window is ``size`` consecutive words of an item; an item with fewer words is one window. The tokens
of the join are shingles of three words (of all words, in windows of one or two). A document contains a
window only if it contains all of its shingles, so one token is a sufficient prefix for
containment 1: the rarest, by occurrences in the documents. Documents are read once, for their occurrences
of benchmark shingles; the counts, the prefix join, the length and positional bounds and the
verification all work on that table. A verified window is a run of shingles that are
consecutive in the item and, at the same distance, in the document, and as long as the window.

The table of benchmark shingles is broadcast where it has at most ``BROADCAST_ROWS`` rows; beyond that,
the same join shuffles. Windows covering a document are merged by a running maximum, so the work is linear
in the occurrences, however many items or documents share a passage.

Defined cases: null texts have no words; an item without words has no window; items with equal id and
different texts are one item in the counts; an item with a null id hits words but isn't listed; rows with
equal id and text are one document and get equal results, rows with equal id and different texts are
judged each on its own; null ids are kept; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.session import materialise

#: The letters that are lower-cased, and what parts words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 1_000_000
#: Files of a table that follows the benchmark, not the documents.
SMALL_FILES = 8
KEY = ["__id", "__text"]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(ascii_lower(text), F.lit("")), PARTING), lambda w: w != "")


def row_key(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Adds the identity of a document: its id (null is an id too) and a hash of its text."""
    shown = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return docs.withColumn("__id", shown).withColumn("__text", F.xxhash64(F.col(text)))


def _shingles(words: Column, q: int) -> Column:
    """Array of the shingles of q words; empty where there are fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - q)
    joined = F.transform(places, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(q)]))
    return F.when(F.size(words) >= q, joined).otherwise(F.array().cast("array<string>"))


def _bounded(df: DataFrame) -> DataFrame:
    """Written once; marked for broadcast only if its size has been checked."""
    df = materialise(df.repartition(SMALL_FILES))
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, *, size: int = WINDOW, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, ipos, shingle, q, need, length, n_item): every shingle of every item with its place.

    ``need`` consecutive shingles make one window of ``length`` words.
    """
    rows = items.select(
        F.col(id_col).cast("string").alias("item_id"), F.xxhash64(id_col, text).alias("item"), words_of(F.col(text)).alias("words")
    )
    rows = rows.filter(F.size("words") > 0).dropDuplicates(["item", "item_id"])
    rows = rows.withColumn("length", F.least(F.size("words"), F.lit(size))).withColumn("q", F.least("length", F.lit(SHINGLE)))
    arrays = F.when(F.col("q") == 1, _shingles(F.col("words"), 1)).when(F.col("q") == 2, _shingles(F.col("words"), 2))
    placed = rows.select(
        "item", "item_id", "q", "length", (F.col("length") - F.col("q") + 1).alias("need"), F.size("words").alias("n_item"),
        F.posexplode(arrays.otherwise(_shingles(F.col("words"), SHINGLE))).alias("ipos", "shingle"),
    )
    return placed


def occurrences(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """(__id, __text, n_words, pos, q, shingle) of every occurrence of a benchmark shingle in a document."""
    worded = docs.select(*KEY, words_of(F.col("text")).alias("words"))
    found = None
    for q in sizes:
        placed = worded.select(*KEY, F.size("words").alias("n_words"), F.posexplode(_shingles(F.col("words"), q)).alias("pos", "shingle"))
        hits = placed.join(tokens.filter(F.col("q") == q), "shingle")
        found = hits if found is None else found.unionByName(hits)
    return found


def windows_found(docs: DataFrame, items: DataFrame, *, size: int = WINDOW) -> DataFrame:
    """(__id, __text, item_id, start, stop): every occurrence of a window of an item, words [start, stop) of the document."""
    placed = materialise(item_shingles(items, size=size).repartition(SMALL_FILES))
    sizes = [r["q"] for r in placed.select("q").distinct().collect()]  # at most SHINGLE values
    if not sizes:
        return docs.select(*KEY, F.lit("").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("stop")).filter("false")
    tokens = _bounded(placed.select("q", "shingle").distinct())
    found = materialise(occurrences(docs, tokens, sizes))
    rarity = found.groupBy("q", "shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = placed.join(_bounded(rarity), ["q", "shingle"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = F.greatest(F.lit(0), F.col("ipos") - F.col("need") + 1)
    last = F.least(F.col("ipos"), F.col("n_item") - F.col("length"))
    starts = ranked.withColumn("at", F.explode(F.sequence(first, last)))
    prefix = (
        starts.groupBy("item", "item_id", "q", "at", "length")
        .agg(F.min(F.struct("df", "shingle", "ipos")).alias("m"))
        .filter("m.df > 0")
        .select("item", "item_id", "q", "at", "length", "m.shingle", "m.ipos")
    )
    diagonal = (F.col("pos") - F.col("ipos")).alias("diagonal")
    begin = F.col("pos") - F.col("ipos") + F.col("at")
    candidates = (
        found.join(_bounded(prefix), ["q", "shingle"])
        .filter((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
        .select(*KEY, "item", "item_id", diagonal)
        .distinct()
    )
    lined = found.join(_bounded(placed), ["q", "shingle"]).select(*KEY, "item", "item_id", "need", "length", diagonal, "ipos", "pos").distinct()
    line = [*KEY, "item", "item_id", "diagonal"]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in line]
    kept = lined.alias("l").join(candidates.alias("c"), same[0] & same[1] & same[2] & same[3] & same[4], "left_semi")
    runs = kept.withColumn("run", F.col("ipos") - F.row_number().over(Window.partitionBy(*line).orderBy("ipos")))
    ends = runs.withColumn("last", F.max("ipos").over(Window.partitionBy(*line, "run")))
    whole = ends.filter(F.col("last") - F.col("ipos") + 1 >= F.col("need"))
    return whole.select(*KEY, "item_id", F.col("pos").alias("start"), (F.col("pos") + F.col("length")).alias("stop"))


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated; one row per input row."""
    outs = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    keyed = row_key(docs.drop(*outs), id_col, text)
    windows = windows_found(keyed.select(*KEY, F.col(text).alias("text")), items, size=size)
    windows = materialise(windows)
    before = Window.partitionBy(*KEY).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached))
    hits = windows.withColumn("fresh", fresh).groupBy(*KEY).agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = windows.filter("item_id is not null").select(*KEY, "item_id").distinct()
    named = named.groupBy(*KEY).agg(F.sort_array(F.collect_list("item_id")).alias("__items"))  # at most the items of one document
    judged = hits.join(named, KEY, "left")
    n_words = F.coalesce(F.regexp_count(ascii_lower(F.col(text)), F.lit(WORD)), F.lit(0)).cast("long")
    listed = F.coalesce("__items", F.array().cast("array<string>"))
    joined = keyed.withColumn("n_words", n_words).join(judged, KEY, "left")
    return (
        joined.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
        .withColumn("n_items", F.size(listed).cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(listed, ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop(*KEY, "__items")
    )


#: The verdicts for ``documents`` against ``benchmark``, in DuckDB.
ORACLE = f"""
with items as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from benchmark
), wins as (
  select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(w[i + 1 : i + least(len(w), {WINDOW})], ' ') as s
  from (select *, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) as i from items where len(w) > 0)
), docs as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) as w from documents
), placed as (
  select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as s
  from (select d.doc_id, d.w, l.n, unnest(range(0, len(d.w) - l.n + 1)) as i from docs d, (select distinct n from wins) l)
), found as (
  select p.doc_id, p.i, p.n, x.item_id from placed p join wins x on p.n = x.n and p.s = x.s
), hit as (
  select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as k from found) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from found) group by doc_id
)
select d.doc_id, len(d.w)::BIGINT as n_words, coalesce(h.n_hit, 0)::BIGINT as n_hit, coalesce(m.n_items, 0)::BIGINT as n_items,
       sha256(coalesce(m.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h using (doc_id) left join named m using (doc_id)
"""
