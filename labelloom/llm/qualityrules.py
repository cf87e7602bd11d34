"""Quality rules whose cutoffs are certified: they reject few good documents, with exact binomial bounds.

Every document gets counts of its whole text (words, their characters, symbols, repeated lines, repeated words). A fixed
base drops very short and very repetitive texts. Beyond it, a rule rejects a document whose count is more than ``cutoff``
thousandths of another one. The cutoffs come from labelled documents that pass the base, per stratum (language):

1. Labelled documents are dealt to two halves by a hash of the id. The first half picks, for each (stratum, rule), the
   cutoff of largest gain, bad rejections less ``price`` times the good ones (ties: the laxer). A rule that
   rejects less than ``least_gain`` of the stratum's bad documents is left out.
2. The second half certifies. The risk ``alpha`` of a stratum is split over its picked rules, the error ``delta`` over all
   picked pairs of stratum and rule (Bonferroni). A cutoff stands if P(Binomial(n, alpha / rules) <= k) <= delta / pairs, where k
   of the n good documents of the second half are rejected. Cutoffs are tested from the laxest to the picked one and
   testing stops at the first that fails: in a fixed sequence that needs no further correction.

So with probability 1 - delta, in all strata at once, at most alpha of the good documents that pass the base are rejected. A
stratum with too few labels keeps everything. The bound holds for documents that are drawn like the labelled ones.

Only counts are kept of a text; the documents of a stratum are summed by level of each rule before any shuffle, so a
hot stratum is a few rows per task. Cutoffs are one row a stratum.

Defined cases: null and empty texts have zero words and fail the base; a null stratum is a stratum of its own; a document labelled
twice is good if any label says so; null labels and null ids don't train; repeated rows get equal verdicts (and train
as often as they occur); without labels only the base decides; empty tables give empty tables; columns of ``docs`` that are
named as results are replaced, others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.hashing import hash_int
from labelloom.llm.textkit import NOT_SPACE, SLICE_BYTES, byte_table
from labelloom.session import materialise

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: rule: (count, base count, cutoffs in thousandths from the laxest); rejected if 1000 * count > cutoff * base count.
RULES: dict[str, tuple[str, str, list[int]]] = {
    "symbols": ("n_symbols", "word_chars", [500, 300, 200, 150, 100, 70, 50, 30, 20, 10]),
    "dup_lines": ("n_dup_lines", "n_lines", [900, 800, 700, 600, 500, 400, 350, 300, 250, 200]),
    "repeats": ("n_repeat_words", "n_words", [450, 400, 350, 300, 250, 200, 150, 120, 100, 80]),
    "long_words": ("word_chars", "n_words", [15_000, 12_000, 11_000, 10_000, 9_000, 8_500, 8_000, 7_500, 7_000, 6_500]),
}
ALPHA, DELTA = 0.05, 0.05
PRICE, LEAST_GAIN = 10, 0.05
SEED = 12

SYMBOL_BYTES = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Bytes that begin a code point.
HEAD_BYTES = ~byte_table((0x80, 0xBF))


# --- counts of a text --------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    top = int(ids.max()) + 1
    pairs = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)[1].astype(np.int64)
    # fewer than n pairs and n words, so the product of both fits 63 bits for any text that fits a row
    _, kind, times = np.unique(pairs[:-1] * top + ids[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[kind] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def text_statistics(text: bytes) -> tuple[int, ...]:
    """The counts of STATISTICS for one whole text in UTF-8. ``bytes.split`` parts at exactly 0x20 and 0x09 to 0x0D."""
    words = text.split()
    if not words:
        return (0,) * len(STATISTICS)
    data = np.frombuffer(text, np.uint8)
    chars = symbols = 0
    for at in range(0, len(data), SLICE_BYTES):
        piece = data[at : at + SLICE_BYTES]
        chars += int((NOT_SPACE & HEAD_BYTES)[piece].sum())
        symbols += int(SYMBOL_BYTES[piece].sum())
    lines = [line for line in text.split(b"\n") if line.strip()] if b"\n" in text else [text]
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its counts instead of the text."""
    docs = docs.drop(*STATISTICS)
    others = [f for f in docs.schema.fields if f.name != text]
    out = T.StructType([*others, *[T.StructField(c, T.LongType()) for c in STATISTICS]])
    at = docs.columns.index(text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(STATISTICS)), np.int64)
            for i, value in enumerate(batch.column(at).cast(pa.large_binary())):
                if value.is_valid:
                    rows[i] = text_statistics(value.as_py())
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            counts = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*kept, *counts], names=[f.name for f in out.fields])

    return docs.mapInArrow(count, out)


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)


# --- cutoffs -----------------------------------------------------------------------------------


def level(rule: str, rules: dict = RULES) -> Column:
    """How many of the rule's cutoffs, from the laxest on, do not reject the document."""
    count, base, cutoffs = rules[rule]
    passed = [F.when(F.lit(1000) * F.col(count) <= F.lit(c) * F.col(base), 1).otherwise(0) for c in cutoffs]
    out = passed[0]
    for p in passed[1:]:
        out = out + p
    return out.cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed from its largest term to both sides until terms no longer count."""
    if k < 0 or n < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    top = min(k, int((n + 1) * p))
    first = exp(lgamma(n + 1) - lgamma(top + 1) - lgamma(n - top + 1) + top * log(p) + (n - top) * log1p(-p))
    odds, total = p / (1 - p), first
    term, i = first, top
    while i > 0 and term > total * 1e-18:
        term *= i / ((n - i + 1) * odds)
        i -= 1
        total += term
    term, i = first, top
    while i < k and term > total * 1e-18:
        i += 1
        term *= (n - i + 1) * odds / i
        total += term
    return min(total, 1.0)


def level_counts(rated: DataFrame, rules: dict = RULES) -> DataFrame:
    """(stratum, rule, level, good_pick, bad_pick, good_hold): labelled documents by the level of each rule.

    ``rated`` has (stratum, good, hold) and the counts.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r, rules).alias("level")) for r in rules]))
    good, hold = F.col("good") == 1, F.col("hold")
    sums = {"good_pick": good & ~hold, "bad_pick": ~good & ~hold, "good_hold": good & hold}
    return (
        rated.select("stratum", "good", "hold", levels.alias("at"))
        .select("stratum", "good", "hold", "at.*")
        .groupBy("stratum", "rule", "level")
        .agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name) for name, c in sums.items()])
    )


def picked_cutoff(rows: pd.DataFrame, most: int, *, price: int, least_gain: float) -> int:
    """How many of a rule's ``most`` cutoffs give the largest gain in one stratum; 0 leaves the rule out.

    ``rows`` has counts by level; the first j cutoffs together reject the levels below j.
    """
    good = np.bincount(rows["level"], rows["good_pick"], most + 1).cumsum()[:most]
    bad = np.bincount(rows["level"], rows["bad_pick"], most + 1).cumsum()[:most]
    gain = np.where(bad >= least_gain * rows["bad_pick"].sum(), bad - price * good, 0)
    best = int(gain.argmax())  # the laxest of equals
    return best + 1 if gain[best] > 0 else 0


def certified(counts: DataFrame, rules: dict = RULES, *, alpha: float = ALPHA, delta: float = DELTA, price: int = PRICE, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(stratum, rule, picked, certified, n_good, k_rejected, bound): cutoffs that may be used, counted from the laxest.

    Each (stratum, rule) is a task-sized table of at most one row a cutoff. ``bound`` is the probability that was compared.
    """
    most = {r: len(c[2]) for r, c in rules.items()}

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        picked = picked_cutoff(rows, most[key[1]], price=price, least_gain=least_gain)
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "picked": np.array([picked], np.int32)})

    picks = counts.groupBy("stratum", "rule").applyInPandas(pick, "stratum string, rule string, picked int").filter("picked > 0")
    picks = materialise(picks)  # read for the two splits and the tests
    pairs = picks.count()
    shares = picks.groupBy("stratum").agg(F.count(F.lit(1)).alias("shares"))
    tested = counts.join(picks, (counts["stratum"].eqNullSafe(picks["stratum"])) & (counts["rule"] == picks["rule"]))
    tested = tested.select(counts["stratum"], counts["rule"], "level", "good_hold", "picked")
    shares = shares.withColumnRenamed("stratum", "__s")
    tested = tested.join(shares, F.col("stratum").eqNullSafe(F.col("__s"))).drop("__s")

    def certify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        picked, risk = int(rows["picked"].iloc[0]), alpha / int(rows["shares"].iloc[0])
        n = int(rows["good_hold"].sum())
        by_level = np.bincount(rows["level"], rows["good_hold"], most[key[1]] + 1).astype(np.int64).cumsum()
        stands, bound, k = 0, 1.0, 0
        for j in range(picked):
            p = binomial_tail(int(by_level[j]), n, risk) if n else 1.0
            if p > delta / pairs:
                break
            stands, bound, k = j + 1, p, int(by_level[j])
        return pd.DataFrame(
            {"stratum": [key[0]], "rule": [key[1]], "picked": np.array([picked], np.int32), "certified": np.array([stands], np.int32),
             "n_good": [n], "k_rejected": [k], "bound": [bound]}
        )

    schema = "stratum string, rule string, picked int, certified int, n_good long, k_rejected long, bound double"
    return tested.groupBy("stratum", "rule").applyInPandas(certify, schema)


def cutoffs(certs: DataFrame, rules: dict = RULES) -> DataFrame:
    """One row a stratum: a column per rule with its cutoff in thousandths, null where none is certified."""

    def at(rule: str) -> Column:
        steps = F.array(*[F.lit(c) for c in rules[rule][2]])
        return F.max(F.when((F.col("rule") == rule) & (F.col("certified") > 0), F.get(steps, F.col("certified") - 1))).alias(f"cut_{rule}")

    return certs.groupBy("stratum").agg(*[at(r) for r in rules])


def calibrate(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum: str = "lang", rules: dict = RULES, **limits) -> DataFrame:
    """Certificates (see ``certified``) from ``docs`` with counts and ``labels`` (doc_id, quality 0/1)."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality").cast("int")).alias("good"))
    columns = [F.col(id_col).alias("id"), F.col(stratum).cast("string").alias("stratum"), *STATISTICS]
    rated = docs.filter(~base_failed()).select(*columns).join(good, "id")
    rated = rated.withColumn("hold", hash_int(SEED, "hold", "id") % 2 == 1)
    return certified(materialise(level_counts(rated, rules)), rules, **limits)


def judge(docs: DataFrame, certs: DataFrame, *, stratum: str = "lang", rules: dict = RULES) -> DataFrame:
    """``docs`` (with counts) plus ``base_failed`` and ``kept``."""
    chosen = cutoffs(certs, rules).withColumnsRenamed({"stratum": "__stratum", **{f"cut_{r}": f"__cut_{r}" for r in rules}})
    chosen = materialise(chosen)  # its size is known then: Spark joins it as suits
    joined = docs.join(chosen, F.col(stratum).cast("string").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for r, (count, base, _) in rules.items():
        rejected = rejected | F.coalesce(F.lit(1000) * F.col(count) > F.col(f"__cut_{r}") * F.col(base), F.lit(False))
    failed = base_failed()
    return joined.select(*[c for c in docs.columns if c not in ("base_failed", "kept")], failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def _level_sql(rule: str) -> str:
    count, base, steps = RULES[rule]
    return " + ".join(f"case when 1000 * {count} <= {c} * {base} then 1 else 0 end" for c in steps)


#: The verdicts on ``documents`` with the default parameters, in DuckDB.
ORACLE = f"""
with t as (
  select row_number() over () as r, doc_id, lang, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents
), lines as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(text, chr(10))) as line from t) x where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r
), windows as (
  select r, k, count(*) over (partition by r, a, b, c) as times
  from (select r, unnest(range(1, len(w) - 1)) as k, unnest(w[1:len(w) - 2]) as a, unnest(w[2:len(w) - 1]) as b, unnest(w[3:]) as c from t where len(w) > 2) x
), repeats as (
  select r, count(distinct k + d) as n_repeat_words from windows, (select unnest(range(0, 3)) as d) e where times > 1 group by r
), s as (
  select t.r, doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from t left join lines l on t.r = l.r left join repeats p on t.r = p.r
), b as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from s
), rated as (
  select b.*, coalesce(lang, chr(1)) as stratum, good, ('0x' || substr(md5('{SEED}|hold|' || b.doc_id), 1, 13))::BIGINT % 2 = 1 as hold from b
  join (select doc_id, max(quality) as good from labels where quality is not null group by doc_id) g on b.doc_id = g.doc_id
  where not base_failed
), levels as ({" union all ".join(f"select stratum, '{r}' as rule, {_level_sql(r)} as level, good, hold from rated" for r in RULES)}
), grid as (
  select stratum, rule, j from (select distinct stratum, rule from levels) x, (select unnest(range(1, 11)) as j) y
), curves as (
  select g.stratum, g.rule, j, sum(case when good = 0 and not hold and level < j then 1 else 0 end) as bad,
         sum(case when good = 1 and not hold and level < j then 1 else 0 end) as good,
         sum(case when good = 0 and not hold then 1 else 0 end) as all_bad,
         sum(case when good = 1 and hold and level < j then 1 else 0 end) as k, sum(case when good = 1 and hold then 1 else 0 end) as n
  from grid g join levels l on g.stratum = l.stratum and g.rule = l.rule group by g.stratum, g.rule, j
), gains as (
  select *, bad - {PRICE} * good as gain from curves where bad - {PRICE} * good > 0 and bad >= {LEAST_GAIN} * all_bad
), picks as (
  select stratum, rule, j as picked from (select *, row_number() over (partition by stratum, rule order by gain desc, j) as best from gains) x where best = 1
), tested as (
  select c.*, {ALPHA} / (count(*) over (partition by c.stratum, j)) as risk, {DELTA} / (select count(*) from picks) as least, picked
  from curves c join picks p on c.stratum = p.stratum and c.rule = p.rule
), tails as (
  select stratum, rule, j, least, case when n = 0 or k >= n then 1.0 else (
    select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(risk) + (n - i) * ln(1 - risk))) from (select unnest(range(0, 20000)) as i) z where i <= k
  ) end as p from tested where j <= picked
), stands as (
  select stratum, rule, max(j) as certified from (
    select *, sum(case when p > least then 1 else 0 end) over (partition by stratum, rule order by j) as failed from tails
  ) x where failed = 0 group by stratum, rule
)
select doc_id, n_words::BIGINT as n_words, word_chars::BIGINT as word_chars, n_symbols::BIGINT as n_symbols, n_dup_lines::BIGINT as n_dup_lines,
       n_repeat_words::BIGINT as n_repeat_words, base_failed, not base_failed and not coalesce(rejected, false) as kept
from b left join (
  select l.r, bool_or(level < certified) as rejected
  from ({" union all ".join(f"select r, coalesce(lang, chr(1)) as stratum, '{r}' as rule, {_level_sql(r)} as level from b" for r in RULES)}) l
  join stands s on l.stratum = s.stratum and l.rule = s.rule group by l.r
) v on b.r = v.r
"""
