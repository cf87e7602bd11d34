"""Filter interaction audit: what every order of a set of filters removes at each step.

The failures of a document are a bit mask, one bit a filter. Spark reads each text once, turns it into its mask and
counts documents by (part, mask); the part of a third of all rows is a few map-side sums. From there the
audit is a min-plus product: the mask matrix holds 0 where a filter fails and infinity where it passes, the
position matrix the place of each filter in each order (the inverse permutation), and

    removal step[mask, order] = min over filters of (mask matrix + position matrix).

The step decides everything: a document is kept after every earlier step, removed at this one, and redundant for each later
filter that it fails too. Counts of documents (and of good and toxic ones) are scattered by step.

The filters here are five: A few words, B few distinct words, C many capitals, D symbols, E a copy of an earlier text.
Copies of a text share A to D, so E needs no join back to documents: per distinct text, all rows fail E but those of the
smallest id. Texts are told apart by SHA-256.

Defined cases: a null text is empty; a null part is the empty string, and so one with it; null ids are no copies and make
none; rows of one id are no copies of each other, whatever their number; a document labelled twice has the larger of each label;
null labels count as 0; an empty table has no part and no row; other columns of ``docs`` and ``labels`` aren't read.
Texts may be of any length: nothing but counts leaves a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_WORDS = 100
LEAST_DISTINCT = 80  # per cent of the words
MOST_CAPITALS = 10  # per cent of the code points
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"
#: n filters have n! orders; beyond seven the tables of a part no longer fit a small task.
MOST_FILTERS = 7
WEIGHTS = ["docs", "good", "toxic"]


def text_failures(text: str) -> dict[str, Column]:
    """Filters A to D as boolean columns over a column of whole texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))
    return {
        "A": n < LEAST_WORDS,
        "B": F.lit(100) * distinct < F.lit(LEAST_DISTINCT) * n,
        "C": F.lit(100) * capitals.cast("long") > F.lit(MOST_CAPITALS) * F.length(whole).cast("long"),
        "D": whole.rlike(f"[{SYMBOLS}]"),
    }


def as_mask(failures: list[Column]) -> Column:
    """Failures as a whole number: bit i is set where filter i fails."""
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out.cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, docs, good, toxic): documents by the filters A to E that they fail.

    Only (id, part, mask, hash) of a document is shuffled. Rows are counted before each shuffle, so that a text that fills a third of
    the table is one row per task.
    """
    failures = list(text_failures(text).values())
    narrow = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        as_mask(failures).alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("hash"),
    )
    marks = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
        .filter("good > 0 or toxic > 0")
    )
    kind = ["hash", "part", "mask", "good", "toxic"]
    marked = narrow.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    by_id = marked.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    # of the rows of one kind: all, those without an id, and the smallest id with its rows
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first")
    by_kind = by_id.groupBy(*kind).agg(first, F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("no_id"))
    # a text has at most a row for each part and pair of labels here
    earliest = F.min("first.id").over(Window.partitionBy("hash"))
    originals = F.coalesce("no_id", F.lit(0)) + F.when(F.col("first.id") == earliest, F.col("first.n")).otherwise(0)
    told = by_kind.withColumn("originals", originals)
    e = 1 << len(failures)
    split = F.inline(
        F.array(
            F.struct(F.col("mask").alias("mask"), F.col("originals").alias("docs")),
            F.struct((F.col("mask") + e).cast("int").alias("mask"), (F.col("n") - F.col("originals")).alias("docs")),
        )
    )
    return (
        told.select("part", "good", "toxic", split)
        .filter("docs > 0")
        .groupBy("part", "mask")
        .agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("good")).alias("good"), F.sum(F.col("docs") * F.col("toxic")).alias("toxic"))
    )


def removal_steps(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders, positions, steps) of n filters.

    ``orders[o]`` lists the filters of order o, ``positions[f, o]`` is the place (from 1) of filter f in it, and
    ``steps[mask, o]`` the min-plus product of the mask matrix with the positions: n + 1 where nothing fails.
    """
    orders = np.array(list(permutations(range(n))), dtype=np.int64)
    positions = np.argsort(orders, axis=1).T + 1
    fails = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    masks = np.where(fails == 1, 0.0, np.inf)
    steps = np.full((1 << n, len(orders)), float(n + 1))
    for f in range(n):
        np.minimum(steps, masks[:, f : f + 1] + positions[f], out=steps)
    return orders, positions, steps.astype(np.int64)


def interaction_tables(weights: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Counts of one part by (order, step), from ``weights[mask] = (docs, good, toxic)``."""
    orders, positions, steps = removal_steps(n)
    rows = len(orders)
    at = np.arange(rows)
    scattered = np.zeros((rows, n + 2, weights.shape[1]), np.int64)
    for mask in np.flatnonzero(weights[:, 0]):
        np.add.at(scattered, (at, steps[mask]), weights[mask])
    removed = scattered[:, 1 : n + 1]
    fails = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(bool)
    docs = weights[:, 0]
    failing = np.array([docs[fails[:, f]].sum() for f in range(n)])
    alone = np.array([docs[1 << f] for f in range(n)])
    share = np.array([removed[at, positions[f] - 1, 0].sum() for f in range(n)])
    return {
        "kept": docs.sum() - np.cumsum(removed[:, :, 0], axis=1),
        "removed": removed[:, :, 0],
        "redundant": failing[orders] - removed[:, :, 0],
        "unique_fails": alone[orders],
        "good_lost": removed[:, :, 1],
        "toxic_lost": removed[:, :, 2],
        "shapley": share[orders],
    }


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant, lost.

    ``counts`` has (part, mask, docs, good, toxic) with bit i of the mask for ``letters[i]``; repeated masks add up. A part's at
    most 2**n sums are one row, so a task holds tables of fixed size whatever the number of documents.
    """
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) != n:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters with different letters, not {letters!r}")
    summed = counts.groupBy("part", "mask").agg(*[F.sum(w).cast("long").alias(w) for w in WEIGHTS])
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("sums"))
    names = ["".join(letters[f] for f in order) for order in permutations(range(n))]
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns)

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, sums in zip(frame["part"], frame["sums"]):
                weights = np.zeros((1 << n, len(WEIGHTS)), np.int64)
                for s in sums:
                    weights[s["mask"]] += [s[w] for w in WEIGHTS]
                counted = interaction_tables(weights, n)
                out = {"part": part, "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), factorial(n))}
                yield pd.DataFrame(out | {c: counted[c].ravel() for c in columns})

    return parts.mapInPandas(tables, schema)


#: The audit of ``documents`` in DuckDB.
ORACLE = f"""
with t as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), f as (
  select part, case when len(w) < {LEAST_WORDS} then 1 else 0 end as a,
         case when 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) then 1 else 0 end as b,
         case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text) then 1 else 0 end as c,
         case when regexp_matches(text, '[{SYMBOLS}]') then 1 else 0 end as d,
         case when t.doc_id > min(t.doc_id) over (partition by text) then 1 else 0 end as e,
         coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from t left join marks m on t.doc_id = m.doc_id
), m as (
  select part, a, b, c, d, e, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
  where p.x not in (q.x, r.x, s.x, t.x) and q.x not in (r.x, s.x, t.x) and r.x not in (s.x, t.x) and s.x <> t.x
), ranked as (
  select m.*, filter_order,
         least(case when a = 1 then instr(filter_order, 'A') else 6 end, case when b = 1 then instr(filter_order, 'B') else 6 end,
               case when c = 1 then instr(filter_order, 'C') else 6 end, case when d = 1 then instr(filter_order, 'D') else 6 end,
               case when e = 1 then instr(filter_order, 'E') else 6 end) as gone
  from m, orders
), steps as (
  select r.*, s.step, substr(filter_order, s.step::INTEGER, 1) as letter from ranked r, (select unnest(range(1, 6)) as step) s
), failing as (
  select *, case letter when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end as fails from steps
), counted as (
  select part, filter_order, step, letter, sum(case when gone > step then n else 0 end) as kept, sum(case when gone = step then n else 0 end) as removed,
         sum(case when fails = 1 and gone < step then n else 0 end) as redundant,
         sum(case when fails = 1 and a + b + c + d + e = 1 then n else 0 end) as unique_fails,
         sum(case when gone = step then good else 0 end) as good_lost, sum(case when gone = step then toxic else 0 end) as toxic_lost
  from failing group by part, filter_order, step, letter
)
select part, filter_order, step::INTEGER as step, kept::BIGINT as kept, removed::BIGINT as removed, redundant::BIGINT as redundant,
       unique_fails::BIGINT as unique_fails, good_lost::BIGINT as good_lost, toxic_lost::BIGINT as toxic_lost,
       (sum(removed) over (partition by part, letter))::BIGINT as shapley
from counted
"""
