"""Line dedup by content hashes of short runs of lines, filtered by winnowing. DataFrame functions only.

A run of consecutive lines that also occurs earlier (in a smaller document, or before in the same one) is a repeat if it
has ``chars`` characters or more, or ``run`` lines; lines covered by a repeat are deleted. So a single line of 40 characters
counts, and any passage of 21 words or more does (it has 41 characters at least), on however few lines.

Only shortest runs are looked at: from each line on, and up to each line, the fewest lines that are enough. Both depend on the content
alone, so equal passages have equal shortest runs, and these cover a passage whole: a line either begins such a run inside the
passage, or lies in the one that ends with it. That is what extending a match both ways to its ends gives.

Winnowing filters the runs of several lines: shingles of ``shingle`` lines are hashed, and a run selects the smallest of its own (the
first of equals). The choice depends on the run alone, so equal runs select the same fingerprint; runs whose
fingerprint occurs twice go on. They are grouped by the hashes of all their lines, and the first of equal runs stays. There
is no join of positions. So a fingerprint shared by millions of documents makes one row per run, never pairs. Deleted runs of a
document merge by a running maximum.

The joins are sort-merge joins at every size: a broadcast that only small tables get would hide what large ones
need, and hot keys are split by adaptive execution.

Lines are parted by LF. Empty lines (after trimming spaces, tabs and CR) are no lines: they take no part in
runs, and those inside a repeat are deleted with it.

Defined cases: null texts have no lines and stay null; documents without a run that is enough keep all; rows with equal
id and text are one document and get equal results; equal ids with different texts are different
documents, the smaller text hash first; null ids come last; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.session import materialise

RUN = 3
SHINGLE = 2
CHARS = 40
ORDER = ["__null", "__id", "__text"]


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  ")) == ""


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Adds the place of a document in the order (nulls last) and what tells equal ids apart."""
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    return docs.withColumns({"__null": F.col(id_col).isNull(), "__id": place, "__text": F.xxhash64(text)})


def counting_lines(text: str) -> Column:
    """(line, pos) of the lines that aren't blank; pos counts all lines."""
    placed = F.transform(F.split(text, "\n"), lambda s, i: F.struct(s.alias("line"), i.alias("pos")))
    return F.filter(placed, lambda x: ~_blank(x["line"]))


def fingerprints(docs: DataFrame, *, run: int = RUN, shingle: int = SHINGLE, chars: int = CHARS) -> DataFrame:
    """(order columns, start, stop, a, b, print, own): each shortest run that is enough, as counting lines from ``start`` up to
    ``stop``, with its first and last position, the fingerprint it selected and the hashes of its lines. ``docs`` has the
    order columns and ``lines``."""
    hashed = F.transform(
        "lines", lambda x: F.struct(F.xxhash64(x["line"]).alias("h"), x["pos"].alias("pos"), F.least(F.length(x["line"]), F.lit(chars)).alias("n"))
    )
    placed = docs.filter(F.size("lines") > 0).select(*ORDER, hashed.alias("l"))

    def needed(i: Column, step: int) -> Column:
        """Lines that are enough from line i on (step 1) or back (step -1); null where the text has no such run."""
        total, out, found = F.lit(0), None, F.lit(True)
        cases = []
        for k in range(run):
            line = F.get("l", i + step * k)
            found = found & (i + step * k >= 0) & line.isNotNull()
            total = total + F.coalesce(line["n"], F.lit(0))
            cases.append((found & ((total >= chars) if k + 1 < run else F.lit(True)), k + 1))
        for enough, k in cases:
            out = F.when(enough, k) if out is None else out.when(enough, k)
        return out

    every = F.sequence(F.lit(0), F.size("l") - 1)
    measured = placed.withColumns({"on": F.transform(every, lambda i: needed(i, 1)), "back": F.transform(every, lambda i: needed(i, -1))})
    # a run up to a line that is also the one from its own first line on is the same row
    ahead = F.transform("on", lambda n, i: F.struct(i.alias("start"), n.alias("n")))
    behind = F.transform("back", lambda n, i: F.struct((i - n + 1).alias("start"), n.alias("n")))
    behind = F.filter(behind, lambda x: x["n"].isNotNull() & ~F.get("on", x["start"]).eqNullSafe(x["n"]))
    runs = F.concat(F.filter(ahead, lambda x: x["n"].isNotNull()), behind)

    def selected(x: Column) -> Column:
        i, n = x["start"], x["n"]
        lines = [F.when(n > k, F.get("l", i + k)["h"]) for k in range(run)]
        shingles = [F.when(n >= k + shingle, F.xxhash64(*lines[k : k + shingle])) for k in range(run - shingle + 1)]
        return F.struct(
            i.alias("start"),
            (i + n).alias("stop"),
            F.get("l", i)["pos"].alias("a"),
            F.get("l", i + n - 1)["pos"].alias("b"),
            F.coalesce(F.least(*shingles) if len(shingles) > 1 else shingles[0], lines[0]).alias("print"),
            F.struct(*[line.alias(f"l{k}") for k, line in enumerate(lines)]).alias("own"),
        )

    return measured.select(*ORDER, F.inline(F.transform(runs, selected)))


def repeats(prints: DataFrame) -> DataFrame:
    """(order columns, start, stop, a, b) of every run that also starts earlier."""
    often = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print")
    shared = prints.join(often.hint("merge"), "print", "left_semi")
    place = F.struct(*ORDER, "start")
    firsts = shared.groupBy("own").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return shared.join(firsts.hint("merge"), "own").filter(place != F.col("first")).select(*ORDER, "start", "stop", "a", "b")


def repeated_spans(gone: DataFrame) -> DataFrame:
    """One row per document: ``spans``, disjoint (a, b) positions in order, and ``n_removed`` lines."""
    along = Window.partitionBy(*ORDER).orderBy("start", "stop")
    reached = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    numbered = gone.withColumn("open", F.when(reached.isNull() | (F.col("start") >= reached), 1).otherwise(0)).withColumn("span", F.sum("open").over(along))
    spans = numbered.groupBy(*ORDER, "span").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), (F.max("stop") - F.min("start")).alias("n")
    )
    listed = F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")  # the spans of one document
    return spans.groupBy(*ORDER).agg(listed, F.sum("n").cast("long").alias("n_removed"))


def without_spans(text: str, spans: str) -> Column:
    """The text without the lines of the spans: what lies between them, joined again."""
    lines = F.split(text, "\n")

    def between(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["b"] + 1)
        end = F.when(i == F.size(spans), F.size(lines)).otherwise(F.get(spans, i)["a"])
        return F.slice(lines, begin + 1, end - begin)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), between))
    return F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, *, run: int = RUN, shingle: int = SHINGLE, chars: int = CHARS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that deletion leaves, ``n_lines`` and ``n_removed`` (lines that count)."""
    rows = keyed(docs.drop("n_lines", "n_removed"), id_col, text)
    prints = materialise(fingerprints(rows.select(*ORDER, counting_lines(text).alias("lines")), run=run, shingle=shingle, chars=chars))
    spans = materialise(repeated_spans(repeats(prints)).withColumnsRenamed({"spans": "__spans", "n_removed": "__n"}))
    joined = rows.join(spans.hint("merge"), ORDER, "left")
    n_lines = F.coalesce(F.size(counting_lines(text)), F.lit(0))
    return (
        joined.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long"))
        .withColumn("n_removed", F.coalesce("__n", F.lit(0)).cast("long"))
        .withColumn(text, without_spans(text, "__spans"))
        .drop(*ORDER, "__spans", "__n")
    )


#: Deletion from ``documents`` with the default parameters, in DuckDB.
ORACLE = f"""
with split as (
  select doc_id, pos, line, trim(translate(line, chr(9) || chr(13), '  ')) = '' as blank
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents)
), c as (
  select *, row_number() over (partition by doc_id order by pos) as start from split where not blank
), r as (
  select doc_id, start, line as l0, lead(line, 1) over d as l1, lead(line, 2) over d as l2, pos as a0, lead(pos, 1) over d as a1, lead(pos, 2) over d as a2
  from c window d as (partition by doc_id order by pos)
), shortest as (
  -- a run is one that is enough of which the lines without its last, or without its first, are not
  select doc_id, start, a0 as a, a0 as b, l0 as own from r where length(l0) >= {CHARS}
  union all
  select doc_id, start, a0, a1, l0 || chr(10) || l1 from r where l1 is not null and length(l0) + length(l1) >= {CHARS} and least(length(l0), length(l1)) < {CHARS}
  union all
  select doc_id, start, a0, a2, l0 || chr(10) || l1 || chr(10) || l2 from r
  where l2 is not null and least(length(l0) + length(l1), length(l1) + length(l2)) < {CHARS}
), f as (select *, row_number() over (partition by own order by doc_id, start) as nth from shortest
), gone as (select distinct doc_id, unnest(range(a, b + 1)) as pos from f where nth > 1
), left_ as (
  select s.doc_id, count(*) filter (where not blank) as n_lines, count(*) filter (where not blank and g.pos is not null) as n_removed,
         string_agg(line, chr(10) order by s.pos) filter (where g.pos is null) as kept
  from split s left join gone g on s.doc_id = g.doc_id and s.pos = g.pos group by s.doc_id
)
select d.doc_id, coalesce(n_lines, 0)::BIGINT as n_lines, coalesce(n_removed, 0)::BIGINT as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join left_ l using (doc_id)
"""
