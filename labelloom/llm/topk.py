"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index consists of blocks of bounded size. A block lists its postings (row, dimension, component) by
descending impact, the quantised component's absolute value, cut into segments; for each row it keeps the
norm of what is left after each segment. A search adds up one segment after another, for many queries
at once. After each, what a row can still gain or lose is bounded by |query| * |rest of the row|: a
query stops when the bounds prove that only few rows can be among its k best; exactly those are
rescored. Without a proof all segments are read, and sums are exact.

Queries against all rows is quadratic by its nature: queries and blocks meet in bounded groups
(block x group of queries), each of which returns k rows a query.

Defined cases: a null vector, or one with a null, NaN or infinite component, takes no part; neither does a null
id; vectors of different length are padded with zeros; an empty vector scores 0; rows with equal ids
are different rows, only a query's own row is left out; ties go to the smaller id. Sums are exact
while components stay below 2**24 and vectors below 2**14 components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.session import materialise

SCALE = 64
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
#: Shares of a block's postings at which segments end.
SEGMENTS = (0.4, 0.7, 0.88, 1.0)
#: A query stops when at most so many times k rows are possible members.
POSSIBLE = 8


def quantised(vectors: DataFrame, *, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, q): components floor(scale * x) of the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite)
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def _dense(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.float64)
    for k, row in enumerate(lists):
        out[k, : len(row)] = row
    return out


def build_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The impact-ordered postings of one block, and per segment its end and the norms of what is left."""
    values = _dense(pdf["q"], max(map(len, pdf["q"])))
    row, dim = np.nonzero(values)
    impact = values[row, dim]
    order = np.argsort(-np.abs(impact), kind="stable")
    row, dim, impact = row[order], dim[order], impact[order]
    ends = [int(np.ceil(share * len(row))) for share in SEGMENTS]
    left, rest = (values**2).sum(1), []
    for a, b in zip([0, *ends[:-1]], ends):
        left = left - np.bincount(row[a:b], impact[a:b] ** 2, len(values))
        rest.append(np.sqrt(np.maximum(left, 0)))
    return pd.DataFrame(
        {
            "block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "uids": [pdf["uid"].to_numpy(np.int64).tobytes()],
            "rows": [row.astype(np.int32).tobytes()], "dims": [dim.astype(np.int32).tobytes()], "impacts": [impact.tobytes()],
            "ends": [np.array(ends, np.int64).tobytes()], "rest": [np.array(rest).tobytes()], "width": [values.shape[1]],
        }
    )


BLOCK = "block long, ids binary, uids binary, rows binary, dims binary, impacts binary, ends binary, rest binary, width int"


def build_index(rows: DataFrame, n: int, *, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(one row per block, number of blocks) of ``rows`` (id, uid, q)."""
    blocks = max(1, -(-n // block_rows))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    return materialise(placed.groupBy("block").applyInPandas(build_block, BLOCK)), blocks


def search_block(queries: pd.DataFrame, block: pd.Series, k: int) -> pd.DataFrame:
    """The k best rows of the block for each query."""
    ids, uids = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["uids"], np.int64)
    row, dim = np.frombuffer(block["rows"], np.int32), np.frombuffer(block["dims"], np.int32)
    impact, ends = np.frombuffer(block["impacts"]), np.frombuffer(block["ends"], np.int64)
    rest = np.frombuffer(block["rest"]).reshape(len(ends), len(ids))
    width = max(int(block["width"]), 1, *map(len, queries["q"]))
    q, quids = _dense(queries["q"], width), queries["uid"].to_numpy(np.int64)
    whole = np.zeros((len(ids), width))
    whole[row, dim] = impact
    place = {u: i for i, u in enumerate(uids)}
    own = np.array([place.get(u, -1) for u in quids])
    norms = np.linalg.norm(q, axis=1)
    best: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(q), 256):
        active = np.arange(lo, min(lo + 256, len(q)))
        sums = np.zeros((len(active), len(ids)))
        start = 0
        for s, end in enumerate(ends):
            segment = np.zeros((len(ids), width))
            segment[row[start:end], dim[start:end]] = impact[start:end]
            sums += q[active] @ segment.T
            start = end
            slack = np.outer(norms[active], rest[s]) * (1 + 1e-9) + (1e-6 if s + 1 < len(ends) else 0)
            if s + 1 == len(ends):
                slack[:] = 0
            mine = own[active]
            hit = np.flatnonzero(mine >= 0)
            upper, lower = sums + slack, sums - slack
            upper[hit, mine[hit]] = lower[hit, mine[hit]] = -np.inf
            if len(ids) > k:
                floor = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
                possible = (upper >= floor[:, None]) & (upper > -np.inf)
            else:
                possible = upper > -np.inf
            proven = possible.sum(1) <= POSSIBLE * k
            if s + 1 == len(ends):
                proven[:] = True
            for i in np.flatnonzero(proven):
                members = np.flatnonzero(possible[i])
                exact = whole[members] @ q[active[i]]
                top = np.lexsort((uids[members], ids[members], -exact))[:k]
                best.append((np.full(len(top), active[i]), members[top], exact[top]))
            active, sums = active[~proven], sums[~proven]
            if not len(active):
                break
    at, members, score = (np.concatenate([b[i] for b in best]) for i in range(3))
    return pd.DataFrame(
        {"quid": quids[at], "query_id": queries["id"].to_numpy(np.int64)[at], "uid": uids[members], "vec_id": ids[members], "score": np.rint(score).astype(np.int64)}
    )


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each row for which ``is_query`` (on ``id``) holds."""
    rows = materialise(quantised(vectors, id_col=id_col, vector=vector, scale=scale).withColumn("uid", F.monotonically_increasing_id()))
    index, blocks = build_index(rows, rows.count())
    queries = rows.filter(is_query)
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(groups))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    offered = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    out = "quid long, query_id long, uid long, vec_id long, score long"

    def search(asked_rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if asked_rows.empty or block.empty:
            return pd.DataFrame({"quid": [], "query_id": [], "uid": [], "vec_id": [], "score": []}, dtype=np.int64)
        return search_block(asked_rows, block.iloc[0], k)

    found = asked.groupBy("block", "part").cogroup(offered.groupBy("block", "part")).applyInPandas(search, out)
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The 20 best of every 20th vector, in DuckDB.
ORACLE = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::DOUBLE))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::INTEGER as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
