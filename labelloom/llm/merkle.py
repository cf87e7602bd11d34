"""Merkle dataset manifest with a witness for every row, built by incremental witnesses.

A tree per group (language) over the leaves in the order of their ids, and a tree over the group roots. Two neighbouring
nodes become the hash of both; a last node without a neighbour becomes the hash of itself alone. A witness lists, from the
leaf to the root, the neighbour at each level and its side.

``OpenSubtrees`` is the append-only tree: complete aligned subtrees are open until their right sibling comes, and each holds
the witnesses of its members so far. When the sibling completes, both sides' witnesses get the other root and the two
become one open subtree. Appending a leaf or a whole subtree is the same step, so work is dealt out: leaves get positions from
one range sort, blocks of 2**BITS positions are appended in tasks of their own, and the block roots are the appends of the next
round (a 4,096th of the rows each), up to the root. Then witnesses go down again: a block's leaves are appended once more, now
with their witnesses, which the witness of the block itself extends. No task ever holds more than one block, whatever the group.

Hashes are SHA-256 in lower-case hex, over the hex text of what is hashed. Only ids, hashes and the columns in ``keep`` are shuffled.

Defined cases: nulls are fields of their own (``-``) and empty texts are not null (``0:``); null ids come first in a group, a null
group is a group of its own and comes first; rows with equal ids follow the order of their leaf hashes, so the tree
doesn't depend on the order of the input; equal rows are equal leaves, each with its own witness; a lone leaf is
the root of its group; an empty table has no rows and no root. Texts may be of any length; columns beyond ``fields`` and ``keep`` aren't read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.functions.ranking import bucket_count
from labelloom.session import materialise

#: Leaves of a block: 2**BITS.
BITS = 12
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
WITNESS = "array<struct<side:int,digest:string>>"
LEFT, NONE, RIGHT = -1, 0, 1


# --- hashes ------------------------------------------------------------------------------------


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its text, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def joined(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf has under a witness: how a holder of one row checks it."""

    def step(h: Column, w: Column) -> Column:
        both = F.when(w["side"] == LEFT, F.concat(w["digest"], h)).when(w["side"] == RIGHT, F.concat(h, w["digest"])).otherwise(h)
        return F.sha2(both, 256)

    return F.aggregate(witness, leaf, step)


def proof_hash(witness: Column) -> Column:
    """SHA-256 of all digests of a witness, from the leaf on."""
    return F.sha2(F.array_join(F.transform(F.filter(witness, lambda w: w["side"] != NONE), lambda w: w["digest"]), ""), 256)


# --- appending ---------------------------------------------------------------------------------


def depth(n: int) -> int:
    """Levels above n nodes."""
    return (n - 1).bit_length()


class OpenSubtrees:
    """Complete subtrees of an append-only tree, the largest first, with the partial witnesses of their members.

    Members are numbered in order of appending. A witness is a list of (side, digest); it is only kept with ``witnesses``.
    """

    def __init__(self, witnesses: bool = True):
        self.open: list[tuple[int, str, int, int]] = []  # (level, root, first member, member after the last)
        self.witness: list[list[tuple[int, str | None]]] | None = [] if witnesses else None
        self.members = 0

    def append(self, root: str, level: int = 0) -> None:
        """Adds a node, or a whole subtree of the given level as one member. Open subtrees may not be smaller."""
        if self.open and self.open[-1][0] < level:
            raise ValueError("a subtree can't be appended behind a smaller open one")
        if self.witness is not None:
            self.witness.append([])
        self.members += 1
        self._push(level, root, self.members - 1, self.members)

    def _push(self, level: int, root: str, first: int, stop: int) -> None:
        while self.open and self.open[-1][0] == level:
            _, left, lo, mid = self.open.pop()
            self._extend(lo, mid, (RIGHT, root))
            self._extend(first, stop, (LEFT, left))
            level, root, first = level + 1, joined(left, root), lo
        self.open.append((level, root, first, stop))

    def _extend(self, first: int, stop: int, step: tuple[int, str | None]) -> None:
        if self.witness is not None:
            for k in range(first, stop):
                self.witness[k].append(step)

    def close(self, top: int) -> str:
        """The root at level ``top``: the last open subtree is raised alone until it meets the next larger one."""
        while len(self.open) > 1 or self.open[0][0] < top:
            level, root, first, stop = self.open.pop()
            self._extend(first, stop, (NONE, None))
            self._push(level + 1, joined(root), first, stop)
        return self.open[0][1]


# --- positions ---------------------------------------------------------------------------------


def positioned(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``tree`` (number of the group in order), ``pos`` (place in it) and ``size``, and (tree, trees) of the groups.

    One range sort; a task then holds rows of one range, and of each range and group only a count is needed.
    """
    ranges = max(2, bucket_count(rows))
    ordered = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    placed = materialise(ordered.withColumn("at", F.monotonically_increasing_id()))  # range number and place in it
    part = F.shiftright("at", 33).alias("part")
    counts = materialise(placed.groupBy(group, part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    trees = counts.groupBy(group).agg(F.min("first").alias("start"), F.sum("n").cast("long").alias("size"))
    trees = trees.withColumn("part", F.shiftright("start", 33))
    # groups that start in a range: at most one row a range, in the order of the ranges
    starting = trees.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = starting.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("trees"))
    trees = materialise(
        trees.join(before, "part").select(
            F.col(group).alias("__g"),
            (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1).cast("long").alias("tree"),
            "size",
            F.col("trees").cast("long").alias("trees"),
        )
    )
    upto = Window.partitionBy(group).orderBy("part")
    offsets = counts.withColumn("offset", F.sum("n").over(upto) - F.col("n"))
    offsets = offsets.join(trees, F.col(group).eqNullSafe(F.col("__g")))
    offsets = materialise(offsets.select(F.col(group).alias("__g"), F.col("part").alias("__part"), (F.col("offset") - F.col("first")).alias("shift"), "tree", "size"))
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.shiftright("at", 33) == F.col("__part"))
    nodes = placed.join(offsets, same).withColumn("pos", (F.col("at") + F.col("shift")).cast("long")).drop("at", "shift", "__g", "__part")
    return nodes, trees.select("tree", "trees")


# --- rounds ------------------------------------------------------------------------------------


def block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, size, hash): the roots of the blocks of ``nodes``, which are the nodes of the next round."""

    def append(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["pos"].to_numpy(), kind="stable")
        size, subtree = table["size"][0].as_py(), OpenSubtrees(witnesses=False)
        hashes = table["hash"].to_pylist()
        for k in order:
            subtree.append(hashes[k])
        root = subtree.close(min(bits, depth(size)))
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "size": [-(-size >> bits)], "hash": [root]}, schema=node_schema)

    node_schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("size", pa.int64()), ("hash", pa.string())])
    block = F.shiftright("pos", bits).alias("block")
    narrow = nodes.select("tree", block, "pos", "size", "hash")
    return narrow.groupBy("tree", "block").applyInArrow(append, "tree long, pos long, size long, hash string")


def climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes of every round, up to one root per tree."""
    rounds = [nodes]
    while True:
        rounds.append(materialise(block_roots(rounds[-1], bits)))
        if (rounds[-1].agg(F.max("size")).first()[0] or 1) <= 1:
            return rounds


def descend(nodes: DataFrame, above: DataFrame, bits: int, keep: list[str]) -> DataFrame:
    """``nodes`` with ``witness``, ``subroot`` and ``root``: their own steps in the block, extended by those of the block ``above``."""
    columns = ["tree", "pos", *keep]
    left = nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "size", "hash", *[c for c in keep if c != "hash"])
    right = above.select("tree", F.col("pos").alias("block"), "witness", "subroot", "root")
    kept = nodes.select(*columns).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"witness {WITNESS}", "subroot string", "root string"])

    def append(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        tree, size = OpenSubtrees(), rows["size"][0].as_py() if len(rows) else 1
        for h in rows["hash"].to_pylist():
            tree.append(h)
        if len(rows):
            tree.close(min(bits, depth(size)))
        further = [(w["side"], w["digest"]) for w in block["witness"][0].as_py()] if len(block) else []
        steps = [s for own in tree.witness for s in (*own, *further)]
        ends = np.cumsum([0, *(len(own) + len(further) for own in tree.witness)]).astype(np.int32)
        fields = [pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.string())]
        witness = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["side", "digest"]))
        out = {c: rows[c] for c in columns} | {"witness": witness}
        for c in ("subroot", "root"):
            out[c] = pa.array([block[c][0].as_py() if len(block) else None] * len(rows), pa.string())
        return pa.table(out)

    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(append, schema)


def top_of(roots: DataFrame) -> DataFrame:
    """Roots as the nodes from which witnesses go down: nothing above them yet."""
    return roots.select("tree", "pos", F.array().cast(WITNESS).alias("witness"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))


def manifest(
    docs: DataFrame, *, fields: list[str] = FIELDS, id_col: str = "doc_id", group: str = "lang", keep: list[str] | None = None, bits: int = BITS
) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep``, ``pos`` in its group, ``leaf``, ``witness`` (steps from leaf to root), ``subroot``, ``root``."""
    if not 1 <= bits <= 16:
        raise ValueError("blocks hold 2 to 65,536 leaves")
    keep = keep or []
    kept = [F.col(c).alias(f"__{k}") for k, c in enumerate(keep)]
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group).alias("group"), leaf_hash(*[F.col(c) for c in fields]).alias("hash"), *kept)
    # hashed once: the range sort reads its input twice
    nodes, trees = positioned(materialise(leaves), "group", ["id", "hash"])
    rounds = climb(nodes, bits)
    subroots = rounds[-1]
    tops = climb(subroots.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("size"), "hash"), bits)
    down = top_of(tops[-1])
    for level in reversed(tops[:-1]):
        down = descend(level, down, bits, [])
    above = subroots.join(down.select(F.col("pos").alias("tree"), "witness", "root"), "tree").select("tree", "pos", "witness", F.col("hash").alias("subroot"), "root")
    above = materialise(above)
    carried = ["id", "hash", *[f"__{k}" for k in range(len(keep))]]
    for k, level in reversed(list(enumerate(rounds[:-1]))):
        above = descend(level, above, bits, carried if k == 0 else [])
    names = [F.col(f"__{k}").alias(c) for k, c in enumerate(keep)]
    return above.select(F.col("id").alias(id_col), *names, "pos", F.col("hash").alias("leaf"), "witness", "subroot", "root")


def _field_sql(name: str, value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


def _leaf_sql(**changed: str) -> str:
    return "sha256(" + " || ".join(_field_sql(f, changed.get(f, f"{f}::VARCHAR")) for f in FIELDS) + ")"


def _crc_sql(value: str) -> str:
    """CRC-32 of ASCII text, bit by bit (DuckDB has no such function)."""
    codes = f"list_transform(string_split({value}, ''), lambda ch: ascii(ch)::BIGINT)"
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"


#: The manifest of ``documents``, its proofs and the check of tampered rows, in DuckDB.
ORACLE = f"""
with recursive leaves as (
  select row_number() over () as r, doc_id, lang, {_leaf_sql()} as leaf, {_leaf_sql(n_chars="(n_chars + 1)::VARCHAR")} as other from documents
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by lang) as size,
         dense_rank() over (order by lang nulls first) - 1 as tree from leaves
), low as (
  select tree, 0 as level, pos, size as n, leaf as h from placed
  union all
  select tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from low where n > 1 group by tree, level, pos // 2, n
), subroots as (
  select tree, h, count(*) over () as n from low where n = 1
), high as (
  select 0 as level, tree as pos, n, h from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from high where n > 1 group by level, pos // 2, n
), steps as (
  select r, l.level, (p.pos >> l.level) & 1 as odd, s.h from placed p join (select distinct tree, level from low where n > 1) l on p.tree = l.tree
  left join low s on s.tree = p.tree and s.level = l.level and s.pos = xor(p.pos >> l.level, 1)
  union all
  select r, 1000 + l.level, (tree >> l.level) & 1, s.h from placed p join (select distinct level from high where n > 1) l on true
  left join high s on s.level = l.level and s.pos = xor(tree >> l.level, 1)
), ordered as (
  select *, row_number() over (partition by r order by level) as step from steps
), folds as (
  select r, 0 as step, case when {_crc_sql("doc_id::VARCHAR")} % 7 = 0 then other else leaf end as h from placed
  union all
  select f.r, o.step, sha256(case when o.h is null then f.h when odd = 1 then o.h || f.h else f.h || o.h end)
  from folds f join ordered o on f.r = o.r and o.step = f.step + 1
), ends as (
  select r, max_by(h, step) as folded_root from folds group by r
), proofs as (
  select r, string_agg(h, '' order by step) as proof from ordered group by r
)
select doc_id, leaf, s.h as subroot, t.h as root, sha256(coalesce(proof, '')) as proof_sha256, folded_root, folded_root = t.h as verified
from placed p join subroots s on p.tree = s.tree join high t on t.n = 1 join ends e on p.r = e.r left join proofs q on p.r = q.r
"""
