"""Filter audit, certified quality rules and the Merkle manifest: edge rows against SQL, and brute force."""

import random
from collections import Counter
from fractions import Fraction
from hashlib import sha256
from itertools import permutations
from math import comb

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import catalogue, filteraudit, merkle, qualityrules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def sentence(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def edge_docs():
    rng = random.Random(11)
    copy = sentence(rng, 130)
    window = "a b c " * 30
    texts = [
        None, "", " \t\n\x0b ", "ONE TWO", copy, copy, copy + " ", copy.upper(), window, "la " * 400, "x\n\nx\n y\nx\ny\n\ty", sentence(rng, 120) + " # $ <|>",
        "é" * 60 + " ÀB " + "日本 " * 40, sentence(rng, 20_000), sentence(rng, 90) + "\n" + sentence(rng, 90), "\x00 \x1f a\u0085b c\x1c d", "$%&*|#<>",
    ]
    rows = [(3 * k + 1, t, [None, "en", "", "fr"][k % 4], [None, "s", ""][k % 3], None if k % 5 == 0 else len(t or "")) for k, t in enumerate(texts)]
    rows += [(2, copy, "en", "s", 7), (500, copy, None, None, None), (501, None, "zz", None, 0), (502, "", "zz", "", 0)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_docs(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(d[0], [None, 0, 1][k % 3], [1, None, 0][k % 3]) for k, d in enumerate(edge_docs())] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


def tables(spark, tmp_path, **frames):
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def cells(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("~" if x is None or x != x else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", ["op11_filteraudit", "op12_qualityrules", "op13_merkle"])
def test_edge_rows_against_sql(spark, docs, labels, tmp_path, name):
    sf = tables(spark, tmp_path, documents=docs, labels=labels)
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    db.execute(f"create view labels as select * from '{sf}/labels.parquet/*.parquet'")
    want = db.sql(catalogue.ORACLES[name]).fetchdf()
    assert len(got) and cells(got) == cells(want[got.columns])


@pytest.mark.parametrize("name", ["op11_filteraudit", "op12_qualityrules", "op13_merkle"])
def test_empty_tables(spark, labels, tmp_path, name):
    sf = tables(spark, tmp_path, documents=spark.createDataFrame([], DOCS), labels=labels.limit(0))
    assert catalogue.QUERIES[name](spark, sf).count() == 0


# --- op11 --------------------------------------------------------------------------------------


def brute_audit(rows, marks):
    def fails(k):
        _, text, *_ = rows[k]
        text = text or ""
        w = text.encode().split()
        capitals = sum("A" <= c <= "Z" for c in text)
        same = any((r[1] or "") == text and r[0] is not None and rows[k][0] is not None and r[0] < rows[k][0] for r in rows)
        tests = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * capitals > 10 * len(text), any(c in "#$%&*|" for c in text), same]
        return {x for x, t in zip("ABCDE", tests) if t}

    failed = [fails(k) for k in range(len(rows))]
    out = {}
    for part in {r[2] or "" for r in rows}:
        inside = [k for k in range(len(rows)) if (rows[k][2] or "") == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left = list(inside)
            for step, x in enumerate(order, 1):
                gone = [k for k in left if x in failed[k]]
                left = [k for k in left if x not in failed[k]]
                shares[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in failed[k] for k in inside) - len(gone), sum(failed[k] == {x} for k in inside),
                    sum(marks.get(rows[k][0], (0, 0))[0] for k in gone), sum(marks.get(rows[k][0], (0, 0))[1] for k in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return out


def test_audit_against_single_removals(spark, docs, labels):
    rows = edge_docs()
    extra = spark.createDataFrame([(None, rows[3][1], "en", None, None), (None, None, None, None, None), rows[5]], DOCS)
    rows = rows + [tuple(r) for r in extra.collect()]
    marks = {}
    for i, q, t in labels.collect():
        old = marks.get(i, (0, 0)) if i is not None else None
        if i is not None:
            marks[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    clash = docs.union(extra).withColumns({c: F.lit("x") for c in ("mask", "part", "good", "toxic", "hash", "id", "n")})
    got = filteraudit.audit(filteraudit.mask_counts(clash, labels), "ABCDE").toPandas()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    have = {(r.part, r.filter_order, r.step): [getattr(r, c) for c in columns] for r in got.itertuples()}
    assert have == brute_audit(rows, marks)


def test_audit_of_other_filter_counts(spark):
    rows = [("p", m, 3 + m, 1, 0) for m in range(4)] + [("p", 3, 2, 0, 1)]
    counts = spark.createDataFrame(rows, "part string, mask int, docs long, good long, toxic long")
    got = filteraudit.audit(counts, "XY").toPandas().set_index(["filter_order", "step"])
    assert len(got) == 4 and got.loc[("XY", 1), "removed"] == 4 + 6 + 2 and got.loc[("XY", 2), "kept"] == 3
    assert got.loc[("YX", 2), "redundant"] == 8 and got.loc[("YX", 1), "toxic_lost"] == 1
    with pytest.raises(ValueError):
        filteraudit.audit(counts, "XX")


def test_removal_steps_are_the_min_plus_product():
    orders, positions, steps = filteraudit.removal_steps(4)
    for o, order in enumerate(orders):
        assert [positions[f, o] for f in order] == [1, 2, 3, 4]
        for mask in range(16):
            first = next((s for s, f in enumerate(order, 1) if mask >> f & 1), 5)
            assert steps[mask, o] == first


# --- op12 --------------------------------------------------------------------------------------


def test_binomial_tail_is_exact():
    for n, k, p in [(1, 0, 0.5), (10, 3, 0.05), (400, 12, 0.05), (400, 60, 0.05), (90, 0, 0.05), (2000, 99, 0.05), (50, 50, 0.1), (30, 29, 0.9)]:
        q = Fraction(p)
        want = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
        assert qualityrules.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert qualityrules.binomial_tail(900_000, 1_000_000, 0.05) == pytest.approx(1.0)
    assert qualityrules.binomial_tail(0, 1_000_000, 0.05) == 0.0


def brute_statistics(text):
    w = (text or "").encode().split()
    n = len(w)
    windows = Counter(tuple(w[k : k + 3]) for k in range(n - 2))
    covered = {k + d for k in range(n - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return [n, sum(len(x.decode()) for x in w), symbols, len(lines), len(lines) - len(set(lines)), len(covered)]


def test_statistics_of_whole_texts(spark, docs):
    got = qualityrules.with_statistics(docs.withColumn("n_words", F.lit("mine"))).toPandas().set_index("doc_id")
    assert "text" not in got.columns and len(got) == len(edge_docs())
    for i, text, *_ in edge_docs():
        assert list(got.loc[i, qualityrules.STATISTICS]) == brute_statistics(text)


def labelled_rows(spark, n, *, good_symbols, strata=("a", None)):
    """Documents that pass the base; bad ones have 20 % symbols, and so have some per cent of the good ones."""
    rows = []
    for k in range(n):
        good = (k // 2) % 4 != 0
        symbols = 200 if not good or (k // 8) % 100 < good_symbols else 0
        rows.append((k, strata[k % len(strata)], 200, 1000, symbols, 10, 0, 0, int(good)))
    columns = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, quality int"
    return spark.createDataFrame(rows, columns)


def test_cutoffs_only_stand_with_enough_evidence(spark):
    many = labelled_rows(spark, 4000, good_symbols=0)
    certs = qualityrules.calibrate(many, many.select("doc_id", "quality"))
    found = certs.toPandas()
    assert set(found["rule"]) == {"symbols"} and len(found) == 2
    assert (found["certified"] == found["picked"]).all() and (found["k_rejected"] == 0).all() and (found["bound"] <= 0.025).all()
    judged = qualityrules.judge(many, certs).toPandas()
    assert (judged["kept"] == (many.toPandas()["quality"] == 1)).all()
    # too few labels, or too many good ones rejected: everything stays
    few = labelled_rows(spark, 160, good_symbols=0)
    assert qualityrules.judge(many, qualityrules.calibrate(few, few.select("doc_id", "quality"))).filter("not kept").count() == 0
    risky = labelled_rows(spark, 4000, good_symbols=8)
    assert qualityrules.judge(many, qualityrules.calibrate(risky, risky.select("doc_id", "quality"), price=1)).filter("not kept").count() == 0


def test_extra_columns_survive_the_rules(spark, docs, labels):
    wide = docs.union(docs).withColumns({c: F.lit("mine") for c in ("stratum", "rule", "level", "good", "hold", "certified", "kept", "base_failed")})
    counted = qualityrules.with_statistics(wide)
    out = qualityrules.judge(counted, qualityrules.calibrate(counted, labels)).toPandas()
    assert len(out) == 2 * len(edge_docs())
    assert all((out[c] == "mine").all() for c in ("rule", "level", "good", "hold", "certified"))
    assert out["kept"].dtype == bool and out.loc[out["base_failed"], "kept"].sum() == 0


def test_false_rejections_stay_below_the_risk(spark):
    """Over many draws of labels, the true risk of the chosen cutoffs exceeds alpha at most in a share delta of them."""
    rng = np.random.default_rng(3)
    most = len(qualityrules.RULES["symbols"][2])
    # the j strictest cutoffs truly reject these shares of good documents
    shares = np.array([0.002, 0.006, 0.012, 0.02, 0.03, 0.04, 0.048, 0.055, 0.07, 0.1])
    alpha, delta, exceeded = 0.05, 0.1, 0
    for _ in range(400):
        hold = rng.multinomial(600, np.append(np.diff(np.append(0, shares)), 1 - shares[-1])).cumsum()
        stands = 0
        for j in range(most):
            if qualityrules.binomial_tail(int(hold[j]), 600, alpha) > delta:
                break
            stands = j + 1
        exceeded += stands > 0 and shares[stands - 1] > alpha
    assert exceeded <= 400 * delta * 1.3


# --- op13 --------------------------------------------------------------------------------------


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, witness of every leaf) by levels."""
    level, at, witness = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, p in enumerate(at):
            s = p ^ 1
            witness[k].append((0, None) if s >= len(level) else (1 if s > p else -1, level[s]))
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], witness


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 33])
def test_incremental_witnesses_equal_the_whole_tree(n):
    leaves = [h(str(k)) for k in range(n)]
    tree = merkle.OpenSubtrees()
    for x in leaves:
        tree.append(x)
    root = tree.close(merkle.depth(n))
    assert (root, tree.witness) == plain_tree(leaves)
    # appended as complete subtrees of four, the roots' witnesses are the upper part of the leaves'
    upper = merkle.OpenSubtrees()
    for k in range(0, n, 4):
        block = merkle.OpenSubtrees(witnesses=False)
        for x in leaves[k : k + 4]:
            block.append(x)
        upper.append(block.close(min(2, merkle.depth(n))), 2 if n > 4 else merkle.depth(n))
    assert upper.close(merkle.depth(n)) == root
    if n > 4:
        assert [tree.witness[k][2:] for k in range(n)] == [upper.witness[k // 4] for k in range(n)]
    with pytest.raises(ValueError):
        small = merkle.OpenSubtrees()
        small.append(leaves[0])
        small.append(leaves[0], 3)


def test_manifest_in_small_blocks_against_whole_trees(spark):
    """Several rounds of blocks, more groups than ranges, null and repeated ids, clashing columns."""
    rng = random.Random(4)
    rows = []
    for k in range(700):
        group = None if k % 3 == 0 else f"g{rng.randrange(20)}" if k % 50 == 0 else "big"
        rows.append((None if k % 97 == 0 else rng.randrange(600), rng.choice(["a", "", None, "é" * 50]), group, f"s{k % 5}", k))
    rows += rows[:5]
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("leaf", "pos", "tree", "hash", "at", "size", "group", "witness", "root")})
    got = merkle.manifest(frame, keep=["n_chars"], bits=3).withColumn("folded", merkle.folded(F.col("leaf"), F.col("witness"))).toPandas()
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i, h(*map(value, (i, source, lang, n, text)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    want, roots = {}, []
    for g in names:
        leaves = [x for _, x in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
        root, witness = plain_tree(leaves)
        roots.append(root)
        for x, w in zip(leaves, witness):
            want.setdefault(x, []).append((root, w))
    root, tops = plain_tree(roots)
    above = dict(zip(roots, tops))
    have = {}
    for r in got.itertuples():
        assert r.root == root == r.folded
        have.setdefault(r.leaf, []).append((r.subroot, [(s["side"], s["digest"]) for s in r.witness]))
    assert len(got) == len(rows)
    key = lambda v: sorted(v, key=repr)
    assert {x: key(v) for x, v in have.items()} == {x: key([(s, w + above[s]) for s, w in v]) for x, v in want.items()}


def test_tampering_is_told(spark, docs, labels, tmp_path):
    sf = tables(spark, tmp_path, documents=docs, labels=labels)
    got = catalogue.QUERIES["op13_merkle"](spark, sf).toPandas()
    assert (got["verified"] == (got["folded_root"] == got["root"])).all()
    plain = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 7 != 0).alias("plain"), "n_chars").toPandas()
    want = plain.set_index("doc_id").eval("plain or n_chars.isna()", engine="python")
    assert (got.set_index("doc_id")["verified"].sort_index() == want.sort_index()).all() and not want.all()
