"""Language identification and toxicity against plain versions over dictionaries of the features themselves."""

import math
import random
import re
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from labelloom.llm import langid, toxicity

DOCS = "doc_id long, text string, lang string"


def texts(seed, n):
    rng = random.Random(seed)
    syllables = {"xx": ["ka", "lo", "mi"], "yy": ["schen", "ung", "ö"], "zz": ["тра", "но", "ж"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(0, 60))]
        rows.append((k, rng.choice(["", "  ", "12 "]) + rng.choice([" ", "\n", ", "]).join(words).title(), lang if k % 9 else None))
    return rows + [(n, None, "xx"), (n + 1, "", "yy"), (n + 2, "42 !", "zz"), (n + 3, "Ka", None), (n + 4, "тра" * 9000, "zz"), (None, "lo", "xx")]


def trigrams(text):
    chars = "  " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
    return [g for g in (chars[k : k + 3] for k in range(len(chars) - 2)) if g != "   "]


def plain_bayes(rows, buckets):
    counts, docs = {}, Counter()
    for _, text, lang in rows:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(trigrams(text))
            docs[lang] += 1
    names = sorted(docs)
    out = {}
    for i, text, _ in rows:
        grams = trigrams(text)
        if not any(c.isalpha() for c in text or ""):
            out[i] = (langid.UNDETERMINED, 0.0)
            continue
        logs = []
        for lang in names:
            total = sum(counts[lang].values()) + langid.SMOOTHING * buckets
            own = sum(math.log((counts[lang][g] + langid.SMOOTHING) / total) for g in grams)
            logs.append(own * min(len(grams), langid.EVIDENCE) / len(grams) + math.log(docs[lang] / sum(docs.values())))
        best = max(range(len(names)), key=lambda k: (logs[k], -k))
        out[i] = (names[best], 1 / sum(math.exp(x - logs[best]) for x in logs))
    return out


def test_language_equals_plain_bayes(spark):
    rows, buckets = texts(3, 150), 1 << 20  # so many buckets that no two of these trigrams share one
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    model = langid.train(df.filter("text is not null"), buckets=buckets)
    got = {r["doc_id"]: r for r in langid.predict(df.withColumn("score", F.lit("mine")), model).collect()}
    want = plain_bayes(rows, buckets)
    assert set(got) == set(want)
    for i, (lang, score) in want.items():
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4)


def test_language_ties_go_to_the_first(spark):
    rows = [(1, "abc abc", "b"), (2, "abc abc", "a"), (3, "abc", None), (4, "zzz", None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.train(df)).collect()}
    assert set(got.values()) == {"a"}


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pairs = [(1, a, b) for a, b in zip(words, words[1:])] + [(2, a, b) for a, b in zip(words, words[2:])]
    return {(w,) for w in words} | set(pairs)


def plain_ftrl(examples):
    """Passes of FTRL-proximal; a pass starts from the weights of the one before."""
    share = (sum(y for _, y in examples) + 0.5) / (len(examples) + 1)
    weights, bias = {}, math.log(share / (1 - share))
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    sign = lambda v: (v > 0) - (v < 0)
    for _ in range(toxicity.PASSES):
        z = {f: -w * (b / a + l2) - sign(w) * l1 for f, w in weights.items()}
        n, z0, n0 = {}, -bias * b / a, 0.0

        def weight(f, z=z, n=n):
            v = z.get(f, 0.0)
            return -(v - sign(v) * l1) / ((b + math.sqrt(n.get(f, 0.0))) / a + l2) if abs(v) > l1 else 0.0

        for feats, y in examples:
            x = max(len(feats), 1) ** -toxicity.POWER
            w0 = -z0 / ((b + math.sqrt(n0)) / a)
            own = {f: weight(f) for f in feats}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(own.values()) * x + w0))))
            g = (p - y) * x
            for f, w in own.items():
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / a * w
                n[f] = old + g * g
            z0 += (p - y) - (math.sqrt(n0 + (p - y) ** 2) - math.sqrt(n0)) / a * w0
            n0 += (p - y) ** 2
        weights = {f: w for f in z if (w := weight(f))}
        bias = -z0 / ((b + math.sqrt(n0)) / a)
    return weights, bias


def test_toxicity_equals_plain_ftrl(spark):
    rng = random.Random(8)
    rows, marks = [], {}
    for k in range(120):
        bad = rng.random() < 0.3
        words = [rng.choice(["vile", "foul"]) if bad and rng.random() < 0.2 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 25))]
        rows.append((k, " ".join(words).title() + rng.choice(["", "!", "."]), None))
        marks[k] = int(bad)
    rows += [(200, None, None), (201, "", None), (202, "VILE foul " * 4000, None), (203, "new words", None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([*marks.items(), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, toxicity.train(df, labels, bits=24)).collect()}
    order = sorted(marks, key=lambda i: int(md5(f"7|toxic|{i}".encode()).hexdigest()[:13], 16))
    weights, bias = plain_ftrl([(features(rows[i][1]), marks[i]) for i in order])
    for i, text, _ in rows:
        feats = features(text)
        logit = sum(weights.get(f, 0.0) for f in feats) * max(len(feats), 1) ** -toxicity.POWER + bias
        want = 1 / (1 + math.exp(-max(-35, min(35, logit))))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["predicted"] == int(want >= 0.3)
