from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import corpus

from weftline.llm.quality_rules import ALPHA, binomial_tail, features, judge


def brute(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen, where = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            where |= {p + k for p in places for k in range(8)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(where))


def test_features(spark):
    rows = corpus(40, 9) + [(500, "a b c d e f g h " * 5), (501, "a " * 30), (502, "x#*$%&|<> y\n\nx\nx\n \n"), (503, "z " * 50_000), (504, "a b c d e f g h i a b c d e f g h j")]
    docs = spark.createDataFrame([(i, t, "en", 3) for i, t in rows], "doc_id long, text string, lang string, n_words int")
    got = sorted((tuple(r) for r in features(docs).drop("stratum").collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (10, 3, 0.1), (500, 20, 0.05), (20000, 190, 0.01), (0, 0, 0.5)])
def test_binomial_tail(spark, n, k, p):
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    got = spark.range(1).select(binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def made(n=3000):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(["river", "stone", "cloud", "ember"]) + str(rng.randrange(1000)) + ("%%%" if not good and i % 2 else "") for _ in range(rng.randint(20, 60)))
        docs.append((i, text, rng.choice(["en", None])))
        labels.append((i, int(good)))
    return docs, labels


def test_thresholds_reject_bad_documents_and_bound_false_rejections(spark):
    docs, labels = made()
    d = spark.createDataFrame([*docs, (9000, None, "en"), (9001, docs[0][1], "xx"), (None, docs[0][1], None)], "doc_id long, text string, lang string")
    y = spark.createDataFrame([*labels, (1, None), (None, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in judge(d, y).collect()}
    good = [got[i].kept for i, v in labels if v]
    bad = [got[i].kept for i, v in labels if not v and i % 2]
    assert 1 - sum(good) / len(good) <= ALPHA and not any(bad)
    assert got[9000].base_failed and not got[9000].kept and got[9001].kept and got[None].kept


def test_without_labels_only_the_base_checks_hold(spark):
    docs, labels = made(60)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    assert all(r.kept for r in judge(d, y.limit(0)).collect())
    assert all(r.kept for r in judge(d, y).collect())  # too few to be sure of anything
    assert judge(d.limit(0), y).collect() == []


def test_long_repetitive_texts(spark):
    """The work is in proportion to a text's length (and its logarithm), whatever it repeats."""
    texts = ["a b c d " * 40_000, "the end. \n" * 30_000, " ".join(f"{i} {i % 7}" for i in range(60_000))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    began = time.perf_counter()
    got = sorted(tuple(r) for r in features(docs).drop("stratum").collect())
    assert time.perf_counter() - began < 60
    assert got == [(i, *brute(t)) for i, t in enumerate(texts)]
