from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.toxicity import BINS, Machine, drop_toxic, fit, score, toxicity, word_bins


def made(n=3000, seed=1):
    """Toxic if an insult and a group are mentioned together; either alone is fine."""
    rng = random.Random(seed)
    vocab = [f"word{i}x" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words = rng.sample(vocab, rng.randint(3, 30)) + ["Grubby!"] * a + ["martians,"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    return docs, labels


def test_learns_interactions_and_reports_held_out_accuracy(spark):
    docs, labels = made()
    d = spark.createDataFrame([(i, t, 0.5) for i, t in [*docs, (9000, None), (9001, ""), (None, "grubby martians")]], "doc_id long, text string, held_out double")
    y = spark.createDataFrame([(i, v, 1) for i, v in [*labels, (5, None), (None, 1)]], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity(d, y).collect()}
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in docs) and not got[None].held_out
    held = [(got[i].predicted, v) for i, v in labels if got[i].held_out]
    assert len(held) > 400 and sum(p == v for p, v in held) / len(held) > 0.97
    assert got[9000].score == got[9001].score and got[None].predicted == 1


def test_labels_of_held_out_rows_play_no_part(spark):
    docs, labels = made(400, 2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - v if zlib.crc32(str(i).encode()) % 5 == 0 else v) for i, v in labels]
    one, two = (toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect() for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_without_two_classes(spark, labels):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len({r.score for r in got}) == 1


def test_drop_keeps_columns_and_empty_table(spark):
    docs, labels = made(1500, 3)
    d = spark.createDataFrame([(i, t, [1, 2]) for i, t in docs], "doc_id long, text string, extra array<int>")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = drop_toxic(d, y)
    assert out.schema.simpleString() == d.schema.simpleString()
    left = {r.doc_id for r in out.collect()}
    assert sum((i in left) == (v == 0) for i, v in labels) > 1400
    assert toxicity(d.limit(0), y.limit(0)).collect() == []
    clash = d.withColumns({"score": F.lit("own"), "a`b c.d": F.lit(1), "y": F.lit(7)})
    assert drop_toxic(clash, y).schema == clash.schema and {r.doc_id for r in drop_toxic(clash, y).collect()} == left
    scored = score(clash, fit(d, y))
    assert scored.columns == ["doc_id", "text", "extra", "a`b c.d", "y", "score"] and dict(scored.dtypes)["score"] == "double"


def test_repeated_ids_and_very_long_texts(spark):
    docs, labels = made(600, 5)
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    long = "grubby martians " + "word1x " * 400_000
    once = spark.createDataFrame([*docs, (700, long), (701, long[:1])], "doc_id long, text string")
    again = once.unionAll(once.where("doc_id < 300")).unionAll(once.where("doc_id = 700"))
    one, two = ({r.doc_id: r.score for r in toxicity(d, y).collect()} for d in (once, again))
    assert one == two and toxicity(again, y).count() == 602 + 300 + 1 and one[700] > 0.5


def test_scores_against_brute_force(spark):
    """The machine written out: every pair of a text's bins, one by one."""
    rng = random.Random(6)
    words = [f"{rng.choice('abcdé')}{rng.choice('xyz')}{i}" for i in range(60)]
    bins = sorted({b for w in words[:40] for b in word_bins(w)})
    machine = Machine(rng.uniform(-1, 1), np.array(bins), np.array([rng.uniform(-1, 1) for _ in bins]), np.array([[rng.uniform(-1, 1) for _ in range(3)] for _ in bins]))
    texts = [None, "", *(" ".join(rng.choice(words) + rng.choice(["", "!", "."]) for _ in range(rng.randint(1, 30))) for _ in range(50))]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), machine).collect()}
    for i, text in enumerate(texts):
        own = sorted({b for w in (text or "").lower().split() for b in word_bins(w)} & set(bins))
        at = [bins.index(b) for b in own]
        z = machine.constant + sum(machine.weight[k] for k in at) + sum(float(machine.vector[k] @ machine.vector[m]) for n, k in enumerate(at) for m in at[:n])
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_every_telling_bin_is_kept(spark):
    rng = random.Random(4)
    insults = [f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}qx{i % 7}" for i in range(1300)]
    docs, labels = [], []
    for i in range(4000):
        y = int(rng.random() < 0.3)
        words = [f"w{rng.randrange(500)}" for _ in range(8)] + rng.sample(insults, 9) * y
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    seen, toxic, rows = [0] * BINS, [0] * BINS, [0, 0]
    for (i, text), (_, y) in zip(docs, labels, strict=True):
        if zlib.crc32(str(i).encode()) % 5:
            rows[y] += 1
            for b in {b for w in set(text.split()) for b in word_bins(w)}:
                seen[b] += 1
                toxic[b] += y
    part = lambda x, e: x * math.log(x / e) if x else 0
    n, p = sum(rows), rows[1] / sum(rows)
    ratio = lambda m, a: 2 * (part(a, m * p) + part(m - a, m * (1 - p)) + part(rows[1] - a, (n - m) * p) + part(rows[0] - m + a, (n - m) * (1 - p)))
    want = [b for b in range(BINS) if seen[b] >= 3 and ratio(seen[b], toxic[b]) > 10.8]
    machine = fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(want) > 1024 and machine.bins.tolist() == want
