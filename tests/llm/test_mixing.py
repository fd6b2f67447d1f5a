from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import mixing
from weftline.llm.mixing import mix, mixed_documents, splitting_tree, targets


def brute_targets(sizes, weights):
    """The level that fills the caps to the total, by bisection."""
    total, low, high = sum(sizes), 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights, strict=True)) >= total else (mid, high)
    return [min(3 * s, high * w) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(0, 9) for _ in range(rng.randint(1, 9))]
    weights = [i % 3 + 1 for i in range(len(sizes))]
    got = targets(sizes, weights)
    assert got == pytest.approx(brute_targets(sizes, weights), rel=1e-9, abs=1e-6) and sum(got) == pytest.approx(sum(sizes))


def test_tree_quotas_are_exact_and_spread():
    counts = [0, 1, 700, 50, 3000]
    q = splitting_tree(counts, 13)
    assert q.sum(axis=0).tolist() == counts and q.min() >= 0
    assert np.ptp(q.sum(axis=1)) <= 5 and (splitting_tree(counts, 13) == q).all()
    means = np.mean([splitting_tree([100, 300], 4, s)[0, 0] for s in range(300)])
    assert 24 < means < 26


def made(n=500):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        source = rng.choice(["b", "b", "b", "b", "B", "é", None, "c"])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 60))) or rng.choice([None, "", " \n"]), source, i))
    return [*rows, (7000, "x y z", "b", 1), (7000, "x y z", "b", 1), (None, "u v", "tiny", 2), (None, None, "none", 2)]


@pytest.mark.parametrize(("parts", "block"), [(1, 1 << 18), (6, 50)])
def test_taken_words(spark, parts, block):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(parts)
    got = mix(docs, block_words=block, shards=8).collect()
    size = defaultdict(int)
    for _, text, source, _ in rows:
        size[source] += len((text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True))
    assert len(got) == len(rows)
    source_of = {i: s for i, _, s, _ in rows if i is not None}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id] if r.doc_id is not None else ("tiny" if r.source_size else "none")
        assert r.source_size == size[s] and r.target == pytest.approx(want[s], abs=1e-6) and r.taken <= 3 * r.size
        assert len(r.shards) == (r.taken > 0 and -(-r.taken // r.size)) and all(0 <= x < 8 for x in r.shards)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in order)
    again = mix(docs.repartition(3), block_words=block, shards=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents(spark):
    rows = [(i, t, s, len(t or ""), "en", k) for i, t, s, k in made()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string, size int")
    want = defaultdict(int)
    for r in mix(docs, block_words=100, shards=4).collect():
        want[r.doc_id] += r.taken
    out = mixed_documents(docs, block_words=100, shards=4)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    assert mix(docs).collect() == [] and mixed_documents(docs).collect() == []


def test_more_words_than_blocks_can_count(spark, monkeypatch):
    """Larger blocks change which documents are taken, not how many words."""
    docs = spark.createDataFrame(made(), "doc_id long, text string, source string, target int")
    few = mix(docs, block_words=10, shards=4)
    want = {r.target: r.taken for r in few.groupBy("target").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 20)
    many = mix(docs, block_words=10, shards=4)
    got = {r.target: r.taken for r in many.groupBy("target").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    assert all(abs(got[t] - want[t]) <= 3 for t in want) and got.keys() == want.keys()
    assert all(r.taken <= 3 * r.size for r in many.collect())


def test_shards_follow_the_size_and_hold_the_tree_s_quotas(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), i % 5) for i in range(900)], "doc_id long, text string, source int")
    monkeypatch.setattr(mixing, "SHARD_WORDS", 50)
    got = mix(docs, block_words=1).collect()
    total = sum(r.size for r in got)
    used = {s for r in got for s in r.shards}
    assert max(used) < -(-total // 50) and len(used) > 32
    # blocks of about one document: a shard's copies are its quota, up to blocks that hold none or several
    per = np.bincount([s for r in got for s in r.shards], minlength=-(-total // 50))
    assert per.sum() == sum(len(r.shards) for r in got) and per.max() < 40


def test_draws_beyond_the_generator_are_refused():
    with pytest.raises(ValueError):
        splitting_tree([1 << 30, 5], 2)
