from __future__ import annotations

import random

import numpy as np
import xxhash
from tests.llm.helpers import corpus

from weftline.llm.components import connected
from weftline.llm.simhash_dedup import covering_masks, hamming_links, near_duplicates, one_of_each


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {x: find(x) for x in nodes}


def test_masks_cover_every_pair_within_the_radius():
    rng, masks = random.Random(1), covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(diff & m == 0 for m in masks)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in connected(spark.createDataFrame([*pairs, (5, 5), (None, 3)], "x long, y long")).collect()}
    links = {frozenset(p) for p in pairs}
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    assert got == components(nodes, lambda a, b: frozenset((a, b)) in links)


def test_hot_keys_are_cut_into_cells(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for _ in range(150)} | {rng.getrandbits(63) for _ in range(40)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in connected(hamming_links(fps, 4, cell=16)).collect()}
    want = components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {v: got.get(v, v) for v in values} == want


def test_against_brute_force(spark):
    rows = corpus(50, 4)
    rng = random.Random(5)
    rows += [(100 + i, " ".join(rng.sample(["One", "two"], 1) + t.split()[1:])) for i, (_, t) in enumerate(rows[:30]) if t and len(t.split()) > 30]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    root = components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), fp in zip(rows, fps, strict=True):
        if i is not None:
            least[root[fp]] = min(least.get(root[fp], i), i)
    assert got == sorted(((i, f"{fp:016x}", least.get(root[fp])) for (i, _), fp in zip(rows, fps, strict=True)), key=str)
    assert np.unique([g[2] for g in got if g[2] is not None]).size < len(got) - 8


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_of_each(spark):
    rows = [(3, "a b c d e f", "x"), (1, "A b c  d e f", None), (2, None, "y"), (None, "", "z"), (7, "g h i j k l m", "v"), (7, "g h i j k l m", "u"), (None, "only here now", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, one_of_each(docs).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[5], rows[6]], key=str)
    assert one_of_each(docs.limit(0)).collect() == []
