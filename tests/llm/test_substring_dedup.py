from __future__ import annotations

import numpy as np
import pytest
from tests.llm.helpers import corpus, sha

from weftline.llm import common, substring_dedup
from weftline.llm.substring_dedup import dedup_substrings


def brute(rows, width):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in docs:
        for k in range(len(words) - width + 1 if i is not None else 0):
            w = tuple(words[k : k + width])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - width + 1 if i is not None else 0):
            if least[tuple(words[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(words), len(gone), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)), sum(k - 1 not in gone for k in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, parts):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(parts)
    got = [tuple(r)[:5] for r in dedup_substrings(docs, window=10).collect()]
    want = brute(rows, 10)
    assert sorted(got, key=str) == want
    assert sum(r[2] for r in want) > 500


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b " * 400_000), (2, "b a " * 60)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans) for r in dedup_substrings(docs).collect()}
    assert got == {1: (800_000, 0, 0), 2: (120, 120, 1)}


def test_windows_of_one_hash_are_told_apart():
    """With a hash of few bits the second one decides between blocks."""
    merge = substring_dedup._merge

    def few(bucket, parts):
        made = []
        for key, payload in parts:
            h, local, ids, check = common.unpack_sorted(payload)
            made.append((key, common.pack_sorted(h & np.uint64(~0xFFFFFFFFFFF & (1 << 64) - 1), local, ids, check)))
        return merge(bucket, made)

    h = np.array([1 << 60, (1 << 60) + 5], np.uint64)
    one = common.pack_sorted(h[:1], np.zeros(1, np.uint16), np.array([1]), np.array([7], np.uint32))
    two = common.pack_sorted(h[1:], np.zeros(1, np.uint16), np.array([2]), np.array([9], np.uint32))
    same = common.pack_sorted(h[1:], np.zeros(1, np.uint16), np.array([2]), np.array([7], np.uint32))
    assert few(0, [(10, one), (11, two)]) == [] and [r[1] for r in few(0, [(10, one), (11, same)])] == [11]
