from __future__ import annotations

import base64

import public_tokenizers as P
import pytest
import tiktoken
from tests.llm.helpers import corpus, sha

from weftline.llm.byte_bpe import decode_ids, encode_texts, token_table

ODD = [
    "it's  we'll 'S x'd\n\n  y\t z ", " ", "  ", "\n", "a b  c  d", "x" * 3000, "日本語 テスト 123abc ½²", "é 🙂🙂 !!! ?a",
    " lead", "trail ", "a \n b", "a\n b", "\r\n \r\n", "don't 're'", "<|endoftext|> x", "\x00\x1c \x1d a\x85b ​﻿", "'", "' s", "a'", "١٢٣ x٣",
]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("parts", [1, 4])
def test_same_ids_as_the_library_and_exact_round_trip(spark, parts):
    enc = reference()
    rows = corpus(40, 8) + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, ids string").repartition(parts)
    got = sorted(((r.doc_id, list(r.ids), r.decoded, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_texts(docs).collect()), key=str)
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, ids, t or "", len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=str)


def test_decoding_joins_the_table(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None, "a a a b"])], "doc_id long, text string")
    out = {r.doc_id: r.decoded for r in decode_ids(encode_texts(docs), token_table(spark)).collect()}
    assert out == {i: t or "" for i, t in enumerate([*ODD, None, "a a a b"])}


def test_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("pattern", [r"\s+|\w+|[^\s\w]+", r"[^ ]+ ?| ", r"(?:\w+\s)+|."])
def test_other_patterns(spark, pattern):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = corpus(20, 4) + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), pattern=pattern).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), enc.encode_ordinary(t or "")) for i, t in rows)
