from __future__ import annotations

import base64
import datetime
import os
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken
from tests.llm.helpers import sha
from tests.llm.test_simhash_dedup import brute_fp, components

SF = f"{os.environ.get('WEFTLINE_TEST_DATA', '/root/testdata')}/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, each from the one before."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        out.append(docs.collect())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_each_stage_on_its_own_input(spark, stages):
    docs, clean, lines, unique, mixed, tokens = stages
    assert all(set(r.asDict()) == set(COLUMNS) for part in stages[1:5] for r in part[:1])
    before = {r.doc_id: r for r in docs}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = set(before) - {r.doc_id for r in clean}
    assert all(before[r.doc_id] == r for r in clean) and len(gone & toxic) >= 0.6 * len(toxic) and len(gone) < 0.25 * len(docs)
    assert sorted(r.doc_id for r in lines) == sorted(r.doc_id for r in clean)
    assert all(r.n_chars == len(r.text) for r in lines if r.text != before[r.doc_id].text)
    assert sum(len(r.text) for r in lines) < sum(len(r.text) for r in clean)
    fps = {r.doc_id: brute_fp(r.text) for r in lines}
    root = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    assert sorted(r.doc_id for r in unique) == sorted(first.values())
    words = lambda t: len((t or "").encode().split())
    size, taken, per_source = Counter(), Counter(), Counter()
    for r in unique:
        size[r.doc_id] += words(r.text)
        per_source[r.source] += words(r.text)
    for r in mixed:
        taken[r.doc_id] += words(r.text)
    assert all(taken[i] <= 3 * size[i] for i in taken)
    assert abs(sum(taken.values()) - sum(size.values())) <= 3 * len(per_source)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(enc.encode_ordinary(r.text)), sha(r.text.encode())) for r in mixed)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in tokens) == want


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls everywhere, repeated rows, and columns whose names the stages use themselves."""
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    line = "one two three four five six seven eight nine"
    rows = [(i, f"word{i} other{i * 7} words{i * 13} here{i * 3}\n{line}", "en", "s" if i % 2 else None, None, 0.5, {"k": i}, at, "x") for i in range(40)]
    rows += [(None, None, None, None, None, None, None, None, None), (3, rows[3][1], "en", "s", 5, 0.5, {}, None, "y"), rows[4], rows[4], (99, "", None, "t", 0, None, None, at, None), (None, line, "de", "t", 44, 1.0, None, at, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, rest map<string,int>, line timestamp, shard string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(30)] + [(None, None, None), (2, None, 0), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sizes = docs.dtypes, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{number}"))
        docs = spark.read.parquet(str(tmp_path / f"{number}"))
        sizes.append(docs.count())
        if number < 4:
            assert docs.dtypes == columns
            assert {r.line for r in docs.select("line").collect()} <= {at, None}
    assert sizes[0] == sizes[1] >= sizes[2] > 30 and sizes[3] == sizes[4]
    lines = [x for r in spark.read.parquet(str(tmp_path / "1")).collect() for x in (r.text or "").split("\n")]
    assert lines.count(line) == 1
    kept = Counter((r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "2")).collect())
    assert max(kept.values()) == 1
    for r in docs.collect():
        assert r.n_tokens == len(r.ids)
