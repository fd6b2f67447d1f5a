from __future__ import annotations

import random

import pytest

from weftline.operators import exclude, finalize, retrieve
from weftline.operators.finalize import rank_suggestions

HITS = "src int, pos int, tgt string, sim double"


def select(spark, rows, floor=0.0, n=9, m=99):
    got = retrieve.select_candidates(spark.createDataFrame(rows, HITS), floor, n, m).orderBy("place").collect()
    return [(r.tgt, r.src) for r in got]


def test_floor_cap_round_robin_and_pairing(spark):
    assert select(spark, [(0, 1, "A", 0.9), (0, 2, "B", 0.1)], floor=0.2) == [("A", 0)]
    assert select(spark, [(0, i, f"T{i}", 1 - i / 10) for i in range(1, 6)], n=3) == [("T1", 0), ("T2", 0), ("T3", 0)]
    rows = [(1, 1, "A", 0.9), (1, 2, "B", 0.3), (2, 1, "C", 0.5), (2, 2, "D", 0.4)]
    assert [t for t, _ in select(spark, rows)] == ["A", "C", "D", "B"]
    assert [t for t, _ in select(spark, rows, m=2)] == ["A", "C"]
    assert select(spark, [(0, 1, "T", 0.6), (1, 1, "T", 0.9), (1, 2, "U", 0.5)]) == [("T", 1), ("U", 1)]


def procedural(hits, floor, n, m):
    best, order = {}, []
    for src, _, tgt, sim in sorted(hits):
        if tgt not in best:
            order.append(tgt)
        if tgt not in best or sim > best[tgt][1]:
            best[tgt] = (src, sim)
    groups = {}
    for tgt in order:
        groups.setdefault(best[tgt][0], []).append((tgt, best[tgt][1]))
    for src in groups:
        groups[src] = [x for x in sorted(groups[src], key=lambda x: -x[1]) if x[1] >= floor][:n]
    out = []
    for rank in range(n):
        row = [(g[rank], s) for s, g in groups.items() if rank < len(g)]
        out += [(t, s) for (t, _), s in sorted(row, key=lambda x: -x[0][1])]
    return out[:m]


@pytest.mark.parametrize("seed", range(8))
def test_selection_like_a_loop(spark, seed):
    rng = random.Random(seed)
    hits = []
    for src in range(4):
        sims = sorted((rng.randint(1, 6) / 10 for _ in range(rng.randint(0, 6))), reverse=True)
        hits += [(src, p, t, s) for p, (t, s) in enumerate(zip(rng.sample("ABCDEFGH", len(sims)), sims, strict=True), 1)]
    if hits:
        assert select(spark, hits, 0.2, 2, 5) == procedural(hits, 0.2, 2, 5)


def test_knn_is_exact(spark, monkeypatch):
    unit = [[float(i == j) for j in range(4)] for i in range(4)]
    targets = spark.createDataFrame([("a0", "A", unit[0]), ("a1", "A", unit[1]), ("b", "B", unit[2]), ("c", "C", unit[3]), ("z", "C", [0.0] * 4), ("n", "C", None)], "tgt string, tgt_note string, v array<double>")
    sources = spark.createDataFrame([(0, "Q", [3.0, 3.0, 0.0, 0.0]), (1, "A", [1.0, 0.0, 0.5, 0.0])], "src int, src_note string, v array<double>")
    for block in (1, 100):
        got = {(r.src, r.pos): (r.tgt, round(r.sim, 4)) for r in retrieve.knn(sources, targets, 2, block_rows=block).collect()}
        assert got == {(0, 1): ("a0", 0.7071), (0, 2): ("a1", 0.7071), (1, 1): ("b", 0.4472), (1, 2): ("c", 0.0)}
    same = {(r.src, r.pos): (r.tgt, round(r.sim, 4)) for r in retrieve.knn_expression(sources, targets.where("v is not null"), 2).collect()}
    assert same == got
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 1)  # more sources than a block: none is lost
    many = {(r.src, r.pos): (r.tgt, round(r.sim, 4)) for r in retrieve.knn_expression(sources, targets.where("v is not null"), 2).collect()}
    assert many == got
    assert retrieve.knn(sources, targets, 0).count() == 0
    assert {r.tgt for r in retrieve.knn(sources, targets, 9, ["A"]).where("src = 0").collect()} == {"b", "c"}


def test_linked_targets_drop_out(spark):
    hits = spark.createDataFrame(
        [("T", None, 0, None), ("T", "HID", 1, "Alpha"), ("T", None, 2, "Beta"), ("U", None, 0, None)], "tgt_note string, tgt_heading_id string, tgt_heading_index int, tgt_heading_text string"
    )

    def left(*links):
        table = spark.createDataFrame(list(links), "target_uuid string, search_string string")
        return sorted((r.tgt_note, r.tgt_heading_index) for r in exclude.not_linked_chunks(hits, table).collect())

    assert left(("T", None)) == [("T", 1), ("T", 2), ("U", 0)]
    assert left(("HID", None)) == [("T", 0), ("T", 2), ("U", 0)]
    assert left(("T", "*Beta")) == left(("T", "Beta")) == [("T", 0), ("T", 1), ("U", 0)]
    assert len(left(("T", "*Gamma"), ("X", None))) == 4


SUG = "pos int, file_id string, heading_id string, heading_text string, confidence int"


def test_ranking(spark):
    rows = [(1, "A", None, None, 1), (2, "A", None, None, 3), (3, "B", None, "H", 3), (4, "ME", None, None, 3), (5, "C", None, None, 2), (6, "A", None, "H", 2), (7, "D", None, None, 3)]
    links = spark.createDataFrame([("D", None)], "target_uuid string, search_string string")
    df = spark.createDataFrame(rows, SUG)
    got = [(r.id, r.pos) for r in rank_suggestions(df, links, "ME", 12).orderBy("rank").collect()]
    assert got == [("s01", 2), ("s02", 3), ("s03", 5), ("s04", 6)]
    assert [r.pos for r in rank_suggestions(df, None, "ME", 2).orderBy("rank").collect()] == [2, 3]
    many = spark.createDataFrame([(i, f"N{i}", None, None, 1) for i in range(120)], SUG)
    assert {r.id for r in rank_suggestions(many, None, "", 120).where("rank in (9, 100)").collect()} == {"s09", "s100"}


def test_envelope(spark):
    empty = spark.createDataFrame([], "rank int, id string, type string, confidence int, why string, target_excerpt string, target string, source_anchor string")
    row = finalize.envelope(empty, "T", "id", "text", "now").first()
    assert row.version == 1 and row.suggestions == [] and row.source.content_hash.startswith("sha256:982d9e3eb996f559")
    assert '"suggestions":[]' in finalize.to_json(finalize.envelope(empty, "T", "id", "text", "now")).first()[0]
