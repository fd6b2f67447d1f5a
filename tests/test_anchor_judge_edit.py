from __future__ import annotations

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.oracle import differences

from weftline.config import Settings
from weftline.functions import anchoring as A
from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import frontend as U
from weftline.operators import judge as J
from weftline.plans import registry


def test_wrap_and_insert():
    buffer = "Alpha beta gamma. The end."
    w = A.resolve(buffer, "wrap", "beta gamma", None)
    assert (w["char_start"], w["char_end"], w["expect"], w["template"], w["link_description"]) == (6, 16, "beta gamma", "{{link}}", "beta gamma")
    i = A.resolve(buffer, "insert", "gamma.", " See {{this idea}} too {{x}}.")
    assert (i["char_start"], i["char_end"], i["expect"], i["template"], i["link_description"]) == (17, 17, "", " See {{link}} too {{x}}.", "this idea")
    lit = A.resolve(buffer, "insert", "gamma.", "As {{link}} says")
    assert (lit["template"], lit["link_description"]) == ("As {{link}} says", "gamma.")
    assert A.resolve(buffer, "insert", "gamma.", None)["template"] == "{{link}}"
    assert A.resolve("x" * 60 + "key" + "y" * 60, "wrap", "key", None)["before"] == "x" * 40
    assert A.resolve("a b a", "wrap", "a", None)["char_start"] == 0
    assert A.resolve(buffer, "wrap", "nothing like it at all", None) is None
    assert A.resolve("Alpha. Alpha", "wrap", "Alpha", None, span=(3, 12))["char_start"] == 7


def test_through_markup_and_edits():
    buffer = "The [[id:x][entropy]] of\n  a system grows."
    a = A.resolve(buffer, "wrap", "entropy of a system", None)
    assert a["expect"] == "entropy]] of\n  a system"
    assert A.resolve("We recieve the mesage today.", "wrap", "receive the message", None)["expect"] == "recieve the mesage"
    assert A.resolve("Completely other words here.", "wrap", "receive the message", None) is None


def sellers(text, phrase):
    """(cost, end) by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(phrase, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    end = min(range(len(row)), key=lambda j: (row[j], j))
    return row[end], end


@pytest.mark.parametrize("seed", range(30))
def test_fuzzy_like_the_recurrence(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
    phrase = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
    cost, end = sellers(text, phrase)
    got = A.fuzzy_find(text, phrase, 99)
    assert got is not None and got[1] == end and sellers(text[got[0] : end], phrase)[0] <= cost + abs(end - got[0])
    assert A.fuzzy_find(text, phrase, cost - 1) is None


def verdict(**over):
    base = {"candidate_id": 1, "type": "mention", "confidence": 2, "why": "w", "anchor": {"mode": "wrap", "expect": "x", "insert_text": None}, "target_is_note": False}
    return {**base, **over}


def test_answers(spark):
    good = {"suggestions": [verdict(), verdict(confidence=3)]}
    cases = {
        json.dumps(good): 2,
        "Sure:\n```json\n" + json.dumps(good) + "\n```": 0,
        "```json\n" + json.dumps(good) + "\n```": 2,
        "```\n" + json.dumps(good, indent=1) + "\n```": 2,
        "Let me see. " + json.dumps(good) + " Done.": 2,
        json.dumps({"suggestions": []}): 0,
        json.dumps({"suggestions": [verdict(confidence=4)]}): -1,
        json.dumps({"suggestions": [verdict(type="odd")]}): -1,
        json.dumps({"suggestions": [verdict(extra=1)]}): -1,
        json.dumps({"suggestions": [verdict(anchor={"mode": "wrap", "expect": "x", "z": 1})]}): -1,
        json.dumps({"suggestions": [], "more": 1}): -1,
        "no json": -1,
    }
    cases["Sure:\n```json\n" + json.dumps(good) + "\n```"] = 2
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "k int, answer string")
    got = {}
    for r in J.valid_verdicts(df).collect():
        got[r.k] = -1 if r.invalid else max(got.get(r.k, 0), r.judge_pos + 1)
    assert [got.get(i, 0) for i in range(len(cases))] == list(cases.values())


def test_groups_and_prompts(spark):
    rows = [(1, "B", "b0"), (2, "A", "a0"), (3, "B", "b1")]
    c = spark.createDataFrame(rows, "place int, tgt_note string, tgt_text string").withColumns({"tgt_title": F.col("tgt_note"), "tgt_crumbs": F.lit("c"), "neighbour": F.lit(None).cast("string")})
    g = J.group_candidates(c)
    assert sorted((r.group_pos, r.label, r.tgt_text) for r in g.collect()) == [(1, 1, "b0"), (1, 2, "b1"), (2, 1, "a0")]
    p = {r.tgt_note: r.question for r in J.prompts(g).collect()}
    assert p["B"] == "Target note: B\n\nCandidate 1 - c\nb0\n\nCandidate 2 - c\nb1"


def test_asking_isolates_failures_and_retries(spark):
    def make():
        calls = {}

        def judge(system, prefix, asked, strict):
            calls[asked, strict] = calls.get((asked, strict), 0) + 1
            if asked == "bad":
                raise ValueError("no")
            if asked == "busy" and calls[asked, strict] < 2:
                raise V.Transient
            if asked == "loose" and strict:
                return "not json"
            item = {"candidate_id": 1, "type": "mention", "confidence": 2, "why": f"{asked} {strict}", "anchor": {"mode": "wrap", "expect": "x", "insert_text": None}, "target_is_note": False}
            if asked == "broken":
                item["confidence"] = 9 if strict else 1
            if asked == "never":
                item["extra"] = 1
            return f"```json\n{json.dumps({'suggestions': [item]})}\n```"

        return judge

    df = spark.createDataFrame([("ok",), ("bad",), ("busy",), ("loose",), ("broken",), ("never",)], "question string").coalesce(1)
    got = {r.question: r for r in J.ask(df, make, "note", attempts=2).collect()}
    assert got["bad"].answer is None and "ValueError" in got["bad"].error
    assert "ok True" in got["ok"].answer and "loose False" in got["loose"].answer and got["busy"].error is None
    assert "broken False" in got["broken"].answer and got["never"].answer is None and "schema" in got["never"].error
    kept = J.valid_verdicts(J.ask(df, make, "note", attempts=2).where("error is null"))
    assert {r.question for r in kept.where("not invalid").collect()} == {"ok", "busy", "loose", "broken"}


def test_helpers():
    schema = {"type": "object", "properties": {"minimum": {"type": "integer", "minimum": 1}}}
    assert J.strip_schema(schema) == {"type": "object", "properties": {"minimum": {"type": "integer"}}} and "minimum" in schema["properties"]["minimum"]
    given = J.messages("s", "p", "q", schema_hint=True)
    flat = J.flatten_messages(given)
    assert flat[1]["content"] == "p\n\nq" and isinstance(given[1]["content"], list)
    with pytest.raises(ValueError, match="content"):
        J.answer_text({"content": None})
    with pytest.raises(ValueError, match="api_key"):
        J.provider(Settings(), lambda s: "r", lambda s: "l")
    assert J.provider(Settings(judge_provider="local"), lambda s: "r", lambda s: "l") == "l"


def test_embedding_batches_order_and_retry():
    sizes, waits, fail = [], [], [1]

    def embed(texts):
        if fail and fail.pop():
            raise V.Transient
        sizes.append(len(texts))
        return [[float(t)] for t in texts]

    out = V.embed_batched([str(i) for i in range(300)], embed, wait=waits.append)
    assert sizes == [128, 128, 44] and [v[0] for v in out] == list(range(300)) and waits == [0.5]
    assert V.embed_batched([], embed) == []
    with pytest.raises(ValueError, match="vectors"):
        V.embed_batched(["1"], lambda t: [])
    with pytest.raises(KeyError):
        V.with_retry(lambda: {}["x"], 4, wait=waits.append)
    a, b = V.hashing_embedder(32)(["alpha beta", "alpha beta"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9


def test_links_and_templates(spark):
    df = spark.createDataFrame([("F", None, None, "d", None), ("F", "H", "t", "d", "a {{link}} b {{link}}"), ("F", None, "t", None, "x")], "file_id string, heading_id string, heading_text string, link_description string, template string")
    assert [tuple(r) for r in U.with_link(df).select("link", "filled").collect()] == [("[[id:F][d]]",) * 2, ("[[id:H][d]]", "a [[id:H][d]] b [[id:H][d]]"), ("[[id:F::*t][]]", "x")]
    assert spark.range(1).select(T.heading_ref(F.lit(" * a b "))).first()[0] == "a b"


def test_reanchor(spark):
    rows = [(1, "ab key cd. ab key cd.", "ab ", "key", " cd", 14), (2, "ab key cd. ab key cd.", "ab ", "key", " cd", 2), (3, "zz", "a", "b", "c", 0), (4, "xx", "", "", "", 0), (5, "(.*) (.*)", "(", ".*", ")", 99)]
    df = spark.createDataFrame(rows, "id int, buffer string, before string, expect string, after string, char_start int")
    assert sorted((r.id, r.beg, r.end) for r in U.reanchor(df).collect() if r.beg is not None) == [(1, 14, 17), (2, 3, 6), (5, 6, 8)]


def test_overlaps_inserts_and_edits(spark):
    rows = [("n", 1, 1, 2, 0, 5), ("n", 2, 2, 3, 4, 9), ("n", 3, 3, 1, 9, 12), ("n", 4, 4, 1, 4, 4), ("n", 5, 5, 3, None, None)]
    df = spark.createDataFrame(rows, "note string, id int, pos int, confidence int, beg int, end int")
    kept = {r.id: r.kept for r in U.keep_without_overlap(df).collect()}
    assert kept == {1: False, 2: True, 3: True, 4: True, 5: False}
    assert [tuple(r) for r in U.overlapping_pairs(df).collect()] == [("n", 1, 2)]
    ins = spark.createDataFrame([("n", "ab cd", 2, 2, "two"), ("n", "ab cd", 2, 1, "one"), ("n", "ab cd", 0, 3, "x"), ("n", "ab cd", 5, 4, "y")], "note string, buffer string, beg int, pos int, filled string")
    assert sorted((r.beg, r.text, r.n) for r in U.group_inserts(ins).collect()) == [(0, "x ", 1), (2, " one two", 2), (5, " y", 1)]
    edits = spark.createDataFrame([("n", "ab cd", 0, 2, "X"), ("n", "ab cd", 3, 3, "Y ")], "note string, buffer string, beg int, end int, filled string")
    assert U.apply_edits(edits).first().buffer == "X Y cd"
    with pytest.raises(ValueError, match="outside"):
        U.apply_edit("abc", 2, 9, "")


def test_anchor_queries_look_up_every_row(spark, tmp_path):
    phrase = "the quick brown fox jumps over the lazy dog"
    buffers = [f"ab {phrase} cd", f"x {phrase.replace(' ', '  ')} y", "See [[id:1][the quick brown]] fox jumps over the lazy dog.", f"k {phrase.replace('brown', 'browne').replace('lazy', 'lzy')} z", "nothing of the kind", None, ""]
    spark.createDataFrame(list(enumerate(buffers)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, phrase)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def fewest(text):  # every substring's edits, by brute force
        row = [(0, k) for k in range(len(text) + 1)]
        for i, c in enumerate(phrase, 1):
            new = [(i, 0)]
            for k, d in enumerate(text, 1):
                new.append(min((row[k - 1][0] + (c != d), row[k - 1][1]), (row[k][0] + 1, row[k][1]), (new[-1][0] + 1, new[-1][1]), key=lambda x: x[0]))
            row = new
        end = min(range(len(row)), key=lambda k: row[k][0])
        return (row[end][1], end) if row[end][0] <= round(0.2 * len(phrase)) else (None, None)

    got = {r.doc_id: (r.char_start, r.char_end) for r in registry.QUERIES["anchor_fuzzy"](spark, str(tmp_path)).collect()}
    assert got == {0: (3, 46), 1: (2, len(buffers[1]) - 2), 2: (buffers[2].index("the"), len(buffers[2]) - 1), 3: fewest(buffers[3]), 4: (None, None), 6: (None, None)}
    shown = {r.doc_id: r.shown_start for r in registry.QUERIES["anchor_normalized"](spark, str(tmp_path)).collect()}
    assert shown == {0: 3, 1: 2, 2: 4, 3: None, 4: None, 6: None} and got[3] != (None, None)


def test_nearest_occurrence_takes_every_document(spark, tmp_path):
    texts = ["", "ab", "short text", "0123456789" * 60, "x" * 500, "one of a kind " + "".join(chr(97 + k * 7 % 26) + str(k) for k in range(300)), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, text in enumerate(texts):
        if text is None:
            continue
        s = len(text) // 2
        lead = s - max(0, s - 40)
        whole, n, guess = text[s - lead : s + 60], len(text[s : s + 20]), max(0, max(0, s - 100) - lead)
        spots, at = [], text.find(whole) if whole else -1
        while at >= 0:
            spots.append(at)
            at = text.find(whole, at + len(whole))
        best = min(spots, key=lambda x: (abs(x - guess), -x), default=None)
        want[i] = (None, None) if best is None else (best + lead, best + lead + n)
    got = {r.doc_id: (r.beg, r.end) for r in registry.QUERIES["nearest_occurrence"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 6


def test_reanchor_query_where_surroundings_overlap_themselves(spark, tmp_path):
    say = lambda a, n: "".join(chr(97 + k * k % 23) + str(k) for k in range(a, a + n))
    texts = [say(0, 400)[:1300] + run + say(900, 400)[:1300] for run in ("a " * 53, "it " * 45, "x" * 103, "x" * 400, "abcdefghij" * 20, "one of a kind")]
    texts += ["a " * 50 + "b" * 20 + "c" * 2380, "a" * 2399, "a" * 2400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(spark, registry.QUERIES["reanchor"], registry.ORACLE_SQL["reanchor"], str(tmp_path), con) == []
    got = {r.doc_id: r.beg for r in registry.QUERIES["reanchor"](spark, str(tmp_path)).collect()}
    assert {0, 1, 2, 5} <= set(got) and all(at == len(texts[i]) // 2 for i, at in got.items())
