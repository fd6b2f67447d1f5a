from __future__ import annotations

import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions.vectors import hashing_embedder
from weftline.observability import Tracer, judge_cost, logger, retrieval_documents
from weftline.operators import judge as J
from weftline.operators import refresh as R
from weftline.plans.engine import Engine
from weftline.plans.service import Service, main
from weftline.sources import corpus
from weftline.sources.store import Store
from weftline.streaming import watch

TOPICS = {"tide": "The tide and the moon pull the sea.", "bread": "Bread dough rises with yeast and time."}


def note(ident, title, body, heading="Part"):
    return f":PROPERTIES:\n:ID: {ident}\n:END:\n#+title: {title}\nIntro of {title}.\n* {heading}\n{body}\n"


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / "a.org").write_text(note("A", "Tides", TOPICS["tide"]), encoding="utf-8")
    (root / "sub" / "b.org").write_text(note("B", "Baking", TOPICS["bread"]), encoding="utf-8")
    (root / "c.org").write_text(note("C", "Moon", TOPICS["tide"] + " Night."), encoding="utf-8")
    (root / "skip.txt").write_text("no note", encoding="utf-8")
    return root


def settings(root, **more):
    return Settings(corpus_dir=str(root), embedding_dim=64, sim_floor=0.1, **more)


def make():
    return hashing_embedder(64)


def later(path, text=None):
    if text is not None:
        path.write_text(text, encoding="utf-8")
    stamp = time.time() + 60 + later.n
    later.n += 60
    os.utime(path, (stamp, stamp))


later.n = 0


def test_refresh_life_cycle(spark, place):
    s = settings(place)
    store = Store(spark, s.index_dir, buckets=4)

    def run(**kw):
        return R.refresh(spark, s, store, make, **kw)

    heard = []
    first = run(progress=lambda *a: heard.append(a))
    assert first == {"indexed": 3, "reindexed": 0, "skipped": 0, "deleted": 0, "chunks": 6} and len(heard) == 4
    old = store.snapshot()
    assert run() == {"indexed": 0, "reindexed": 0, "skipped": 3, "deleted": 0, "chunks": 0}
    later(place / "a.org", note("A", "Tides", "Something else entirely."))
    later(place / "c.org")
    assert run() == {"indexed": 0, "reindexed": 1, "skipped": 2, "deleted": 0, "chunks": 2}
    assert "else" in store.snapshot().get_chunk("A", 1, 0).first().text
    assert "tide" in old.get_chunk("A", 1, 0).first().text  # a reader keeps its snapshot
    os.rename(place / "sub" / "b.org", place / "sub" / "moved.org")
    later(place / "sub" / "moved.org")
    moved = run()
    assert (moved["indexed"], moved["deleted"]) == (1, 1)
    assert store.snapshot().get_chunk("B", 1, 0).count() == 1  # a rename keeps the note's chunks
    (place / "c.org").unlink()
    assert run()["deleted"] == 1 and store.snapshot().get_chunk("C", 1, 0).count() == 0
    assert run(rebuild=True)["reindexed"] == 2
    row = store.snapshot().counts().first()
    assert (row.notes, row.chunks) == (2, 4)


def test_store_operations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"), buckets=3)
    assert store.snapshot().counts().first().notes == 0
    m = spark.createDataFrame([("p", "u", "h", 1.0), ("q", "v", "h", 1.0)], "path string, uuid string, content_hash string, last_indexed_mtime double")
    store.upsert_manifest(m)
    store.upsert_manifest(m.where("path = 'p'").withColumn("content_hash", F.lit("new")))
    snap = store.snapshot()
    assert {(r.path, r.content_hash) for r in snap.manifest.collect()} == {("p", "new"), ("q", "h")}
    assert snap.get_manifest("p").count() == 1 and snap.get_manifest("none").count() == 0
    before = snap.version
    store.delete_notes(m.select("path").where("path = 'q'"))
    store.delete_notes(m.select("path").where("path = 'q'"))
    assert [r.path for r in store.snapshot().manifest_paths().collect()] == ["p"] and store.snapshot().version > before
    with pytest.raises(ValueError, match="index folder"):
        Store(spark, None)


def test_notes_without_ids_are_kept_apart(spark, place):
    for name in ("x", "y"):
        (place / f"{name}.org").write_text(f"#+title: {name}\ntext of {name}\n", encoding="utf-8")
    s = settings(place)
    store = Store(spark, s.index_dir)
    R.refresh(spark, s, store, make)
    later(place / "x.org", "#+title: x\nchanged\n")
    R.refresh(spark, s, store, make)
    assert {r.note_path for r in store.snapshot().chunks.where("note_uuid = ''").collect()} == {"x.org", "y.org"}


def judge_all():
    def judge(system, prefix, asked, strict):
        assert ":PROPERTIES:" not in prefix
        return json.dumps({"suggestions": [{"candidate_id": 1, "type": "mention", "confidence": 3, "why": "close", "anchor": {"mode": "wrap", "expect": "the moon", "insert_text": None}, "target_is_note": False}]})

    return judge


QUERY = note("Q", "Seas", "The tide and the moon pull the sea, see [[id:C]].", "Mine")


def test_suggest_end_to_end(spark, place):
    s = settings(place)
    tracer = Tracer(spark)
    service = Service(Engine(spark, s, make, judge_all, tracer))
    assert service.start()["indexed"] == 3 and service.health() == {"status": "ok"}
    assert service.status()["notes"] == 3 and service.status()["last_refresh"]
    got = service.suggest(QUERY)
    assert got["version"] == 1 and got["source"]["id"] == "Q"
    ids = {(x["target"]["file_id"], (x["target"]["heading"] or {}).get("text")) for x in got["suggestions"]}
    assert ("A", "Part") in ids and ("C", None) not in ids and "Q" not in {i for i, _ in ids}
    first = got["suggestions"][0]["source_anchor"]
    assert QUERY[first["char_start"] : first["char_end"]] == first["expect"] == "the moon"
    assert [x["id"] for x in got["suggestions"]] == [f"s{i:02d}" for i in range(1, len(got["suggestions"]) + 1)]
    names = [r["name"] for r in tracer.finished]
    assert {"retrieval", "judge", "suggest"} <= set(names) and len({r["trace"] for r in tracer.finished if r["name"] in ("retrieval", "judge", "suggest")}) == 1
    assert service.suggest("")["suggestions"] == []
    found = service.engine.candidates(QUERY)
    docs = retrieval_documents(found).collect()
    assert docs and [r.score for r in docs] == sorted((r.score for r in docs), reverse=True) and all(r.id and r.text for r in docs)

    def half():
        def judge(system, prefix, asked, strict):
            if "Candidate 1" in asked and "Part" not in asked:
                raise ValueError("no")
            return judge_all()(system, prefix, asked, strict)

        return judge

    asked = J.ask(J.prompts(J.group_candidates(found)), half, "note", attempts=1)
    cost = judge_cost(asked).collect()
    assert {(r.n_returned, r.failed) for r in cost} <= {(1, 0), (0, 1)} and all(r.elapsed_s >= 0 for r in cost) and cost


def test_notes_without_ids_are_retrieved_apart(spark, place):
    for name in ("a.org", "c.org", "sub/b.org"):
        (place / name).unlink()
    for name, topic in (("tides", "tide"), ("bread", "bread")):
        (place / f"{name}.org").write_text(f"#+title: {name}\n{TOPICS[topic]}\n* More\nOn {TOPICS[topic]}\n", encoding="utf-8")
    engine = Engine(spark, settings(place), make, judge_all)
    engine.refresh()
    rows = engine.candidates("#+title: own\nThe tide and the moon pull the sea.\n").collect()
    by_path = {}
    for r in rows:
        by_path.setdefault(r.tgt_path, []).append(r)
        assert ("tide" in r.tgt_text) == (r.tgt_path == "tides.org") and r.neighbour is None and r.tgt_uuid == ""
    assert max(r.sim for r in by_path["tides.org"]) > max([r.sim for r in by_path.get("bread.org", [])], default=0)
    assert len({r.tgt_note for r in rows}) == len(by_path)
    got = json.loads(engine.suggest("#+title: own\nThe tide and the moon pull the sea.\n").toJSON().first())
    assert {x["target"]["file_id"] for x in got["suggestions"]} == {""}


def test_names_with_pattern_characters(spark, place):
    for name in ("a[1].org", "b{x,y}*.org", "c?.org", "d\\e.org"):
        (place / name).write_text(note(name, name, TOPICS["tide"]), encoding="utf-8")
    store = Store(spark, settings(place).index_dir)
    assert R.refresh(spark, settings(place), store, make)["indexed"] == 7
    paths = spark.createDataFrame([("a[1].org",), ("c?.org",)], "path string")
    assert {r.path for r in corpus.read_named(spark, str(place), paths).collect()} == {"a[1].org", "c?.org"}


def test_command_line(spark, place, monkeypatch):
    monkeypatch.chdir(place.parent)
    out = io.StringIO()

    def engine(spark, s):
        return Engine(spark, Settings(corpus_dir=s.corpus_dir, embedding_dim=64, sim_floor=0.1), make, judge_all)

    assert main(["--corpus", str(place), "index"], spark, engine, stdout=out) == 0
    assert json.loads(out.getvalue())["indexed"] == 3
    out = io.StringIO()
    assert main(["--corpus", str(place), "suggest"], spark, engine, stdin=io.StringIO(QUERY), stdout=out) == 0
    assert json.loads(out.getvalue())["source"]["title"] == "Seas"


def test_scans(spark, place):
    assert {r.path for r in corpus.scan_corpus(spark, str(place)).collect()} == {"a.org", "c.org", "sub/b.org"}
    listing = corpus.list_corpus(spark, str(place))
    assert "content" not in listing.columns and listing.count() == 3
    one = corpus.read_named(spark, str(place), listing.where("path = 'sub/b.org'")).collect()
    assert len(one) == 1 and one[0].text.startswith(":PROPERTIES:")
    assert corpus.buffer_source(spark, stream=io.StringIO("x")).first().text == "x"


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("WEFTLINE_TOP_K=3\nWEFTLINE_TOP_N=4\nOTHER=1\n", encoding="utf-8")
    s = Settings.load({"WEFTLINE_TOP_K": "5", "WEFTLINE_CORPUS_DIR": "/c"}, str(env), sim_floor=0.7)
    assert (s.top_k, s.top_n, s.sim_floor, s.index_dir) == (5, 4, 0.7, "/c/dbs/index")
    assert s.with_corpus("/d").index_dir == "/d/dbs/index" and Settings.load({}, None).index_dir is None
    assert logger() is logger() and sum(hasattr(h, "_weftline") for h in logger().handlers) == 1


def test_watching_a_feed(spark, tmp_path):
    feed = tmp_path / "feed"
    rows = [("a.org", "2024-01-01 00:00:00"), ("b.txt", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "path string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(feed))
    events = spark.readStream.schema("path string, ts timestamp").parquet(str(feed))
    calls, heard = [], []

    def flaky():
        calls.append(1)
        if len(calls) == 1:
            raise OSError("disk")
        return {"indexed": 1}

    q = watch.watch_feed(events, flaky, str(tmp_path / "cp"), heard=heard.append, once=True)
    q.awaitTermination(60)
    assert calls == [1] and heard == [] and q.exception() is None
    spark.createDataFrame([("c.org", "2024-01-01 00:01:00")], "path string, ts string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(str(feed))
    watch.watch_feed(events, flaky, str(tmp_path / "cp"), heard=heard.append, once=True).awaitTermination(60)
    assert heard == [{"indexed": 1}]
    q = watch.bursts(watch.note_changes(events), "30 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT changes FROM bursts").count() <= 2
    q = watch.latest_changes(events).writeStream.format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT * FROM latest").count() == 3


def test_watching_the_clock(spark, place, tmp_path):
    heard = []
    service = Service(Engine(spark, settings(place), make, judge_all))
    q = watch.watch(spark, service, str(tmp_path / "cp"), heard=heard.append)
    deadline = time.time() + 60
    while not heard and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    assert heard and heard[0]["skipped"] == 3
