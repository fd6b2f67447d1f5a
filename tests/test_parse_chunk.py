from __future__ import annotations

import random
import time

import pytest

from weftline.config import Settings
from weftline.operators import chunk as C
from weftline.operators import parse as P
from weftline.sources.corpus import create_texts

NOTE = """:PROPERTIES:
:ID: file-1
:ROAM_ALIASES: "Two Words" one ""
:END:
#+title:  The title
#+date: today
see [[id:a]] and [[id:b][B]]
* First :x:y:
to [[id:c::*Head][d]] é😀
** TODO Second
:PROPERTIES:
:ID: head-2
:END:
[[id:d::words]] [[https://x][y]]
* DONE Third  :t:
"""


def test_note():
    n = P.parse(NOTE, "sub/the_note-x.org")
    assert (n["note_id"], n["title"], n["aliases"]) == ("file-1", "The title", ["Two Words", "one"])
    heads = n["headings"]
    assert [(h["text"], h["level"], h["id"], h["index"], h["ancestor_path"]) for h in heads] == [("First", 1, None, 1, []), ("Second", 2, "head-2", 2, ["First"]), ("Third", 1, None, 3, [])]
    assert [NOTE[h["char_start"] : h["char_end"]].split("\n")[0] for h in heads] == ["* First :x:y:", "** TODO Second", "* DONE Third  :t:"]
    assert heads[-1]["char_end"] == len(NOTE)
    assert [(x["target_uuid"], x["search_string"], NOTE[x["char_start"] : x["char_end"]]) for x in n["links"]] == [
        ("a", None, "[[id:a]]"),
        ("b", None, "[[id:b][B]]"),
        ("c", "*Head", "[[id:c::*Head][d]]"),
        ("d", "words", "[[id:d::words]]"),
    ]


def test_fallbacks():
    assert P.parse("one line", "a/my_cool_note-v2.org")["title"] == "my cool note v2"
    n = P.parse("#+title: t\n:PROPERTIES:\n:ID: x\n:END:\n", "")
    assert (n["note_id"], n["aliases"], n["title"]) == ("", [], "t")
    assert P.parse("", "")["headings"] == [] and P.parse("*no\n*** deep\n* top\n** sub\n**** d")["headings"][3]["ancestor_path"] == ["top", "sub"]


def test_parse_notes(spark):
    notes = P.parse_notes(create_texts(spark, [("a.org", NOTE), ("b.org", ""), ("c.org", None)]))
    assert P.headings_of(notes).count() == 3 and P.links_of(notes).count() == 4
    assert sorted(r.path for r in P.missing_ids(notes).collect()) == ["b.org", "c.org"]


SMALL = Settings(chunk_target_tokens=60, chunk_max_tokens=90, chunk_min_tokens=12, chunk_overlap_tokens=16)


def long_note():
    prose = " ".join(f"Sentence number {i} says some words here." for i in range(40))
    items = "\n".join(f"- item {i} has four words" for i in range(30))
    return f":PROPERTIES:\n:ID: n\n:END:\n#+title: T\n# comment\nPreamble text of some length that counts as more than a dozen tokens in all here.\n* Long\n:PROPERTIES:\n:ID: h\n:END:\n:LOGBOOK:\n- state\n:END:\n{prose}\n** Items\n#+begin_src sh\n#+kept\n# kept\n#+end_src\n{items}\n* Tail\nshort tail\n* Empty\n:LOGBOOK:\nx\n:END:\n"


def test_chunks_keep_bounds_offsets_and_order():
    text = long_note()
    chunks = C.chunk(P.parse(text, "n.org"), SMALL, C.word_counter)
    assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))
    for index in {c["heading_index"] for c in chunks}:
        own = [c for c in chunks if c["heading_index"] == index]
        assert [c["chunk_in_heading"] for c in own] == list(range(len(own)))
        for c in own:
            raw = text[c["char_start"] : c["char_end"]]
            assert all(line in raw for line in c["text"].split("\n"))
            assert c["embed_text"] == f"{c['heading_path']}\n\n{c['text'].strip()}"
        if len(own) > 1:
            assert all(12 <= C.word_counter(c["text"]) <= 90 + 16 + 2 * 12 for c in own)
    assert {c["heading_index"] for c in chunks} == {0, 1, 2, 3}
    joined = "\n".join(c["text"] for c in chunks)
    assert "kept" in joined and "LOGBOOK" not in joined and "comment" not in joined
    assert next(c for c in chunks if c["heading_index"] == 2)["heading_path"] == "T > Long > Items"


def test_prose_overlaps_and_lists_do_not():
    chunks = C.chunk(P.parse(long_note(), "n.org"), SMALL, C.word_counter)
    prose = [c for c in chunks if c["heading_index"] == 1]
    items = [c for c in chunks if c["heading_index"] == 2]
    assert all(b["char_start"] < a["char_end"] for a, b in zip(prose, prose[1:], strict=False)) and len(prose) > 2
    assert all(b["char_start"] >= a["char_end"] for a, b in zip(items, items[1:], strict=False)) and len(items) > 1


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "x" * 30, ". ", "\n", "\n\n", "é😀 ", "a.b! "]) for _ in range(80))
    count = len if seed % 2 else C.word_counter
    parts = C.pieces(text, count, 25)
    assert [a for a, *_ in parts][1:] == [b for _, b, _ in parts][:-1] and (parts[0][0], parts[-1][1]) == (0, len(text))
    assert all(count(text[a:b]) <= 25 for a, b, _ in parts)
    packed = C.pack(parts, text, count, 20, 25)
    assert all(count(text[a:b]) <= 25 for a, b, _ in packed)


def test_merge_small_chunks():
    text = "aaaa bb cccccc d"
    spans = [(0, 2, "start"), (2, 9, "word"), (9, 15, "word"), (15, 16, "word")]
    assert C.merge_small(spans, text, len, 3) == [(0, 9, "start"), (9, 16, "word")]


def test_tokens_from_a_rank_file():
    import public_tokenizers

    count = C.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert count("hello world") == 2 and C.chunk(P.parse("some text"), Settings(), count)[0]["text"] == "some text"


def test_chunk_notes(spark):
    notes = P.parse_notes(create_texts(spark, [("n.org", long_note()), ("e.org", "")]))
    got = C.chunk_notes(notes, SMALL).orderBy("ordinal").collect()
    want = C.chunk(P.parse(long_note(), "n.org"), SMALL, C.word_counter)
    assert [r.asDict() for r in got] == want
    assert C.without_drawers(":A:\nx\n:END:\ny\n") == "y\n"


def test_measure_counts_as_the_counter_does():
    rng = random.Random(12)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "c", " ", "  ", "\n", ".", "é-", "語"]) for _ in range(rng.randint(0, 40)))
        size = C.Measure(text, C.word_counter)
        for _ in range(30):
            a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
            assert size.between(a, b) == C.word_counter(text[a:b])


def test_unbroken_and_long_texts_take_linear_time():
    small = Settings(chunk_target_tokens=60, chunk_max_tokens=90, chunk_min_tokens=12, chunk_overlap_tokens=16)
    for text in ("word and. " * 60_000, "x" * 200_000, ".," * 50_000):
        began = time.perf_counter()
        chunks = C.chunk(P.parse(text, "n.org"), small, C.word_counter)
        assert chunks[-1]["char_end"] == len(text) and time.perf_counter() - began < 20
