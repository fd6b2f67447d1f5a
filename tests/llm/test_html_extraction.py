from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm.html_extraction import blocks_of_page, main_text, parse, repeated_tokens

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";x(1<2);</script></head>
<body><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad <p>1</p> --><div class="ad">Buy <b>now</b>.</div>
<article><h1>A  title</h1><p><b>First&nbsp;line &amp; more<br><p>Second
 <i>li</i>ne &lt;ok&gt; &#233;</p><div class="share social">Share</div><ul><li>one<li>two</ul><aside>side</aside>
<section id="comments"><article><p>nice post</p></article></section><p>Last one, header-like words</p><form><p>mail</p></form></article>
<footer>&copy; host</footer></body></html>"""


def test_article_without_boilerplate():
    texts, main = parse(PAGE)
    assert texts == ["A title", "First line & more", "Second line <ok> é", "one", "two", "Last one, header-like words"] and all(main)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain text", ["plain text"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<div>a<span>b</span>c</div>d", ["abc", "d"]),
        ("<p>x</b></div>y</p>z", ["x", "y", "z"]),
        ("<body><div class='cookie-notice'>c<p>d</p></div><p>e</p><script>f", ["e"]),
        ("<header>h<p>i</header>j", ["j"]),
        ("<p>a < b and c<d</p>", ["a < b and c"]),
        ("<article>cut off in the mid", ["cut off in the mid"]),
        ("<div class='badge headerless'>k</div>", ["k"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<article class='post privacy-law'><p>law</p></article>", ["law"]),
        ("<div class='post tags'>t</div><div class='tags'>u</div><main role=\"main\" hidden>h</main>", ["t"]),
        ("<p title=it's>q</p><p title='a>b'>r</p><p title=\"c>d\" x='e\">s</p>", ["q", "r", "s"]),
        ("<article><header><h1>Title</h1><p>by me</p><hgroup><h2>Under</h2></hgroup><nav><h3>menu</h3></nav></header><p>body</p></article>", ["Title", "Under", "body"]),
        ("<header><h1>Site</h1></header><article>a<footer><h2>f</h2></footer></article>", ["a"]),
    ],
)
def test_markup(page, want):
    assert [t for t, _ in blocks_of_page(page or "")] == want


def test_repeated_tokens_against_brute_force():
    rng = random.Random(0)
    run = [rng.randrange(50) for _ in range(9)]
    streams = [[rng.randrange(50) for _ in range(rng.randint(0, 40))] + (run if i % 2 else run[:5]) + [rng.randrange(50) for _ in range(rng.randint(0, 9))] for i in range(12)]
    streams[3] = run + run
    pages = Counter()
    for s in streams:
        pages.update({tuple(s[i : i + 6]) for i in range(len(s) - 5)})
    got = repeated_tokens([np.array(s, np.uint32) for s in streams], 6, 3)
    for s, flags in zip(streams, got, strict=True):
        want = {i + k for i in range(len(s) - 5) if pages[tuple(s[i : i + 6])] >= 3 for k in range(6)}
        assert np.flatnonzero(flags).tolist() == sorted(want)


def test_host_boilerplate_goes_where_markup_says_nothing(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("w" + str(rng.randrange(10_000)) for _ in range(n))
    notice, shared = say(15), say(30)
    rows, want = [], {}
    for i in range(40):
        own = [say(20), say(12)]
        rows.append((i, f"https://Host{i % 2}.example.org:80/p/{i}", f"<div>{notice}</div><p>{own[0]}</p><p>{own[1]}</p><div>{notice}</div>", "x"))
        want[i] = "\n".join(own)
    rows += [(100 + i, f"http://host1.example.org/{i}", f"<main><p>{shared}</p></main><div>{notice}</div>", "x") for i in range(5)]
    want |= {100 + i: shared for i in range(5)}
    rows += [(200, None, None, None), (201, "http://x/", "", ""), (None, "http://y/", "<p>q</p>", ""), (202, "http://z/", f"<p>{notice}</p>", "")]
    want |= {200: "", 201: "", None: "q", 202: notice}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for kwargs in ({}, {"shard_pages": 10, "host_limit": 0}, {"shard_pages": 10}):
        got = main_text(pages, **kwargs).collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
        assert all(r.n_chars == len(r.text) for r in got)
    assert {r.url for r in got} == {r[1] for r in rows}


def test_empty_and_very_long(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    long_ = "<article>" + "<p>word word</p>" * 100_000
    got = main_text(spark.createDataFrame([(1, "http://a/", long_)], "page_id long, url string, html string")).first()
    assert got.n_chars == 100_000 * 10 - 1


def test_own_tokens_stay_and_copies_are_no_boilerplate(spark):
    rng = random.Random(2)
    say = lambda n: " ".join("w" + str(rng.randrange(10_000)) for _ in range(n))
    lead, own, copied = say(45), [say(40) for _ in range(3)], say(60)
    rows = [(i, f"http://a/{i}", f"<p>{lead} {own[i]}</p>") for i in range(3)] + [(10 + i, f"http://b/{i}", f"<p>{copied}</p>") for i in range(3)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own[i] for i in range(3)} | {10 + i: copied for i in range(3)}


def test_a_large_host_counts_repeats_as_a_small_one_does(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("w" + str(rng.randrange(10_000)) for _ in range(n))
    notices, twice = [say(12) for _ in range(10)], say(12)
    rows = [(i, f"http://a/{i}", f"<div>{notices[i // 3]}</div><p>{say(20)}</p>") for i in range(30)]
    rows += [(30 + i, f"http://a/{30 + i}", f"<div>{twice}</div><p>{say(20)}</p>") for i in range(2)]
    rows += [(40 + i, f"http://a/{40 + i}", rows[0][2]) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    small, large = (sorted(map(tuple, main_text(pages, shard_pages=k).collect())) for k in (100, 5))
    assert large == small and len(large) == 35
    assert [len(r[2].split()) for r in small[:32]] == [20] * 30 + [32] * 2


def test_a_teaser_does_not_stand_for_the_page(spark):
    body, stray = "a long body of the page " * 20, "stray words"
    rows = [(1, "http://a/", f"<article>teaser</article><div>{body}</div>"), (2, "http://b/", f"<article>{body}</article><div>{stray}</div>"), (3, "http://c/", f"<div>{stray}</div>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"teaser\n{body.strip()}", 2: body.strip(), 3: stray}


@pytest.mark.parametrize("shard_pages", [100, 4])
def test_hosts_against_brute_force(spark, shard_pages):
    """Runs counted page by page, tokens dropped one by one."""
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    shared = [say(rng.randint(9, 14)) for _ in range(6)]
    rows, parsed = [], []
    for i in range(30):
        blocks = []
        for _ in range(rng.randint(1, 4)):
            words = say(rng.randint(0, 12))
            if rng.random() < 0.6:
                words[rng.randint(0, len(words)) : 0] = rng.choice(shared)
            if words:
                blocks.append((words, rng.random() < 0.3))
        if i % 9 == 8:
            blocks = parsed[-1]
        parsed.append(blocks)
        rows.append((i, "http://one/" + str(i), "".join(f"<article>{' '.join(w)}</article>" if main else f"<div>{' '.join(w)}</div>" for w, main in blocks)))
    pages = Counter()
    for blocks in {str(b): b for b in parsed}.values():
        stream = [w for words, main in blocks if not main for w in words]
        pages.update({tuple(stream[k : k + 8]) for k in range(len(stream) - 7)})
    want = {}
    for i, blocks in enumerate(parsed):
        stream = [w for words, main in blocks if not main for w in words]
        gone = {k + d for k in range(len(stream) - 7) if pages[tuple(stream[k : k + 8])] >= 3 for d in range(8)}
        kept, at = [], 0
        for words, main in blocks:
            if not main:
                words, at = [w for k, w in enumerate(words, at) if k not in gone], at + len(words)
            kept.append((words, main))
        inside, total = sum(len(w) for w, main in kept if main), sum(len(w) for w, _ in kept)
        if inside and 2 * inside >= total:
            kept = [k for k in kept if k[1]]
        want[i] = "\n".join(" ".join(w) for w, _ in kept if w)
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_pages=shard_pages).collect()
    assert {r.page_id: r.text for r in got} == want and any(len(t.split()) < sum(len(w) for w, _ in b) for t, b in zip(want.values(), parsed, strict=True))
