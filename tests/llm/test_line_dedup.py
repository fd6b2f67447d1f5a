from __future__ import annotations

import datetime
import random
import string

import numpy as np
import pytest
from tests.llm.helpers import sha

from weftline.llm import edit_distance, line_dedup
from weftline.llm.edit_distance import edit_distance_within, similar
from weftline.llm.line_dedup import dedup_lines, documents_without_repeated_lines


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) if rng.random() < 0.5 else a[: rng.randint(0, 14)] + rng.choice("ab") + a[3:]
        for limit in (0, 1, 2, 4, 9):
            assert edit_distance_within(a, b, limit) == (levenshtein(a, b) <= limit)
    assert similar("a" * 10, "a" * 8 + "bb", 0.8) and not similar("a" * 10, "a" * 7 + "bbb", 0.8)


def test_edit_distance_of_long_texts(monkeypatch):
    monkeypatch.setattr(edit_distance, "LONG", 3)
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("ab é cd efg".split()) + str(rng.randrange(20)) for _ in range(rng.randint(0, 12))]
        other = [w for w in words if rng.random() < 0.9]
        if rng.random() < 0.3:
            rng.shuffle(other)
        a, b = " ".join(words), " ".join(other)
        for limit in (0, 2, 5, 12):
            assert edit_distance_within(a, b, limit) == (levenshtein(a, b) <= limit)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    other = [w if rng.random() < 0.95 else "x" for w in words]
    assert similar(" ".join(words), " ".join(other), 0.8) and not similar(" ".join(words), " ".join(w[::-1] + "y" for w in words), 0.8)


def test_many_pairs_against_single_ones():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcé語😀") for _ in range(rng.choice([0, 1, 5, 20, 63, 64, 65, 127, 128, 129, 200]))) for _ in range(120)]
    for t in list(texts):
        other = list(t)
        for _ in range(rng.randint(0, 1 + len(t) // 5)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yy"])
        texts.append("".join(other))
    a = np.array([rng.randrange(240) for _ in range(300)] + list(range(120)))
    b = np.array([rng.randrange(240) for _ in range(300)] + list(range(120, 240)))
    for similarity in (0.5, 0.8, 0.95):
        want = [levenshtein(texts[x], texts[y]) <= int(max(len(texts[x]), len(texts[y])) * (1 - similarity) + 1e-9) for x, y in zip(a, b, strict=True)]
        assert edit_distance.Texts(texts).similar(a, b, similarity).tolist() == want and 0 < sum(want) < len(want)


def made(seed):
    rng = random.Random(seed)
    vocab = [f"{c}{i}" for i in range(300) for c in ("ab", "é", "X")]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    pool = [say(rng.randint(5, 40)) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [say(rng.randint(0, 25)) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(pool).split()
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            line = rng.choice([" ", "  ", "\t"]).join(words)
            lines.insert(rng.randint(0, len(lines)), line.upper() if rng.random() < 0.2 and "é" not in line else line)
        lines += [rng.choice(["", "a b", "same short line", pool[0]])]
        rows.append((i, "\n".join(lines)))
    return [*rows, (60, None), (61, ""), (62, "\n\n"), (None, pool[1]), (None, rows[3][1]), (7, rows[7][1])]


def brute(rows):
    """Occurrences in order; all pairs of lines compared by edit similarity alone."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    places, norm = [], []
    for d, (_, text) in enumerate(ordered):
        for n, line in enumerate((text or "").encode().split(b"\n")):
            line = line.lower().decode()
            text_ = " ".join("".join(" " if c in string.punctuation else c for c in line).split(" ")).split()
            if text_:
                places.append((d, n))
                norm.append(" ".join(text_))
    distinct = list(dict.fromkeys(norm))
    fuzzy = [len(x.split(" ")) >= 5 or len(x) >= 20 for x in distinct]
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in range(i):
            limit = int(max(len(distinct[i]), len(distinct[j])) * 0.2 + 1e-9)
            if fuzzy[i] and fuzzy[j] and abs(len(distinct[i]) - len(distinct[j])) <= limit and levenshtein(distinct[i], distinct[j]) <= limit:
                root[find(i)] = find(j)
    seen, gone = set(), {}
    number = {x: k for k, x in enumerate(distinct)}
    for (d, n), x in zip(places, norm, strict=True):
        r = find(number[x])
        if r in seen:
            gone.setdefault(d, set()).add(n)
        seen.add(r)
    out = []
    for d, (i, text) in enumerate(ordered):
        lines = (text or "").split("\n")
        kept = "\n".join(x for n, x in enumerate(lines) if n not in gone.get(d, ()))
        out.append((i, len(lines), len(gone.get(d, ())), sha(kept.encode()), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("parts", "most", "block"), [(1, 1 << 16, 4 << 20), (4, 3, 1500)])
def test_against_brute_force(spark, parts, most, block):
    rows = made(parts)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, line string").repartition(parts)
    if parts == 1:
        got = dedup_lines(docs.coalesce(1), most=most, block_bytes=block).collect()
        want = brute(rows)
        assert sorted(map(tuple, got), key=str) == want
    else:  # rows with equal ids may come in any order between blocks
        rows = [r for r in rows[:-1] if r[0] is not None]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = dedup_lines(docs, most=most, block_bytes=block, buckets=20).collect()
        want = brute(rows)
        assert sorted(map(tuple, got), key=str) == want
    assert sum(w[2] for w in want) > 40


def test_columns_pass_through(spark):
    line = "one two three four five six"
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    rows = [(1, "en", f"{line}\nx", "s", 29, at, {"k": [1.5]}), (2, None, f"{line.upper()}\ny", None, 29, None, None), (3, "de", None, "t", None, at, {})]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, rest string, n_chars long, line timestamp, `a.b c` map<string,array<double>>")
    out = documents_without_repeated_lines(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    want = [rows[0], (2, None, "y", None, 1, None, None), (3, "de", "", "t", None, at, {})]
    assert sorted(map(tuple, out.collect())) == want


def test_repeated_rows_and_long_lines(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(30_000))
    other = long.replace("w77 ", "x ").replace("w5", "v5")
    docs = spark.createDataFrame([(1, long), (1, long), (2, other), (2, None), (3, "short\n" + long[::-1])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (2, 1, 0), (2, 1, 1), (3, 2, 0)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert dedup_lines(docs).collect() == [] and documents_without_repeated_lines(docs).collect() == []


def edited(n_words, seed=5, n=120):
    """Lines beside copies with one word changed, a letter mistyped, or a tenth of the words changed."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(n_words)]
        other = list(words)
        if k % 3 == 1:
            other[3] = "x" + other[3][1:]
        else:
            for i in rng.sample(range(len(words)), 1 if k % 3 == 0 else max(1, len(words) // 10)):
                other[i] = rng.choice(vocab)
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * k, a), (2 * k + 1, b)]
        if a != b and levenshtein(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
            pairs.append(2 * k + 1)
    return rows, pairs


@pytest.mark.parametrize("n_words", [6, 10, 20, 40])
def test_recall_against_all_pairs(spark, n_words):
    rows, pairs = edited(n_words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in dedup_lines(docs).collect() if r.n_removed}
    assert len(pairs) > 80 and len(gone & set(pairs)) >= 0.95 * len(pairs) and gone <= set(pairs)


def test_short_lines_and_scripts_without_spaces(spark):
    line = "今日はとても天気が良いので公園を散歩しました明日も行きたいと思います"
    other = line[:-1] + "せ"
    docs = spark.createDataFrame([(1, f"Read more here\n\n---\n{line}"), (2, f"read  more here!\n\n---\n{other}\nread more"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in dedup_lines(docs).collect()}
    assert got == {1: f"Read more here\n\n---\n{line}", 2: "\n---\nread more", 3: ""}


def test_forest_connects_what_its_links_connect():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randint(8, 12))) for _ in range(60)]
    texts += [t[:3] + rng.choice("xy") + t[rng.randint(3, 5) :] for t in texts]
    pairs = np.array([(i, j) for i in range(120) for j in range(i)])
    links = [(i, j) for i, j in pairs.tolist() if levenshtein(texts[i], texts[j]) <= int(max(len(texts[i]), len(texts[j])) * 0.2 + 1e-9)]
    likely = np.array([rng.randrange(5) for _ in pairs])
    picked = edit_distance.Texts(texts).forest(pairs[:, 0], pairs[:, 1], likely, 0.8)
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs[picked].tolist():
        assert (i, j) in set(links) and find(i) != find(j)
        root[find(i)] = find(j)
    assert links and all(find(i) == find(j) for i, j in links)


def test_candidates_of_long_runs(monkeypatch):
    """Runs beyond the lags connect the same lines."""
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(40)]
    lines = []
    for _ in range(80):
        words = list(base)
        words[rng.randrange(40)] = "zz"
        words[rng.randrange(40)] = f"q{rng.randrange(50)}"
        lines.append(" ".join(words).encode())
    lines = sorted(set(lines))
    minima = line_dedup.sketches(lines, 8)
    chars = np.array([len(x) for x in lines])
    found = []
    for lags in (1, 24, 200):
        monkeypatch.setattr(line_dedup, "LAGS", lags)
        a, b, agree = line_dedup.near_links(np.arange(len(lines)), minima[:, 0], minima.astype(np.uint8), chars, 0, 0.8, 8)
        assert (agree >= 8).all()
        root = list(range(len(lines)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            root[max(find(i), find(j))] = min(find(i), find(j))
        found.append([find(i) for i in range(len(lines))])
    assert found[0] == found[1] == found[2] and len(set(found[0])) < len(lines)


def test_sketches_do_not_depend_on_neighbours(monkeypatch):
    lines = [f"line number {i} of some lines {'x' * (i % 50)}".encode() for i in range(300)]
    alone = np.concatenate([line_dedup.sketches([x], 5) for x in lines])
    monkeypatch.setattr(line_dedup, "_CHUNK", 500)
    assert (line_dedup.sketches(lines, 5) == alone).all()


def test_normal_lines():
    rng = random.Random(11)
    for _ in range(500):
        text = "".join(rng.choice(["a", "B", "é", " ", "  ", "\t", "\n", ".", "-\r", "\x0b", "\x0c"]) for _ in range(rng.randint(0, 30))).encode()
        want = [b" ".join(bytes(0x20 if chr(c) in string.punctuation else c for c in x.lower()).split()) for x in text.split(b"\n")]
        assert line_dedup.normal_lines(text) == want


def test_large_alphabets_are_compared_in_parts(monkeypatch):
    rng = random.Random(13)
    a = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    b = [t[: rng.randint(0, len(t))] + "x" + t[rng.randint(0, len(t)) :] for t in a]
    limits = np.array([rng.randint(0, 30) for _ in a])
    want = [levenshtein(x, y) <= z for x, y, z in zip(a, b, limits, strict=True)]
    for most in (1 << 22, 5000, 1):
        monkeypatch.setattr(edit_distance, "_TABLE", most)
        assert edit_distance.within_many(a, b, limits).tolist() == want


def turned(rng, n):
    """Lines of n words with their halves turned round, and near copies of the first: nearly all minima are those of both,
    but only edit similarity tells that the copies are near one of the two."""
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(4, 8))) for _ in range(n)]
    line, other = " ".join(words), " ".join(words[n // 2 :] + words[: n // 2] + ["z"])
    return line, other, line + " zz" * 3


@pytest.mark.parametrize("most", [1 << 14, 3])
def test_a_link_that_fails_hides_no_other(spark, most):
    rng = random.Random(12)
    rows = []
    for i in range(30):
        line, other, near = turned(rng, 30)
        assert similar(line, near, 0.8) and not similar(line, other, 0.8) and not similar(near, other, 0.8)
        rows += [(3 * i, line), (3 * i + 1, other), (3 * i + 2, near)]
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    assert got == {i: int(i % 3 == 2) for i in range(90)}


def test_links_of_a_group_grow_with_its_size():
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(40)]
    lines = set()
    while len(lines) < 600:
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(40)] = f"q{rng.randrange(500)}"
        lines.add(" ".join(words).encode())
    lines = sorted(lines)
    minima = line_dedup.sketches(lines, 8)
    a, b, _ = line_dedup.near_links(np.arange(600), minima[:, 0], minima.astype(np.uint8), np.array([len(x) for x in lines]), 0, 0.8, 8)
    assert 0 < len(a) < 600


def test_lags_drop_no_candidate():
    """The links kept connect exactly what all candidate pairs connect, in runs far longer than the lags too."""
    rng = np.random.default_rng(7)
    for n, noise in ((300, 0.3), (500, 0.55), (700, 0.65)):
        base = rng.integers(0, 1 << 32, (2, line_dedup.HASHES), dtype=np.uint64).astype(np.uint32)
        minima = base[rng.integers(0, 2, n)]
        off = rng.random(minima.shape) < noise * rng.random((n, 1)) * 1.5
        minima[off] = rng.integers(0, 1 << 32, int(off.sum()), dtype=np.uint64).astype(np.uint32)
        value = minima[:, 2] = np.where(rng.random(n) < 0.9, 5, 6)
        short, chars, lines = minima.astype(np.uint8), rng.integers(100, 240, n), rng.permutation(n).astype(np.int64)
        a, b, agree = line_dedup.near_links(lines, value.astype(np.uint32), short, chars, 2, 0.8, 8)
        equal = short[:, None] == short[None]
        pairs = [j for j in range(0, line_dedup.HASHES, 2) if j != 2]
        near = equal.sum(axis=2) >= 8
        near &= (value[:, None] == value[None]) & np.any([equal[:, :, j] & equal[:, :, j + 1] for j in pairs], axis=0)
        longer = np.maximum(chars[:, None], chars[None])
        near &= np.abs(chars[:, None] - chars[None]) <= (longer * 0.2 + 1e-9).astype(int)
        x, y = np.nonzero(np.triu(near, 1))
        root = line_dedup._union(np.arange(n), lines[x], lines[y])
        assert (line_dedup._union(np.arange(n), a, b) == root).all() and len(a) == n - len(set(root.tolist())) > 0
        runs = [np.unique(np.c_[value, minima[:, j : j + 2]], axis=0, return_counts=True)[1].max() for j in pairs]
        assert max(runs) > 2 * line_dedup.LAGS
        place = np.argsort(lines)
        assert near[place[a], place[b]].all() and (agree == equal.sum(axis=2)[place[a], place[b]]).all()


def test_many_pairs_by_rows(monkeypatch):
    """Rows by 64 for all pairs, however few are left, give what single pairs give; nothing is compared one by one."""
    rng = random.Random(21)
    monkeypatch.setattr(edit_distance, "_ALONE", 0)
    size = [1, 5, 63, 64, 65, 128, 129, 200, 300]
    a = ["".join(rng.choice("abcdé語 ") for _ in range(rng.choice(size))) for _ in range(150)]
    b = ["".join(rng.choice(["", c, c, c, c, c + "x", "ab"]) for c in t) or "y" for t in a]
    b[:40] = ["q" * 40 + t for t in a[:40]]  # apart only at the beginning
    b[40:60] = a[80:100]
    limits = np.array([int(rng.choice([0, 0.05, 0.2, 0.5, 1]) * max(len(x), len(y))) for x, y in zip(a, b, strict=True)])
    want = [levenshtein(x, y) <= z for x, y, z in zip(a, b, limits.tolist(), strict=True)]
    monkeypatch.setattr(edit_distance, "_distance", None)
    assert edit_distance.within_many(a, b, limits).tolist() == want and 20 < sum(want) < 130


def test_unlike_pairs_end_after_few_rows(monkeypatch):
    """Pairs that share a passage only, as in groups of candidates that fall apart, are told apart without all their cells."""
    rng = random.Random(22)
    say = lambda k: " ".join(rng.choice(["de", "la", "aux", "que", "tion", "ent", "sch", "ber", "that", "in"]) for _ in range(k))
    passage = say(60)
    texts = [f"{say(50)} {passage} {say(50)}" for _ in range(200)]
    steps = []
    monkeypatch.setattr(edit_distance, "_ALONE", 0, raising=False)
    real = np.take
    monkeypatch.setattr(edit_distance.np, "take", lambda table, place, **k: steps.append(place.size) or real(table, place, **k))
    limits = np.array([int(0.2 * max(len(x), len(y))) for x, y in zip(texts[:100], texts[100:], strict=True)])
    assert not edit_distance.within_many(texts[:100], texts[100:], limits).any()
    assert sum(steps) < 0.5 * sum(-(-len(x) // 64) * len(y) for x, y in zip(texts[:100], texts[100:], strict=True))


def test_partners_far_apart_in_a_run_are_found():
    """One run of 200 lines, in which each has its only partner 100 places away."""
    rng = np.random.default_rng(8)
    minima = rng.integers(0, 1 << 32, (200, line_dedup.HASHES), dtype=np.uint64).astype(np.uint32)
    minima[:, [2, 4, 5]] = 9
    minima[100:, 20::2] = minima[:100, 20::2]
    minima = minima.astype(np.uint8)
    own = [*range(6, 20), *range(21, 32, 2)]
    minima[:, own] = np.arange(200, dtype=np.uint8)[:, None]  # so no other run holds two of them
    lines = np.arange(200)
    a, b, agree = line_dedup.near_links(lines, np.full(200, 9, np.uint32), minima, 1000 + lines, 2, 0.8, 8)
    assert sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) == [(k, k + 100) for k in range(100)] and (agree >= 9).all()
