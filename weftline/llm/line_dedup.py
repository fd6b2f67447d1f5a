"""Operator 5, fuzzy line dedup: sketches of normalised lines, a join on blocks of the sketch, edit
similarity, and one kept occurrence for each connected group.

A line is normalised to lower case (A-Z), ASCII punctuation to white space, that to single spaces.  Two
lines are linked if they are equal then, or if their edit similarity, 1 - distance / longer length in
characters, is at least ``similarity``.  Of all occurrences of a connected group's lines, the first
(by doc_id, then line) stays.  Lines of under ``min_words`` words and under ``MIN_CHARS`` characters are
compared exactly only; lines without words (blank ones, rules of marks) stay.

The sketch is not the SimHash of the method's name: 64 SimHash bits of lines at similarity 0.8 differ in 10
and more places, and pigeonhole blocks for such a radius hold under six bits, which all lines share.  A
sketch is ``HASHES`` minima over hashed grams, of 5 bytes for short lines and 8 for longer ones; lines near the
border have both (``CLASSES``).  A line is dealt by each of its first ``DEALT`` minima, the blocks; lines that
share one and two neighbours (2j, 2j + 1) of the others are candidates if enough minima are equal.  The search is not exact (the README has the measured recall); what it finds is verified.

How it runs: blocks of documents (see ``common``) reduce their lines to distinct ones; only hashes,
sketches and places are sent, in one exchange.  Tasks that hold the lines of some minima return, for each group that
candidate links connect, the strongest links that do.  Links that share a least neighbour meet in one bucket,
which gets the text of every line it compares once.  Large sets of links are dealt over several buckets.  A line that a
third of all documents hold is one entry a block.

A group that edit similarity takes apart is then searched whole: all its candidate links between lines that are not
connected yet are compared, so no candidate is lost for another that fails.  That step takes the square of such a group's
size in sketches, dealt in parts of it.

Equal lines are told by their 64-bit hash.

Defined cases: null text is one empty line; rows with null id come after all others; rows with equal
ids are ordered by their text; text left without lines is empty; an empty table gives an empty
result; columns other than id and text play no part and pass through unchanged.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.llm import common, hashing
from weftline.llm.byte_bpe import ragged
from weftline.llm.common import Block
from weftline.llm.components import connected, ensure_checkpoint_dir
from weftline.llm.edit_distance import Texts

SIMILARITY, MIN_WORDS, MIN_CHARS = 0.8, 5, 20
HASHES, DEALT, LAGS, STRONG = 32, 6, 24, 24
#: (bytes of a gram, minima that agree, fewest characters, characters that are too many): a pair whose longer line
#: is under 80 has both under 80; else the shorter has 64.  Long grams are rare by chance, short ones survive edits
#: of short lines.
CLASSES = ((5, 12, 0, 80), (8, 8, 64, 1 << 30))
GRAM = CLASSES[0][0]
LINKS = 1 << 14  # links of one least neighbour, or lines of one group, that stay in one bucket
_CHUNK = 1 << 16  # bytes whose grams are hashed at once
_HELD = 1 << 16  # lines that a task collects before it deals them to the tables
_PAIRS = 1 << 20  # pairs of a group whose sketches are compared at once
_FACTORS = np.random.default_rng(3).integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MARKS = string.punctuation + "\t\r\v\f"
_UPPER, _LOWER = string.ascii_uppercase + _MARKS, string.ascii_lowercase + " " * len(_MARKS)
_PLAIN = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_BLOCK, _TABLE, _PLACED, _AGAIN = 0, 1, 2, 3
#: Where a line stands first in a block.
_PLACE = np.dtype([("line", "<i8"), ("late", "u1"), ("doc_id", "<i8"), ("block", "<i8"), ("ordinal", "<i4"), ("number", "<i4")])
_FOUND = "a long, b long, agree int, line long, late boolean, doc_id long, block long, ordinal int, number int, payload binary, team long"


def normal_lines(text: bytes) -> list[bytes]:
    """The lines of a text, normalised."""
    text = text.translate(_PLAIN)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


def sketches(lines: list[bytes], gram: int) -> np.ndarray:
    """The minima of each line; every line has ``gram`` bytes at least."""
    out = np.empty((len(lines), HASHES), np.uint32)
    low, spread = np.uint64((1 << 8 * gram) - 1), np.uint64(0x9E3779B97F4A7C15 + 2 * gram)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    at = 0
    while at < len(lines):
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at : at + _CHUNK // gram]), _CHUNK)))
        own = size[at:end]
        data = b"".join(lines[at:end]) + bytes(8)
        start = np.cumsum(own) - own
        grams = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)) & low
        grams *= spread
        hashed = (grams >> np.uint64(32)).astype(np.uint32)
        edges = np.stack([start, start + own - gram + 1], axis=1).reshape(-1)  # grams inside a line, and those that leave it
        for k, factor in enumerate(_FACTORS):
            out[at:end, k] = np.minimum.reduceat(hashed * factor, edges)[::2]
        at = end
    return out


def _lines(block: Block, min_words: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """(hashes of a block's distinct lines, their first places and then those that repeat one as (ordinal, number),
    and for each class that some lines have (class, which lines, minima, characters))."""
    seen: dict[bytes, int] = {}
    first: list[tuple[int, int]] = []
    again: list[tuple[int, int]] = []
    for doc, text in enumerate(block.texts()):
        for number, line in enumerate(normal_lines(text)):
            if line:
                if seen.setdefault(line, len(first)) == len(first):
                    first.append((doc, number))
                else:
                    again.append((doc, number))
    lines = list(seen)
    chars = [len(x) if x.isascii() else len(x.decode("utf-8", "replace")) for x in lines]
    fuzzy = [k for k, x in enumerate(lines) if len(x) >= GRAM and (chars[k] >= MIN_CHARS or x.count(b" ") + 1 >= min_words)]
    found = []
    for kind, (gram, _, least, most) in enumerate(CLASSES):
        own = [k for k in fuzzy if least <= chars[k] < most]
        if own:
            found.append((kind, np.array(own), sketches([lines[k] for k in own], gram), np.array([chars[k] for k in own], np.uint32)))
    digest = xxhash.xxh3_64_digest
    hashed = np.frombuffer(b"".join([digest(x) for x in lines]), ">i8").astype(np.int64)
    return hashed, np.array([*first, *again], np.int64).reshape(-1, 2), found


def _to_tables(entries: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], per_table: int) -> pa.RecordBatch:
    """(class, hashes, minima, characters) of lines -> packed rows for each of the first minima, keyed by class, table
    and bucket of its value."""
    rows = []
    for kind in {e[0] for e in entries}:
        lines, minima, chars = (np.concatenate([e[i] for e in entries if e[0] == kind]) for i in (1, 2, 3))
        rest = np.ascontiguousarray(minima.astype(np.uint8))
        for t in range(DEALT):
            spread = minima[:, t] * np.uint32(0x9E3779B1)
            to = (spread.astype(np.uint64) * np.uint64(per_table) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            base = (kind * DEALT + t) * per_table
            rows += [(_TABLE, base + int(to[order[a]]), 0, common.pack_arrays(lines[k := order[a:b]], minima[k, t], chars[k]) + rest[k].tobytes()) for a, b in common.segments(to[order])]
    return common.packed(rows)


def _to_lines(places: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Places -> packed rows by bucket of the line's hash."""
    own = np.concatenate(places)
    to = common.bucket_of(np.ascontiguousarray(own["line"]).view(np.uint64), buckets)
    order = np.argsort(to, kind="stable")
    return common.packed([(_PLACED, int(to[order[a]]), 0, own[order[a:b]].tobytes()) for a, b in common.segments(to[order])])


def _first_pass(min_words: int, block_bytes: int, per_table: int, buckets: int):
    """Documents -> packed rows: each block and the places that repeat one of its own, first places by line, and lines
    with sketches for the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        firsts: list[np.ndarray] = []
        for key, block in common.blocks_of(batches, block_bytes):
            hashed, places, found = _lines(block, min_words)
            first, again = places[: len(hashed)], places[len(hashed) :]
            yield common.packed([(_BLOCK, key, 0, block.pack()), (_AGAIN, key, 0, common.pack_arrays(again.astype(np.int32).reshape(-1)))])
            own = np.empty(len(first), _PLACE)
            own["line"], own["late"], own["doc_id"], own["block"] = hashed, ~block.known[first[:, 0]], block.ids[first[:, 0]], key
            own["ordinal"], own["number"] = first[:, 0], first[:, 1]
            firsts.append(own)
            held += [(kind, hashed[own_], minima, chars) for kind, own_, minima, chars in found]
            if sum(map(len, firsts)) >= _HELD:
                yield _to_lines(firsts, buckets)
                yield _to_tables(held, per_table)
                firsts, held = [], []
        if firsts:
            yield _to_lines(firsts, buckets)
            yield _to_tables(held, per_table)
        common.release()

    return run


def _agree(minima: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (minima[a] == minima[b]).sum(axis=1, dtype=np.uint8)


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place is connected with, once a[k] and b[k] are."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def near_links(lines: np.ndarray, value: np.ndarray, minima: np.ndarray, chars: np.ndarray, table: int, similarity: float, agreeing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate links are those (a, b, minima that agree) between lines that share a value and two neighbours (2j, 2j + 1) of
    the other minima, as far as enough minima agree.  Returned are, of each group of lines that they connect, the strongest that connect it.

    A line meets the ``LAGS`` lines before it in order of length, but for those that links of ``STRONG`` equal
    minima connect with it already; what is left apart of a longer run is compared with all of the run."""
    order = np.argsort(chars, kind="stable")  # so that inside a run lengths ascend
    lines, value, minima, chars = lines[order], value[order], minima[order], chars[order]
    column = np.ascontiguousarray(minima.T)
    bits = np.uint64(max(1, len(lines)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    root, group, told = np.arange(len(lines)), np.arange(len(lines)), 0
    base, rank = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(len(lines), dtype=np.uint64)
    left, right, agreed = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
    for j in range(0, HASHES, 2):
        if table in (j, j + 1) or not len(lines):
            continue
        key = base ^ (column[j].astype(np.uint64) << np.uint64(8) | column[j + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key &= ~low
        key |= rank
        key.sort()
        run = key >> bits
        same = run[1:] == run[:-1]
        inside = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        rows, run = (key[inside] & low).astype(np.int64), run[inside]
        new = np.r_[True, run[1:] != run[:-1]] if len(run) else np.empty(0, bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
        open_at, began = np.flatnonzero(~new), len(left)
        for back in range(1, LAGS + 1):
            open_at = open_at[head[open_at] <= open_at - back]
            x, y = chars[rows[open_at]], chars[rows[open_at - back]]
            open_at = open_at[x - y <= (x * (1 - similarity) + 1e-9).astype(np.int64)]  # else all before are shorter still
            if not len(open_at):
                break
            at, before = rows[open_at], rows[open_at - back]
            apart = root[at] != root[before]
            at, before = at[apart], before[apart]
            count = _agree(minima, at, before)
            close = count >= agreeing
            left.append(before[close])
            right.append(at[close])
            agreed.append(count[close])
            if back & (back - 1) == 0:  # lag 1, 2, 4, ...; the rest at the end of the turn
                root = _union(root, left[-1][agreed[-1] >= STRONG], right[-1][agreed[-1] >= STRONG])
        open_at = open_at[head[open_at] < open_at - LAGS]
        if len(open_at):
            group, told = _union(group, np.concatenate(left[told:]), np.concatenate(right[told:])), len(left)
        for start in np.unique(head[open_at]).tolist():
            own = rows[start : int(np.searchsorted(head, start, side="right"))]
            names, which, size = np.unique(group[own], return_inverse=True, return_counts=True)
            for k in np.argsort(size, kind="stable")[:-1].tolist():  # each but the largest with all others that it was not compared with
                mine, own, which = own[which == k], own[which != k], which[which != k]
                for at in mine.tolist():
                    x, y = chars[own], chars[at]
                    near = own[np.abs(x - y) <= (np.maximum(x, y) * (1 - similarity) + 1e-9).astype(np.int64)]
                    count = _agree(minima, near, np.full(len(near), at))
                    close = count >= agreeing
                    left.append(np.full(int(close.sum()), at))
                    right.append(near[close])
                    agreed.append(count[close])
        if len(left) > began:
            strong = np.concatenate(agreed[began:]) >= STRONG
            root = _union(root, np.concatenate(left[began:])[strong], np.concatenate(right[began:])[strong])
    a, b, agree = np.concatenate(left), np.concatenate(right), np.concatenate(agreed)
    kept = _strongest(len(lines), a, b, agree)
    return lines[a[kept]], lines[b[kept]], agree[kept]


def _strongest(n: int, a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Numbers of links that connect what all links between n places connect, the strongest that do."""
    order = np.argsort(np.uint8(HASHES) - agree, kind="stable")
    a, b = a[order], b[order]
    root, left, kept = np.arange(n), np.arange(len(a)), [np.empty(0, np.int64)]
    while True:
        x, y = root[a[left]], root[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            return order[np.concatenate(kept)]
        best = np.full(n, len(a))  # each group's strongest link
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        kept.append(np.unique(best[best < len(a)]))
        root = _union(root, a[kept[-1]], b[kept[-1]])


def _groups(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """A name, which only the lines decide, of the group of each link; null for groups of two."""
    lines, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = _union(np.arange(len(lines)), x, y)
    name = np.zeros(len(lines), np.uint64)
    np.add.at(name, root, hashing.mix64(lines.view(np.uint64)))
    return pa.array(name[root[x]].view(np.int64), mask=np.bincount(root, minlength=len(lines))[root[x]] < 3)


def _second_pass(per_table: int, similarity: float):
    """A table's bucket -> candidate links; a bucket of lines -> the first place of each, and without a line's hash all
    other places; a block -> itself."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    out = pa.schema([(c.split()[0], k) for c, k in zip(_FOUND.split(", "), kinds, strict=True)])

    def links(table: int, payloads: list[bytes]) -> list[np.ndarray | pa.Array]:
        lines, value, chars, minima = [], [], [], []
        for p in payloads:
            *arrays, at = common.unpack_arrays_at(p)
            for to, array in zip((lines, value, chars), arrays, strict=True):
                to.append(array)
            minima.append(np.frombuffer(p, np.uint8, offset=at).reshape(-1, HASHES))
        _, once = np.unique(np.concatenate(lines), return_index=True)  # blocks repeat lines
        own = [np.concatenate(x)[once] for x in (lines, value, minima, chars)]
        kind, number = divmod(table, DEALT)
        a, b, agree = near_links(*own[:3], own[3].astype(np.int64), number, similarity, CLASSES[kind][1])
        return [np.minimum(a, b), np.maximum(a, b), agree.astype(np.int32), _groups(a, b)]

    def run(key: tuple[Any, ...], group: pa.Table) -> pa.Table:
        payloads = group["payload"].to_pylist()
        kind, number = key[0].as_py(), key[1].as_py()
        if kind == _BLOCK:
            columns = [pa.nulls(1, k) for k in kinds[:6]] + [pa.array([number]), *(pa.nulls(1, k) for k in kinds[7:9]), pa.array(payloads, pa.binary()), pa.nulls(1, kinds[10])]
        elif kind == _TABLE:
            *found, team = links(number // per_table, payloads)
            columns = [pa.array(x) for x in found] + [pa.nulls(len(team), k) for k in kinds[3:10]] + [team]
        elif kind == _AGAIN:
            again = common.unpack_arrays(payloads[0])[0].reshape(-1, 2)
            n = len(again)
            columns = [pa.nulls(n, k) for k in kinds[:6]] + [pa.array(np.full(n, number)), pa.array(again[:, 0]), pa.array(again[:, 1]), *(pa.nulls(n, k) for k in kinds[9:])]
        else:
            own = np.frombuffer(b"".join(payloads), _PLACE)
            own = own[np.lexsort([own[c] for c in ("number", "ordinal", "block", "doc_id", "late", "line")])]
            again = np.r_[False, own["line"][1:] == own["line"][:-1]]
            place = [pa.array(np.ascontiguousarray(own[c])).cast(k) for c, k in zip(_PLACE.names[1:], kinds[4:9], strict=True)]
            columns = [pa.nulls(len(own), k) for k in kinds[:3]] + [pa.array(np.ascontiguousarray(own["line"]), mask=again), *place, *(pa.nulls(len(own), k) for k in kinds[9:])]
        common.release()
        return pa.Table.from_arrays(columns, schema=out)

    return run


def _fetch():
    """A block and the places asked of it -> the normalised texts, for the buckets that asked; ``once`` marks one row a line."""
    out = pa.schema([("bucket", pa.int64()), ("line", pa.int64()), ("text", pa.string()), ("once", pa.bool_())])

    def run(key: tuple[Any, ...], group: pa.Table, asked: pa.Table) -> pa.Table:
        if not group.num_rows or not asked.num_rows:
            return out.empty_table()
        block = Block.unpack(group["payload"][0].as_py())
        ordinal, number = asked["ordinal"].to_pylist(), asked["number"].to_pylist()
        edge, cut = block.offsets.tolist(), {}
        texts = []
        for doc, spot in zip(ordinal, number, strict=True):
            if doc not in cut:
                cut[doc] = normal_lines(block.data[edge[doc] : edge[doc + 1]])
            texts.append(cut[doc][spot].decode("utf-8", "replace"))
        once = np.zeros(len(texts), bool)
        once[np.unique(asked["line"].to_numpy(), return_index=True)[1]] = True
        return pa.Table.from_arrays([asked["bucket"].combine_chunks(), asked["line"].combine_chunks(), pa.array(texts, pa.string()), pa.array(once)], schema=out)

    return run


def _verify(similarity: float):
    """A bucket's links and texts -> the links that edit similarity keeps, inside components one path of them."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key: tuple[Any, ...], links: pa.Table, texts: pa.Table) -> pa.Table:
        if not links.num_rows:
            return out.empty_table()
        a, b = links["a"].to_numpy(), links["b"].to_numpy()
        lines, at = np.unique(texts["line"].to_numpy(), return_index=True)
        found = texts["text"].to_pylist()
        held = Texts([found[k] for k in at.tolist()])
        good = held.forest(np.searchsorted(lines, a), np.searchsorted(lines, b), links["agree"].to_numpy(), similarity)
        common.release()
        return pa.Table.from_arrays([pa.array(a[good]), pa.array(b[good])], schema=out)

    return run


def _between(cell: np.ndarray, team: np.ndarray, sketch: list[np.ndarray], chars: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate links (a, b, minima that agree) between lines of one cell and different teams; lines ascend by cell, then
    length."""
    limit = (chars * (1 - similarity) + 1e-9).astype(np.int64)
    high = np.searchsorted((cell << 32) + chars - limit, (cell << 32) + chars, side="right")
    size = high - np.arange(len(cell)) - 1
    edge, at = np.cumsum(size), 0
    while at < len(cell):
        end = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + _PAIRS, side="right")))
        a, b = np.repeat(np.arange(at, end), size[at:end]), ragged(np.arange(at + 1, end + 1), size[at:end])
        at = end
        apart = team[a] != team[b]
        a, b = a[apart], b[apart]
        for minima, (_, agreeing, least, most) in zip(sketch, CLASSES, strict=True):
            own = np.flatnonzero((chars[a] >= least) & (chars[b] < most))
            count = _agree(minima, a[own], b[own])
            close = count >= agreeing
            yield a[own[close]], b[own[close]], count[close]


def _first_common(wide: np.ndarray, used: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of the names in row a[k] that row b[k] has too; rows ascend."""
    out, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(wide.shape[1]):
        name = wide[a, k]
        hit = open_ & used[a, k] & ((wide[b] == name[:, None]) & used[b]).any(axis=1)
        out[hit] = name[hit]
        open_ &= ~hit
    return out


def _search(similarity: float):
    """A bucket's groups and texts -> links between the teams of a group's lines, by the teams' names."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key: tuple[Any, ...], members: pa.Table, texts: pa.Table) -> pa.Table:
        if not members.num_rows:
            return out.empty_table()
        known, at = np.unique(texts["line"].to_numpy(), return_index=True)
        every = texts["text"].to_pylist()
        held = Texts([every[k] for k in at.tolist()])
        cell = np.unique(members["cell"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        line, team = np.searchsorted(known, members["line"].to_numpy()), members["root"].to_numpy()
        order = np.lexsort([held.size[line], cell])
        cell, line, team = cell[order], line[order], team[order]
        group, held_by = members["group"].to_numpy()[order], members["groups"].to_pylist()
        wide = np.zeros((len(line), max(map(len, held_by))), np.int64)
        for k, at_ in enumerate(order.tolist()):
            wide[k, : len(held_by[at_])] = held_by[at_]
        used = np.arange(wide.shape[1]) < np.array([len(held_by[k]) for k in order.tolist()])[:, None]
        sketch = []
        for gram, _, least, most in CLASSES:
            own = np.flatnonzero((held.size >= least) & (held.size < most))
            minima = np.zeros((len(known), HASHES), np.uint8)
            if len(own):
                minima[own] = sketches([held.texts[k].encode() for k in own.tolist()], gram).astype(np.uint8)
            sketch.append(minima[line])
        names, which = np.unique(team, return_inverse=True)
        root, good = np.arange(len(names)), []
        for a, b, agree in _between(cell, team, sketch, held.size[line], similarity):
            own = _first_common(wide, used, a, b) == group[a]  # two lines meet in several groups and are compared in one
            a, b, agree = a[own], b[own], agree[own]
            if len(a):
                picked = held.forest(line[a], line[b], agree, similarity, root, which[a], which[b])
                good.append(np.stack([which[a[picked]], which[b[picked]]]))
                root = _union(root, *good[-1])
        common.release()
        x, y = np.concatenate([np.empty((2, 0), np.int64), *good], axis=1)
        return pa.Table.from_arrays([pa.array(names[x]), pa.array(names[y])], schema=out)

    return run


def _finish(with_text: bool, schema: pa.Schema):
    """A block and the places that go -> its documents without them."""

    def run(key: tuple[Any, ...], group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        block = Block.unpack(group["payload"][0].as_py())
        dropped: dict[int, set[int]] = {}
        for doc, line in zip(told["ordinal"].to_pylist(), told["number"].to_pylist(), strict=True):
            dropped.setdefault(doc, set()).add(line)
        texts, digests, n_lines, removed = [], [], [], []
        for k, text in enumerate(block.texts()):
            off = dropped.get(k)
            n_lines.append(text.count(b"\n") + 1)
            removed.append(len(off or ()))
            if off:
                text = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in off])
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode("utf-8", "replace") if with_text else None)
        columns = [pa.array(block.id_list(), pa.int64()), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
        if block.rest is not None:
            columns.append(block.rest.cast(schema.field("rest").type))
        out = pa.Table.from_arrays(columns, schema=schema)
        common.release()
        return out

    return run


def _in_buckets(links: DataFrame, buckets: int, most: int) -> DataFrame:
    """Links with the bucket that compares them: those whose later line has the same least neighbour meet, unless
    they are more than ``most``, which are dealt by their later line."""
    ends = links.select("b", "a").unionAll(links.select("a", "b"))
    least = ends.groupBy("b").agg(F.min("a").alias("m")).select("b", F.least("b", "m").alias("least"))
    named = links.join(least, "b")
    large = named.groupBy("least").agg(F.count("*").alias("n")).where(F.col("n") > most).select("least", F.ceil(F.col("n") / most).alias("shares"))
    dealt = named.join(large, "least", "left").withColumn("share", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("shares"))))
    return dealt.select(F.pmod(F.xxhash64("least", "share"), F.lit(buckets)).alias("bucket"), "a", "b", "agree")


def _open_groups(near: DataFrame, links: DataFrame, groups: DataFrame, buckets: int, most: int) -> DataFrame:
    """The lines (bucket, cell, line, root, group, all groups of the line) of groups whose links did not all hold.  All pairs of a group meet in one of
    its cells, which hold at most ``most`` lines or so."""
    end = lambda c: groups.select(F.col("line").alias(c), F.col("team").alias(f"{c}_team"))
    failed = links.join(end("a"), "a", "left").join(end("b"), "b", "left").where("coalesce(a_team, a) <> coalesce(b_team, b)").select("a", "b")
    named = near.where("team is not null").select(F.col("team").alias("group"), "a", "b")
    open_ = named.join(failed, ["a", "b"]).select("group").distinct()
    lines = named.join(open_, "group").select("group", F.explode(F.array("a", "b")).alias("line")).distinct()
    n = F.count("*").over(W.partitionBy("group"))
    lines = lines.withColumn("groups", F.sort_array(F.collect_set("group").over(W.partitionBy("line"))))
    shares = lines.withColumn("shares", F.when(n > most, F.ceil(2 * n / most)).otherwise(1)).withColumn("share", F.pmod(F.xxhash64("line"), F.col("shares")))
    other = F.explode(F.when(F.col("shares") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1), lambda x: x != F.col("share"))))
    celled = shares.withColumn("other", other).withColumn("cell", F.xxhash64("group", F.least("share", "other"), F.greatest("share", "other")))
    return celled.join(groups, "line", "left").select(F.pmod("cell", F.lit(buckets)).alias("bucket"), "cell", "line", F.coalesce("team", "line").alias("root"), "group", "groups")


def _dedup(texts: DataFrame, similarity: float, min_words: int, with_text: bool, buckets: int | None, block_bytes: int, most: int) -> DataFrame:
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    parts = common.shuffle_partitions(spark)
    n = buckets or 2 * parts
    per_table = max(1, -(-n // DEALT))
    # one pass over the texts; what it leaves, compressed blocks included, is saved for the passes that follow
    packed = texts.mapInArrow(_first_pass(min_words, block_bytes, per_table, n), common.PACKED).repartition(parts, "kind", "key")
    found = common.saved(packed.groupBy("kind", "key").applyInArrow(_second_pass(per_table, similarity), _FOUND))
    near = found.where("a is not null").select("a", "b", "agree", "team")
    links = common.saved(_in_buckets(common.saved(near.select("a", "b", "agree").distinct()), parts, most))
    ends = links.select("bucket", F.explode(F.array("a", "b")).alias("line")).distinct()
    # the first places of the lines that have links
    first = found.where("line is not null").select("line", F.struct("late", "doc_id", "block", "ordinal", "number").alias("first"))
    linked = common.saved(first.join(ends.select("line").distinct(), "line"))
    grouped = found.where("payload is not null").select(F.lit(_BLOCK).alias("kind"), F.col("block").alias("key"), "payload").repartition(parts, "kind", "key").groupBy("kind", "key")
    asked = ends.join(linked, "line").select(F.lit(_BLOCK).alias("kind"), F.col("first.block").alias("key"), "bucket", "line", "first.ordinal", "first.number")
    fetched = common.saved(grouped.cogroup(asked.groupBy("kind", "key")).applyInArrow(_fetch(), "bucket long, line long, text string, once boolean"))
    verified = links.groupBy("bucket").cogroup(fetched.select("bucket", "line", "text").groupBy("bucket")).applyInArrow(_verify(similarity), "a long, b long")
    groups = common.saved(connected(verified).select(F.col("node").alias("line"), F.col("root").alias("team")))
    # groups that fell apart: what else connects their lines
    again = common.saved(_open_groups(near, links, groups, parts, most))
    needed = again.select(F.col("bucket").alias("to"), "line").distinct().join(fetched.where("once").select("line", "text"), "line").select(F.col("to").alias("bucket"), F.col("line").alias("line"), "text")
    more = again.groupBy("bucket").cogroup(needed.groupBy("bucket")).applyInArrow(_search(similarity), "a long, b long")
    joined = common.saved(connected(more).select(F.col("node").alias("team"), F.col("root").alias("whole")))
    alone = joined.join(groups, joined["team"] == groups["line"], "left_anti").select(F.col("team").alias("line"), F.col("whole").alias("team"))
    groups = groups.join(joined, "team", "left").select("line", F.coalesce("whole", "team").alias("team")).unionAll(alone)
    # of a group's first places all but the very first go; of a line's places all but its first went already
    teamed = linked.join(groups, "line")
    kept = teamed.groupBy("team").agg(F.min("first").alias("keep"))
    lost = teamed.join(kept, "team").where("first <> keep").select("first.block", "first.ordinal", "first.number")
    told = lost.unionAll(found.where("line is null and ordinal is not null").select("block", "ordinal", "number"))
    told = told.select(F.lit(_BLOCK).alias("kind"), F.col("block").alias("key"), "ordinal", "number")
    schema = T.StructType.fromDDL("doc_id long, n_lines long, n_removed long, kept_sha256 string, kept_text string")
    if "rest" in texts.columns:
        schema = schema.add("rest", texts.schema["rest"].dataType)
    return grouped.cogroup(told.groupBy("kind", "key")).applyInArrow(_finish(with_text, to_arrow_schema(schema)), schema)


def dedup_lines(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = True,
    buckets: int | None = None,
    block_bytes: int = common.BLOCK_BYTES,
    most: int = LINKS,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256, kept_text."""
    return _dedup(common.keyed_texts(docs, id_col, text_col), similarity, min_words, with_text, buckets, block_bytes, most)


def documents_without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options: Any) -> DataFrame:
    """docs with the repeated lines gone: same columns, every document, the length column kept true."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    settings = {"similarity": SIMILARITY, "min_words": MIN_WORDS, "buckets": None, "block_bytes": common.BLOCK_BYTES, "most": LINKS} | options
    out = _dedup(common.keyed_texts(docs, id_col, text_col, rest), with_text=True, **settings)
    columns = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("kept_text")} | {c: F.col(f"rest.c{i}") for i, c in enumerate(rest)}
    if chars_col in columns:
        columns[chars_col] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(columns[chars_col]).cast(docs.schema[chars_col].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
