"""Suffix sorting by difference-cover blockwise construction, to a fixed depth.

A difference cover D modulo v holds, for any two residues, a shift below v that brings both
into D.  The suffixes at positions in D get ranks first.  The wanted suffixes are then sorted one
bucket of leading bytes at a time: by their first v bytes, and where those tie, by the ranks of the
cover suffixes that the shift leads to.  Beyond the text and the ranks, memory holds one bucket.
"""

from __future__ import annotations

import functools

import numpy as np


def difference_cover(root: int) -> tuple[int, list[int]]:
    """A difference cover modulo root**2: 0..root-1 and every root-th from root-1 on."""
    return root * root, sorted({*range(root), *range(root - 1, root * root, root)})


def shifts(v: int, cover: list[int]) -> np.ndarray:
    """shift[a, b]: smallest d with a+d and b+d both in the cover modulo v."""
    inside = np.zeros(v, bool)
    inside[cover] = True
    out = np.full((v, v), -1, np.int64)
    for d in range(v - 1, -1, -1):
        at = inside[(np.arange(v) + d) % v]
        out[np.ix_(at, at)] = d
    assert (out >= 0).all()
    return out


def words_at_every_byte(text: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit word that starts at each byte; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    return np.ndarray(len(text) + 8, ">u8", padded, strides=(1,))


def _refine(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, key), and the refined groups in that order (groups ascend)."""
    order = np.argsort(key)
    order = order[np.argsort(group[order], kind="stable")]
    g, k = group[order], key[order]
    return order, np.cumsum(np.r_[0, (g[1:] != g[:-1]) | (k[1:] != k[:-1])])


def _sort_to(words: np.ndarray, starts: np.ndarray, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(order, group number of each sorted suffix), by the words at the given offsets in turn."""
    size = len(words)
    key = words[np.minimum(starts + offsets[0], size - 1)].astype(np.uint64)
    order = np.argsort(key)
    ranked = key[order]
    group = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]]) if len(order) else np.empty(0, np.int64)
    for offset in offsets[1:]:
        same = group[1:] == group[:-1] if len(group) else np.empty(0, bool)
        tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(group) else np.empty(0, np.int64)
        if not len(tied):
            break
        own = order[tied]
        sub, _ = _refine(group[tied], words[np.minimum(starts[own] + offset, size - 1)].astype(np.uint64))
        order[tied] = own[sub]
        key = words[np.minimum(starts[order[tied]] + offset, size - 1)]
        new = np.r_[True, group[1:] != group[:-1]]
        inner = np.r_[True, (key[1:] != key[:-1]) | (np.diff(tied) != 1)]
        new[tied] |= inner
        group = np.cumsum(new) - 1
    return order, group


def word_offsets(depth: int) -> list[int]:
    """Offsets whose 8-byte words cover depth bytes exactly (depth of 8 at least)."""
    return [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]


def sort_suffixes(text: np.ndarray, starts: np.ndarray, depth: int, root: int = 5, bucket_limit: int = 1 << 18) -> np.ndarray:
    """The order that sorts text[s : s + depth] for the given starts; ties come in any order."""
    v, cover = difference_cover(root)
    depth = max(depth, 8)
    words = words_at_every_byte(text)
    if depth <= v:
        return _sort_to(words, starts, word_offsets(depth))[0]
    # ranks of the cover suffixes that ties can lead to
    inside = np.zeros(v, bool)
    inside[cover] = True
    shift = shifts(v, cover)
    need = np.zeros(len(text) + 1, bool)
    need[starts] = True
    reach = need.copy()
    span = 1
    while span < v:  # positions less than v behind a start
        step = min(span, v - span)
        reach[step:] |= reach[:-step].copy()
        span += step
    sample = np.flatnonzero(reach & np.resize(inside, len(reach)))
    by, group = _sort_to(words, sample, word_offsets(depth))
    rank = np.zeros(len(text) + 1, np.int64)
    rank[sample[by]] = group
    # buckets of leading bytes
    lead = (words[starts] >> np.uint64(48)).astype(np.int64)
    counts = np.bincount(lead, minlength=1 << 16)
    bucket = np.cumsum(counts) // max(1, bucket_limit)
    own = bucket[lead]
    out = []
    head = word_offsets(v)
    for b in np.unique(own).tolist():
        part = np.flatnonzero(own == b)
        at = starts[part]
        order, group = _sort_to(words, at, head)
        same = group[1:] == group[:-1]
        tied = np.r_[False, same] | np.r_[same, False]
        where = np.flatnonzero(tied)
        if len(where):
            residue = at[order[where]] % v
            g = group[where]
            edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            low, high = np.minimum.reduceat(residue, edge), np.maximum.reduceat(residue, edge)
            size = np.diff(np.r_[edge, len(g)])
            alike = np.repeat(low == high, size)
            pure = where[alike]
            if len(pure):  # one residue: one shift for the whole tie
                pos = at[order[pure]]
                key = rank[pos + shift[pos % v, pos % v]]
                sub, _ = _refine(group[pure], key)
                order[pure] = order[pure][sub]
            for e, n in zip(edge[low != high].tolist(), size[low != high].tolist(), strict=True):
                pos = at[order[where[e : e + n]]]

                def before(x: int, y: int, pos: np.ndarray = pos) -> int:
                    d = shift[pos[x] % v, pos[y] % v]
                    return int(rank[pos[x] + d]) - int(rank[pos[y] + d])

                sub = sorted(range(n), key=functools.cmp_to_key(before))
                order[where[e : e + n]] = order[where[e : e + n]][sub]
        out.append(part[order])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def equal_runs(text: np.ndarray, ordered: np.ndarray, depth: int) -> np.ndarray:
    """Run number of each sorted start: neighbours share a run if their first ``depth`` bytes agree."""
    words = words_at_every_byte(text)
    same = np.ones(max(len(ordered) - 1, 0), bool)
    for offset in word_offsets(depth):
        key = words[ordered + offset]
        same &= key[1:] == key[:-1]
    return np.cumsum(np.r_[0, ~same]) if len(ordered) else np.empty(0, np.int64)
