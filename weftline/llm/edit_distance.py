"""Edit similarity: 1 - edit distance / longer length in characters, exact.

Cheap bounds come first: lengths, character counts, an alignment at unique words.  What they leave
undecided goes through bit-parallel columns, over arrays for many pairs at once and over Python's
integers for long texts.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np

LONG = 4096  # characters from which pairs are compared one by one, an alignment at unique words first
BATCH = 2048  # pairs compared at once
_ALONE = 12  # columns of one pair that take the time of a column of few pairs at once
_CELLS = 1 << 21  # pairs times columns at once
_TABLE = 1 << 22  # places of the table of rows by character
_COUNTS = 8192  # pairs whose character counts are compared at once
_ONE, _LAST = np.uint64(1), np.uint64(63)


def _trim(a: str, b: str) -> tuple[str, str]:
    """Both without their common beginning and end."""
    if a and b and a[0] != b[0] and a[-1] != b[-1]:
        return a, b
    n, m = 0, min(len(a), len(b))
    step = m
    while step:  # doubling back: whole slices compare at once
        while n + step <= m and a[n : n + step] == b[n : n + step]:
            n += step
        step //= 2
    a, b = a[n:], b[n:]
    k, m = 0, m - n
    step = m
    while step:
        while k + step <= m and a[len(a) - k - step : len(a) - k] == b[len(b) - k - step : len(b) - k]:
            k += step
        step //= 2
    return a[: len(a) - k], b[: len(b) - k]


def _distance(a: str, b: str, limit: int) -> int:
    """Edit distance by bit-parallel columns; limit + 1 as soon as it must exceed the limit."""
    a, b = _trim(a, b)
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for left, c in enumerate(b):
        eq = where.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score - (len(b) - left - 1) > limit:  # the rest lowers it by one a column at most
            return limit + 1
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus = down | (full & ~(zero | up))
        minus = up & zero
    return score


def _aligned_bound(a: str, b: str, limit: int) -> int:
    """An upper bound of the distance: the texts aligned at words that both have once, and the stretches
    between them compared on their own."""
    sides = []
    for text in (a, b):
        spots, at, seen = {}, 0, set()
        for word in text.split(" "):
            if word in seen:
                spots.pop(word, None)
            else:
                seen.add(word)
                spots[word] = at
            at += len(word) + 1
        sides.append(spots)
    pairs = [(x, sides[1][w], len(w)) for w, x in sides[0].items() if w and w in sides[1]]
    pairs.sort()
    # the longest rising sequence of places in b
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y, _) in enumerate(pairs):
        k = bisect.bisect_left(ends, y)
        back[i] = tails[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [i], [y]
    chain, i = [], tails[-1] if tails else -1
    while i >= 0:
        chain.append(pairs[i])
        i = back[i]
    total = x0 = y0 = 0
    for x, y, n in [*reversed(chain), (len(a), len(b), 0)]:
        p, q = a[x0:x], b[y0:y]
        if p != q:
            p, q = _trim(p, q)
            total += _distance(p, q, max(len(p), len(q))) if min(len(p), len(q)) <= 2000 else max(len(p), len(q))
            if total > limit:
                break
        x0, y0 = x + n, y + n
    return total


#: How many words either side skips until both agree again, nearest first.
_SKIPS = ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0), (3, 3))


def _words_within(a: str, b: str, limit: int) -> bool:
    """Whether an alignment of words in one sweep needs at most limit edits; if not, the distance may still be less."""
    x, y = a.split(" "), b.split(" ")
    if sum(map(len, set(x).difference(y))) > limit:  # every word that the other lacks is an edit of its length
        return False
    n, m, i, j, cost = len(x), len(y), 0, 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        for p, q in _SKIPS:
            if i + p < n and j + q < m and x[i + p] == y[j + q]:
                break
        else:
            p = q = 1
        cost += max(sum(map(len, x[i : i + p])) + p - (q > 0), sum(map(len, y[j : j + q])) + q - (p > 0))
        if cost > limit:
            return False
        i += p
        j += q
    left, right = sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j
    return cost + max(left, right) <= limit


def edit_distance_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most limit.

    Long texts first try two bounds that cost little: characters that one has more of than the other
    (at least so many edits) and an alignment at unique words (at most so many)."""
    if abs(len(a) - len(b)) > limit:
        return False
    a, b = _trim(a, b)
    if not a or not b or max(len(a), len(b)) <= limit:
        return max(len(a), len(b)) <= limit
    if min(len(a), len(b)) > LONG:
        more, less = Counter(a), Counter(b)
        if max((more - less).total(), (less - more).total()) > limit:
            return False
        if _aligned_bound(a, b, limit) <= limit:
            return True
    return _distance(a, b, limit) <= limit


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether the edit distance is at most 1 - similarity of the longer length."""
    longer = max(len(a), len(b))
    return edit_distance_within(a, b, int(longer * (1 - similarity) + 1e-9))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """All texts' characters as dense codes, where each text starts, how many codes there are."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    flat = np.concatenate(raw)
    seen = np.zeros(0x110000, bool)
    seen[flat] = True
    present = np.flatnonzero(seen)
    place = np.empty(0x110000, np.int64)
    place[present] = np.arange(len(present))
    return place[flat], np.cumsum([0, *map(len, raw)])[:-1], len(present)


def within_many(a: list[str], b: list[str], limits: np.ndarray) -> np.ndarray:
    """Whether the edit distance of a[k] and b[k] is at most limits[k], for each k; no text is empty.

    64 rows (characters of a) of all pairs go through the columns that a path of at most the limit can reach, then the next
    64.  Such a path crosses the last of these rows somewhere: where the least that this costs, and the lengths that then
    remain, are over the limit, the pair is done.  Cells beside those columns count as more than they are, never as less."""
    out = np.zeros(len(a), bool)
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    own = np.flatnonzero(np.abs(m - n) <= limits)
    if not len(own):
        return out
    flat, start, alphabet = _codes([x[k] for x in (a, b) for k in own.tolist()])
    if (alphabet + 1) * len(own) > _TABLE and len(own) > 1:
        for part in (own[: len(own) // 2], own[len(own) // 2 :]):
            out[part] = within_many([a[k] for k in part.tolist()], [b[k] for k in part.tolist()], limits[part])
        return out
    m, n, limit, start_a, start_b = m[own], n[own], limits[own], start[: len(own)], start[len(own) :]
    flat = np.r_[flat, alphabet]  # the code of no character
    most, wide = int(limit.max()), int(n.max())
    # for the columns so far, the characters of b, and how the row above changes from column to column
    text, plus_in, minus_in = np.empty((0, len(own)), np.int64), np.empty((0, len(own)), np.uint64), np.empty((0, len(own)), np.uint64)
    corner, from_, to = np.zeros(len(own), np.int32), 0, 0  # the distance in the row above, left of the first column
    for row in range(0, int(m.max()), 64):
        if int(n.sum()) < _ALONE * (64 + 2 * most) * min(4, -(-(int(m.max()) - row) // 64)):  # few are faster one by one
            out[own] = [_distance(a[k], b[k], z) <= z for k, z in zip(own.tolist(), limit.tolist(), strict=True)]
            break
        pairs, before, to = len(own), to, min(wide, row + 64 + most)
        column = np.arange(before, to)[:, None]
        text = np.concatenate([text, flat[np.where(column < n, start_b + column, -1)]])
        plus_in, minus_in = np.concatenate([plus_in, np.ones((to - before, pairs), np.uint64)]), np.concatenate([minus_in, np.zeros((to - before, pairs), np.uint64)])
        rows = np.arange(row, row + 64)[:, None]
        code = flat[np.where(rows < m, start_a + rows, -1)]
        lane = np.arange(pairs)
        where = np.zeros((alphabet + 1) * pairs, np.uint64)  # rows of each code
        for i in range(64):
            where[code[i] * pairs + lane] |= _ONE << np.uint64(i)
        where[alphabet * pairs :] = 0
        top = np.minimum(m - row - 1, 63).astype(np.uint64)
        plus, minus = np.full(pairs, ~np.uint64(0)), np.zeros(pairs, np.uint64)
        place = text * pairs + lane
        eq, zero, up, vertical = (np.empty(pairs, np.uint64) for _ in range(4))
        for t in range(len(text)):
            in_plus, in_minus = plus_in[t], minus_in[t]
            np.take(where, place[t], out=eq, mode="clip")
            np.bitwise_or(eq, minus, out=vertical)
            eq |= in_minus
            np.bitwise_and(eq, plus, out=zero)
            zero += plus
            zero ^= plus
            zero |= eq
            np.bitwise_or(zero, plus, out=up)
            np.invert(up, out=up)
            up |= minus
            down = np.bitwise_and(plus, zero, out=zero)
            np.right_shift(up, top, out=eq)
            up <<= _ONE
            up |= in_plus
            np.bitwise_and(eq, _ONE, out=in_plus)
            np.right_shift(down, top, out=eq)
            down <<= _ONE
            down |= in_minus
            np.bitwise_and(eq, _ONE, out=in_minus)
            np.bitwise_or(vertical, up, out=plus)
            np.invert(plus, out=plus)
            plus |= down
            np.bitwise_and(up, vertical, out=minus)
        height = np.minimum(m, row + 64)
        score = np.empty((to - from_ + 1, pairs), np.int32)  # of the last row
        score[0] = corner + height - row
        np.subtract(plus_in.view(np.int64), minus_in.view(np.int64), out=score[1:], casting="unsafe")
        np.cumsum(score, axis=0, out=score)
        ends = m <= row + 64
        done = np.flatnonzero(ends)
        out[own[done]] = score[n[done] - from_, done] <= limit[done]
        edge = np.arange(from_, to + 1, dtype=np.int32)[:, None]
        left = np.abs((m - height - n).astype(np.int32) + edge)
        left += score
        left[edge > n] = np.iinfo(np.int32).max
        keep = np.flatnonzero(~ends & (left.min(axis=0) <= limit))
        if not len(keep):
            break
        next_ = max(0, row + 64 - most)
        corner = score[next_ - from_]
        text, plus_in, minus_in = (x[next_ - from_ :] for x in (text, plus_in, minus_in))
        from_ = next_
        if len(keep) < pairs:
            own, m, n, limit, start_a, start_b, corner = (x[keep] for x in (own, m, n, limit, start_a, start_b, corner))
            text, plus_in, minus_in = (x.take(keep, axis=1) for x in (text, plus_in, minus_in))
    return out


class Texts:
    """Texts with their character counts, for comparing many pairs of them."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        # how often each character (modulo 64) occurs
        self.marks = np.empty((len(texts), 64), np.int32)
        for row, t in enumerate(texts):
            self.marks[row] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64)

    def similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether texts a[k] and b[k] reach the similarity, for each k."""
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)  # b is the longer
        limit = (self.size[b] * (1 - similarity) + 1e-9).astype(np.int64)
        out = np.zeros(len(a), bool)
        open_ = np.flatnonzero(self.size[b] - self.size[a] <= limit)
        if len(open_):  # what one text has more of than the other costs edits
            least = np.empty(len(open_), np.int64)
            for at in range(0, len(open_), _COUNTS):
                k = open_[at : at + _COUNTS]
                more = self.marks[b[k]] - self.marks[a[k]]
                least[at : at + _COUNTS] = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
            open_ = open_[least <= limit[open_]]
        hard: list[tuple[int, int, str, str]] = []
        for k, most, x, y in zip(open_.tolist(), limit[open_].tolist(), a[open_].tolist(), b[open_].tolist(), strict=True):
            p, q = self.texts[x], self.texts[y]
            if len(q) > LONG:
                out[k] = edit_distance_within(p, q, most)
                continue
            p, q = _trim(p, q)
            if not p or len(q) <= most:
                out[k] = len(q) <= most
            elif _words_within(p, q, most):
                out[k] = True
            else:
                hard.append((most, k, p, q))
        hard.sort(key=lambda h: h[:2])
        at = 0
        while at < len(hard):
            end = at + bisect.bisect_right(hard[at : at + BATCH], hard[at][0] * 5 // 4 + 16, key=lambda h: h[0])
            while end - at > 1 and (end - at) * max(len(h[3]) for h in hard[at:end]) > _CELLS:
                end = at + (end - at) // 2
            _, k, p, q = (list(x) for x in zip(*hard[at:end], strict=True))
            out[k] = within_many(p, q, limit[k])
            at = end
        return out

    def forest(
        self,
        a: np.ndarray,
        b: np.ndarray,
        likely: np.ndarray,
        similarity: float,
        root: np.ndarray | None = None,
        from_: np.ndarray | None = None,
        to: np.ndarray | None = None,
    ) -> np.ndarray:
        """Numbers of links that reach the similarity and connect all that such links connect.

        The likeliest links of each component are compared first, then more and more; a link inside a
        component has nothing to add and is not compared.  Links may connect other things than texts: ``from_`` and ``to``,
        of which ``root`` tells the components."""
        root = np.arange(len(self.texts)) if root is None else root.copy()
        from_, to = a if from_ is None else from_, b if to is None else to
        left, found, many = np.lexsort((b, a, -likely)), [], 1
        while len(left):
            picked = np.zeros(len(left), bool)
            for end in (root[from_[left]], root[to[left]]):
                order = np.argsort(end, kind="stable")
                ranked = end[order]
                first = np.r_[True, ranked[1:] != ranked[:-1]]
                rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                picked[order[rank < many]] = True
            tried = left[picked]
            good = tried[self.similar(a[tried], b[tried], similarity)]
            for k, x, y in zip(good.tolist(), from_[good].tolist(), to[good].tolist(), strict=True):
                x, y = self._find(root, x), self._find(root, y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append(k)
            while (root[root] != root).any():
                root = root[root]
            left = left[~picked]
            left = left[root[from_[left]] != root[to[left]]]
            many *= 4
        return np.array(found, np.int64)

    @staticmethod
    def _find(root: np.ndarray, x: int) -> int:
        while root[x] != x:
            x = int(root[x])
        return x
