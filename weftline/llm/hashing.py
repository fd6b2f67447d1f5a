"""Vectorised rolling hashes over bytes and words (polynomials modulo 2**64, then mixed)."""

from __future__ import annotations

import numpy as np

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so they have inverses modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: after it every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Each byte value's random-looking coefficient.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, modulo 2**64; short tables are kept per process, long ones are
    made anew: a worker that waits should not hold them."""
    if base in _powers and len(_powers[base][0]) > n:
        return _powers[base]
    size = max(n + 1, 1 << 16)
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(size, b, np.uint64)
        a[0] = 1
        both.append(np.cumprod(a, out=a))
    if size <= 1 << 18:
        _powers[base] = (both[0], both[1])
    return both[0], both[1]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    up, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end) for each pair, from their prefix sums."""
    _, down = powers(base, len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, index of the first word of each document and the total) of words that
    ASCII white space separates; a document's edge ends a word as well."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)  # where a document starts
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:-1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix(BYTE_VALUE[np.frombuffer(data, np.uint8)], _BYTE_BASE)
    return spans_hash(sums, starts, ends, _BYTE_BASE)


def windows(values: np.ndarray, bounds: np.ndarray, width: int, base: int = _WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of every window of ``width`` values that lies inside one document."""
    lengths = np.diff(bounds)
    counts = np.maximum(lengths - width + 1, 0)
    total = int(counts.sum())
    starts = np.arange(total) + np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    if not total:
        return starts, np.empty(0, np.uint64)
    return starts, spans_hash(prefix(values, base), starts, starts + width, base)


def byte_windows(data: bytes, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return windows(BYTE_VALUE[np.frombuffer(data, np.uint8)], bounds, width, _BYTE_BASE)


def cover(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """True at each of ``total`` positions that a window starting in ``starts`` covers."""
    marks = np.zeros(total + 1, np.int32)
    np.add.at(marks, starts, 1) if len(starts) < 1000 else marks.__iadd__(np.bincount(starts, minlength=total + 1).astype(np.int32))
    marks[width:] -= marks[: total + 1 - width].copy() if total + 1 > width else 0
    return np.cumsum(marks[:total]) > 0


def rolling(data: bytes, width: int) -> np.ndarray:
    """Hash of data[i:i+width) for every i, document edges not minded."""
    values = BYTE_VALUE[np.frombuffer(data, np.uint8)]
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = prefix(values, _BYTE_BASE)
    _, down = powers(_BYTE_BASE, len(values))
    return mix64((sums[width:] - sums[:-width]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
