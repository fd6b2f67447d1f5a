"""Fixtures of the corpus operators' tests."""

from __future__ import annotations

import hashlib
import random


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def corpus(n: int = 60, seed: int = 0) -> list[tuple[int | None, str | None]]:
    """Random texts with shared passages, exact and near copies, nulls and empty texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = say(70)
    rows: list[tuple[int | None, str | None]] = []
    for i in range(n):
        text: str | None = say(rng.randint(0, 200)) + rng.choice(["", "\n", " \t\x0b"]) + say(rng.randint(0, 90))
        if i % 5 == 1:
            text = f"{text} {passage}\n{say(20)}"
        if i % 7 == 3 and rows:
            text = rng.choice(rows)[1]
        if i % 11 == 5:
            text = "\xa0" + (text or "") + "\n" + (text or "")
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[2][1]), (2, rows[2][1]), (n + 3, rows[2][1])]
    rng.shuffle(rows)
    return rows
