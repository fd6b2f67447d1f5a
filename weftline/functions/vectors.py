"""Vector expressions and the default, repeatable embedding."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from time import sleep

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def dot(a: Column, b: Column) -> Column:
    """Sum of products in element order, in doubles."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; null for a vector of length zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


class Transient(Exception):
    """A failure worth another attempt: rate limits, timeouts, server errors."""


def with_retry(call: Callable[[], object], attempts: int, base_delay: float = 0.5, wait: Callable[[float], None] = sleep) -> object:
    """Attempts with delays of base, 2 base, 4 base ...; only transient failures are tried again."""
    for n in range(attempts):
        try:
            return call()
        except Transient:
            if n + 1 >= attempts:
                raise
            wait(base_delay * 2**n)
    raise ValueError("attempts must be at least 1")


def hashing_embedder(dim: int = 256) -> Embedder:
    """Signed word hashing to unit length: repeatable, offline, and enough to rank by shared words."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode("utf-8"))
                out[row, h % dim] += 1.0 if h >> 16 & 1 else -1.0
            size = math.sqrt(float((out[row] ** 2).sum()))
            if size:
                out[row] /= size
        return out.tolist()

    return embed


def embed_batched(texts: Sequence[str], embedder: Embedder, batch: int = 128, attempts: int = 4, wait: Callable[[float], None] = sleep) -> list[list[float]]:
    """Vectors in the order of the texts; no call for no texts; a batch that fails for a while is tried again."""
    out: list[list[float]] = []
    for at in range(0, len(texts), batch):
        part = list(texts[at : at + batch])
        got = with_retry(lambda part=part: embedder(part), attempts, wait=wait)
        if len(got) != len(part):  # type: ignore[arg-type]
            raise ValueError(f"{len(part)} texts gave {len(got)} vectors")  # type: ignore[arg-type]
        out += [[float(x) for x in v] for v in got]  # type: ignore[union-attr]
    return out


def embed_udf(make: Callable[[], Embedder], batch: int = 128, attempts: int = 4):  # noqa: ANN201
    """Text column -> vector column. ``make`` runs once in each Python worker, at its first batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = None
        for part in parts:
            if embedder is None:
                embedder = make()
            yield pd.Series(embed_batched(part.fillna("").tolist(), embedder, batch, attempts))

    return embed
