"""Operator 7, toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words and their leading 4 to 6 letters, hashed into ``BINS`` bins.
The machine adds, to a weight for each bin, an interaction for every pair of bins (the inner
product of two short vectors), so that two terms together can mean what neither means alone.

The fit uses a bounded sample: at most ``max_rows`` labelled rows, those with the smallest hash of
their id.  Executors count the bins of the sample and reduce its rows to the bins that tell the classes
apart (likelihood ratio, one in a thousand by chance; the best ``max_terms`` of them if that is given);
the driver fits those short rows.  Scoring is
one pass over all texts with no shuffle.

Defined cases: null and empty texts score the machine's constant; rows with null id score like
others and are never held out; labels that are null are not used, repeated labels of an id count
once as their maximum, and repeated documents of an id once in the sample, with their least text; without labels, or with one class only, the score is the smoothed base
rate; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import common

BINS, MAX_ROWS, FACTORS, FOLDS, PARTS = 1 << 18, 20_000, 4, 5, 16
_EDGE = ".,;:!?|#*$%&<>()[]{}\"'`~_=+-/\\"


def word_bins(word: str) -> list[int]:
    word = word.strip(_EDGE)
    if not word:
        return []
    raw = [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n)]
    return [zlib.crc32(t.encode("utf-8", "replace")) % BINS for t in raw]


@dataclass
class Machine:
    """Constant, and for each of the sorted ``bins`` a weight and a vector."""

    constant: float
    bins: np.ndarray
    weight: np.ndarray
    vector: np.ndarray


class _Terms:
    """Word -> kept positions, remembered for as many words as a bound allows."""

    def __init__(self, bins: np.ndarray | None, limit: int = 100_000):
        self.at = None if bins is None else {int(b): i for i, b in enumerate(bins)}
        self.memory: dict[str, tuple[int, ...]] = {}
        self.limit = limit

    def of(self, text: str) -> list[int]:
        out: set[int] = set()
        memory = self.memory
        for word in set(text.lower().split()):
            got = memory.get(word)
            if got is None:
                found = word_bins(word)
                got = tuple(found if self.at is None else [self.at[b] for b in found if b in self.at])
                if len(memory) < self.limit:
                    memory[word] = got
            out.update(got)
        return sorted(out)


def _texts(column: pa.Array) -> Iterator[str]:
    for raw in column.cast(pa.large_binary()):
        yield (raw.as_py() or b"").decode("utf-8", "replace")


def _ratio(n: np.ndarray, a: np.ndarray, rows: int, positive: int) -> np.ndarray:
    """Log likelihood ratio of a term's rows falling into the classes as they do."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    p = positive / rows
    return 2 * (part(a, n * p) + part(n - a, n * (1 - p)) + part(positive - a, (rows - n) * p) + part(rows - n - positive + a, (rows - n) * (1 - p)))


def _train(rows: list[list[int]], labels: np.ndarray, terms: int, factors: int, updates: int = 400, passes: int = 40, batch: int = 1024, rate: float = 0.1, penalty: float = 1e-5, positive: float = 3.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss with positive rows weighing ``positive`` (they are few), Adam over batches in a fixed shuffled
    order, its rate falling to nothing; at least ``updates`` updates and ``passes`` passes; repeatable."""
    rng = np.random.default_rng(7)
    base = float(np.log(labels.mean() / (1 - labels.mean())))
    params = [np.array([base]), np.zeros(terms), rng.normal(0, 0.01, (terms, factors))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    parts = []
    for own in np.array_split(rng.permutation(len(rows)), max(1, -(-len(rows) // batch))):
        held = [rows[k] for k in own.tolist()]
        col = np.fromiter((c for r in held for c in r), np.int64)
        y = labels[own]
        weigh = np.where(y > 0, positive, 1.0)
        parts.append((col, np.repeat(np.arange(len(own)), [len(r) for r in held]), y, weigh / weigh.sum()))

    def gather(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(row, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)

    total_steps, step = max(passes, -(-updates // len(parts))) * len(parts), 0
    while step < total_steps:
        for k in rng.permutation(len(parts)).tolist():
            col, row, y, weigh = parts[k]
            step += 1
            c, w, v = params
            own, n = v[col], len(y)
            total = gather(row, own, n)
            z = c[0] + np.bincount(row, weights=w[col], minlength=n) + 0.5 * (total**2 - gather(row, own**2, n)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weigh
            e = error[row]
            pull = e[:, None] * (total[row] - own)
            grads = [np.array([error.sum()]), np.bincount(col, weights=e, minlength=terms) + penalty * w / len(rows) ** 0.5, gather(col, pull, terms) + penalty * v]
            now = rate * (1 - (step - 1) / total_steps)
            for i, g in enumerate(grads):
                m, s = moments[i]
                m = 0.9 * m + 0.1 * g
                s = 0.999 * s + 0.001 * g * g
                moments[i] = (m, s)
                params[i] = params[i] - now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    """crc32 of the id as text modulo ``folds`` is 0; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_terms: int | None = None, factors: int = FACTORS, folds: int = FOLDS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows that are not held out."""
    texts = common.keyed_texts(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out("doc_id", folds)).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # of bounded size, so it may be broadcast
    # one scan finds the sample's texts; both passes over them read the small table it leaves
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = common.saved(found.select("text", "y").repartition(PARTS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(None)
        n = np.zeros((2, BINS), np.int32)
        size = np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                n[int(y > 0), terms.of(text)] += 1
                size[int(y > 0)] += 1
        if size.any():
            seen = np.flatnonzero(n.sum(axis=0) > 0)
            yield pa.RecordBatch.from_pydict({"part": pa.array([common.pack_arrays(size, seen, n[0, seen], n[1, seen])], pa.binary())})

    counts, size = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
    for part in rows.coalesce(PARTS).mapInArrow(count, "part binary").toLocalIterator():  # PARTS parts of BINS counts at most
        s, seen, a, b = common.unpack_arrays(bytes(part[0]))
        size += s
        counts[0, seen] += a
        counts[1, seen] += b
    nothing = np.empty(0, np.int64)
    if not size.all():
        rate = (size[1] + 0.5) / (size.sum() + 1)
        return Machine(float(np.log(rate / (1 - rate))), nothing, np.empty(0), np.empty((0, factors)))
    n = counts.sum(axis=0)
    score = np.where(n >= 3, _ratio(n, counts[1], int(size.sum()), int(size[1])), 0)
    best = np.argsort(-score, kind="stable")[:max_terms]
    bins = np.sort(best[score[best] > 10.8])  # one in a thousand by chance

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(bins)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([terms.of(t) for t in _texts(batch.column(0))], pa.list_(pa.int32())), batch.column(1)], names=["terms", "y"])

    short = rows.mapInArrow(reduce, "terms array<int>, y int").orderBy("terms", "y").toPandas()  # max_rows rows at most
    constant, weight, vector = _train([list(t) for t in short["terms"]], (short["y"].to_numpy() > 0).astype(float), len(bins), factors)
    return Machine(constant, bins, weight, vector)


def _scores(machine: Machine):
    """Texts -> their scores."""
    terms = _Terms(machine.bins)

    def run(texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for k, text in enumerate(_texts(texts)):
            own = terms.of(text)
            v = machine.vector[own]
            z = machine.constant + machine.weight[own].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
            out[k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    return run


def score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs, and ``score_col`` (0 to 1) beside them, in place of a column of that name; the text
    column alone is read for it."""
    rest = [f for f in docs.schema.fields if f.name != score_col]
    at, text_at = [docs.columns.index(f.name) for f in rest], docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold any characters
    names = [f"c{i}" for i in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(machine)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(scores(batch.column(text_at)))], names=[*names, "score"])
        common.release()

    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, rest, strict=True)), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*(f.name for f in rest), score_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    machine = fit(docs, labels, id_col, text_col)
    scored = score(common.keyed_texts(docs, id_col, text_col), machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, columns unchanged."""
    machine = fit(docs, labels, id_col, text_col)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(machine)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text_at)) < 0.5))
        common.release()

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold any characters
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
