"""Operator 8, mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating; they share the sum of
all sizes by weight; a target stops at ``cap`` times its source's size and the excess is shared
again by weight until no target is above.

Taking: a source gives ``target`` words: every document as often as the target holds the source's
size, and once more the documents that come first in a seeded permutation, the last of them in
part, so the source meets its target to within a word.

Splitting: the permutation cuts a source into blocks of about ``block_words`` words, or of more where that
would make over ``MOST_BLOCKS`` of them, which is what the exact draws below can count.  What is taken of a source
is a number of block copies, the source's quota.  A binary tree over the output shards divides the vector of
quotas: at each node the left half gets a multivariate hypergeometric draw, so every shard gets an exact
quota of every source and the quotas add up.  A source's block copies are then dealt to the shards by
their number times a step without common factor with their count (a fixed permutation, so disjointly),
and a shard orders what it got by hash.  There are ``SHARDS`` shards, or one for each ``SHARD_WORDS`` words of all
sizes if that is more.

Texts stay where they are: sizes are counted in one pass and saved, what the driver sees is one row a
source (at most ``max_sources``, checked) and the tree's quotas, and taking is decided row by row from
the source's numbers.

Defined cases: null and blank texts have size 0 and are taken 0 times in words; null source is a source
of its own, ordered last; rows that agree in id, source and text share one place in the
permutation and share the partial take; an empty table gives an empty result; extra columns pass
through or, in the digest, play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import common

CAP, SEED, BLOCK_WORDS, SHARDS, SHARD_WORDS, MAX_SOURCES = 3, 17, 1 << 18, 32, 1 << 25, 100_000
#: Block copies of all sources together; the generator draws exactly below a thousand million.
MOST_BLOCKS = 1 << 28


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Share sum(sizes) by weight, no more than cap * size each."""
    total, open_ = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    left = total
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        above = [i for i in sorted(open_) if left * weights[i] / weight > cap * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(cap * sizes[i])
            open_.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def _draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """n of sum(counts) items without replacement, by kind; sums of a thousand million and more are refused."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        if n <= 0:
            break
        k = int(rng.hypergeometric(c, rest, n)) if c else 0
        out[i], n = k, n - k
    return out


def splitting_tree(counts: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """quotas[shard, source]: rows add up to counts; shards are equal to within a few blocks."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, np.array(counts, np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        middle = (low + high) // 2
        n = int(own.sum()) * (middle - low) // (high - low)
        left = _draw(np.random.default_rng([seed, low, high]), own, n)
        todo += [(low, middle, left), (middle, high, own - left)]
    return out


def _place(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "_id", "_source", "_text")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("_source"))
    return own.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), _size(F.col("_text")).alias("size"), _place(seed).alias("place"))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def _block(place: Column, blocks: Column) -> Column:
    """The permutation's block: equal ranges of the place, in its (signed) order."""
    return F.floor((place.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * blocks).cast("long")


class Plan:
    """What one source needs to decide a row: numbers only, one entry a source."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block_words: int, cap: float, weights: Sequence[float], max_sources: int):
        spark = docs.sparkSession
        self.rows = common.saved(_narrow(docs, id_col, text_col, source_col, seed))
        sums = self.rows.groupBy("source").agg(F.sum("size").alias("words")).limit(max_sources + 1).collect()
        if len(sums) > max_sources:
            raise ValueError(f"more than {max_sources} sources; raise max_sources")
        sums.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [int(r.words) for r in sums]
        self.sources = [r.source for r in sums]
        self.sizes, self.targets = sizes, targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], cap)
        take = [min(int(t + 0.5), int(cap * s)) for t, s in zip(self.targets, sizes, strict=True)]
        self.whole = [t // s if s else 0 for t, s in zip(take, sizes, strict=True)]
        self.rest = [t - q * s for t, q, s in zip(take, self.whole, sizes, strict=True)]
        self.total = sum(sizes)
        block_words = max(block_words, -(-int((cap + 1) * self.total) // MOST_BLOCKS))
        self.blocks = [max(1, -(-s // block_words)) for s in sizes]
        schema = "source string, words long, target double, whole int, rest long, blocks long"
        first = spark.createDataFrame(list(zip(self.sources, sizes, self.targets, self.whole, self.rest, self.blocks, strict=True)), schema)
        self.per_block = self._join(self.rows, first).withColumn("block", F.least(_block(F.col("place"), F.col("blocks")), F.col("blocks") - 1))
        cuts = self._cuts()
        self.cut_block = [cuts[i][0] if i in cuts else -1 for i in range(len(sums))]
        rows = [
            (s, i, n, t, q, b, cuts[i][1] if i in cuts else None, cuts[i][2] if i in cuts else 0)
            for i, (s, n, t, q, b) in enumerate(zip(self.sources, sizes, self.targets, self.whole, self.blocks, strict=True))
        ]
        self.table = spark.createDataFrame(rows, "source string, source_no int, source_size long, target double, whole int, blocks long, cut_place long, part long")

    @staticmethod
    def _join(rows: DataFrame, sources: DataFrame) -> DataFrame:
        """At most max_sources rows on the right: broadcast."""
        right = F.broadcast(sources.withColumnRenamed("source", "_s"))
        return rows.join(right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def _cuts(self) -> dict[int, tuple[int, int, int]]:
        """For each source with words left over: the block and the place of the last document
        taken once more, and how many of its words."""
        from pyspark.sql import Window as W

        number = {s: i for i, s in enumerate(self.sources)}
        blocks = self.per_block.where("rest > 0").groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = blocks.withColumn("before", before).where("before < rest and before + words >= rest")
        hit = hit.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("before"))
        # one block of each source from here on
        inside = self.per_block.join(F.broadcast(hit), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
        places = inside.groupBy("source", "block", "place").agg(F.sum("size").alias("words"), F.count("*").alias("ties"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        within = F.col("before") + F.coalesce(F.sum("words").over(W.partitionBy("source", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        last = places.withColumn("within", within).where("within < rest and within + words >= rest")
        return {number[r.source]: (r.block, r.place, (r.rest - r.within) // r.ties) for r in last.collect()}

    def shards(self, asked: int | None) -> int:
        return asked or max(SHARDS, -(-self.total // SHARD_WORDS))

    def copies(self) -> list[int]:
        """Block copies of each source: all blocks for a whole pass, those up to the cut for the last."""
        return [q * b + c + 1 for q, b, c in zip(self.whole, self.blocks, self.cut_block, strict=True)]

    def decided(self, docs_like: DataFrame) -> DataFrame:
        """Rows with source, size and place -> with whole (full takes), part (words of one more take),
        taken, block and the source's numbers."""
        out = self._join(docs_like, self.table)
        again = F.when(F.col("place") < F.col("cut_place"), F.col("size")).when(F.col("place") == F.col("cut_place"), F.least("size", "part")).otherwise(F.lit(0))
        out = out.withColumn("part", F.coalesce(again, F.lit(0)).cast("long"))
        out = out.withColumn("block", F.least(_block(F.col("place"), F.col("blocks")), F.col("blocks") - 1))
        return out.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def _shard_of(plan: Plan, shards: int, seed: int):
    """Column: the shards of a row's copies, by source number, block and copy."""
    counts = plan.copies()
    quotas = splitting_tree(counts, shards, seed)
    ends = np.cumsum(quotas, axis=0)
    step = []
    for n in counts:  # a bijection of 0..n-1: ordinal * step + shift modulo n
        a = max(1, int(n * 0.6180339887))
        while n > 1 and gcd(a, n) != 1:
            a += 1
        step.append(a)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def shard(number, block, copies, blocks):  # noqa: ANN001, ANN202
        import pandas as pd

        copies = copies.to_numpy(np.int64)
        edge = np.cumsum(copies) - copies
        who = np.repeat(number.to_numpy(np.int64), copies)
        copy = np.arange(int(copies.sum())) - np.repeat(edge, copies)
        ordinal = copy * np.repeat(blocks.to_numpy(np.int64), copies) + np.repeat(block.to_numpy(np.int64), copies)
        out = np.zeros(len(who), np.int32)
        for s in np.unique(who).tolist():
            at = who == s
            dealt = (ordinal[at] * step[s] + seed) % max(1, counts[s])
            out[at] = np.searchsorted(ends[:, s], dealt, side="right")
        return pd.Series([out[a : a + n].tolist() for a, n in zip(edge.tolist(), copies.tolist(), strict=True)])

    return shard(F.col("source_no"), F.col("block"), F.col("copies"), F.col("blocks"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = CAP,
    shards: int | None = None,
    seed: int = SEED,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shards (one for each copy)."""
    plan = Plan(docs, id_col, text_col, source_col, seed, block_words, cap, weights, max_sources)
    shards = plan.shards(shards)
    out = plan.decided(plan.rows).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + (F.col("part") > 0).cast("int")).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", "taken", _shard_of(plan, shards, seed).alias("shards"))


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = CAP,
    shards: int | None = None,
    seed: int = SEED,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str = "n_chars",
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy, the last of a source cut to its part of the
    words; a shard's rows lie together, in hash order.  Blank documents have no words to take."""
    plan = Plan(docs, id_col, text_col, source_col, seed, block_words, cap, weights, max_sources)
    shards = plan.shards(shards)
    columns = docs.columns
    row = docs.select(F.struct(*columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("_source"))
    row = row.select("_row", F.col("_source").alias("source"), _size(F.col("_text")).alias("size"), _place(seed).alias("place"))
    out = plan.decided(row).where("taken > 0").withColumn("copies", F.col("whole") + (F.col("part") > 0).cast("int"))
    out = out.select("_row", "place", "whole", "part", "size", F.posexplode(_shard_of(plan, shards, seed)).alias("copy", "shard"))
    cut = (F.col("copy") == F.col("whole")) & (F.col("part") < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(f"_row.{text_col}"), F.lit(common.WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    out = out.withColumn("_text", F.when(cut, head).otherwise(F.col(f"_row.{text_col}")))
    order = F.xxhash64(F.lit(seed), "shard", "copy", "place")
    out = out.withColumn("_order", order).repartition(shards, "shard").sortWithinPartitions("shard", "_order")
    changed = {text_col: F.col("_text"), **({chars_col: F.when(cut, F.length("_text")).otherwise(F.col(f"_row.{chars_col}")).cast(docs.schema[chars_col].dataType)} if chars_col in columns else {})}
    return out.select(*[changed.get(c, F.col(f"_row.{c}")).alias(c) for c in columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
