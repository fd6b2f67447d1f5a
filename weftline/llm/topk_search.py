"""Operator 2, exact top-k inner-product search: ball-tree branch and bound in every shard.

Vectors become integers, floor(scale * x).  Candidates are dealt into shards by hash; queries into
blocks; a task holds one shard and one block of queries.  It builds a ball tree over the shard and
descends it for all its queries together: a node's upper bound is q.c + |q| r, nodes below
the query's current kth score are cut, leaves are visited from the highest bound down, and each
visited leaf raises the kth score for those that follow.  Before any shard is searched, every query gets
a first kth score from a fixed candidate sample of bounded size, so all shards share a bound that is
already good.  Shards return k rows a query; a ranked window keeps the best k.

Ties go to the smaller id, so bounds equal to the kth score are still visited.  Arithmetic is exact:
float products while they stay under 2**53, Python integers beyond; components and scores beyond a
long's range count as its ends.

Defined cases: null ids, null vectors and vectors with null or non-finite components take no part;
rows with one id count once, as their smallest vector; vectors of other lengths than the query's are
no candidates for it; fewer than k candidates give fewer rows; an empty table gives an empty
result; extra columns play no part.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common

K, SCALE, EVERY = 5, 256, 50
SHARD_ROWS, QUERY_ROWS, SAMPLE, LEAF = 65_536, 16_384, 2048, 64
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class BallTree:
    """Nodes in level order; a node is a range of the permuted points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        ranges, self.children = [(0, len(points))], []
        at = 0
        while at < len(ranges):
            low, high = ranges[at]
            at += 1
            if high - low <= leaf:
                self.children.append((-1, -1))
                continue
            own = self.order[low:high]
            p = points[own]
            middle = p.mean(axis=0)
            a = p[np.argmax(((p - middle) ** 2).sum(axis=1))]
            b = p[np.argmax(((p - a) ** 2).sum(axis=1))]
            half = (high - low) // 2
            self.order[low:high] = own[np.argpartition(p @ (b - a), half)]
            self.children.append((len(ranges), len(ranges) + 1))
            ranges += [(low, low + half), (low + half, high)]
        self.ranges = np.array(ranges)
        self.children = np.array(self.children)
        self.centre = np.stack([points[self.order[a:b]].mean(axis=0) for a, b in ranges]) if len(points) else np.empty((0, points.shape[1]))
        self.radius = np.array([np.sqrt(((points[self.order[a:b]] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(ranges, self.centre, strict=True)])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T, floats where they are exact; what no long can hold is the nearest that one can."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min())) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    most = (1 << 63) - 1
    return np.clip(a.astype(object) @ b.astype(object).T, -most, most).astype(np.int64)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Best k of the shard for each query: (ids, scores), -1 ids where there are fewer.

    ``floor``: a score that k candidates of the query reach somewhere; lower ones are not wanted."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    n, low = len(queries), np.iinfo(np.int64).min
    best, who = np.full((n, k), low), np.full((n, k), -1)
    points, q = vectors.astype(np.float64), queries.astype(np.float64)
    tree, length = BallTree(points, leaf), np.sqrt((q**2).sum(axis=1))
    bound = q @ tree.centre.T + length[:, None] * tree.radius
    bound += 1e-9 * (np.abs(bound) + 1) + 1e-9 * length[:, None] * (np.sqrt((tree.centre**2).sum(axis=1)) + tree.radius)
    kth = floor.astype(np.float64)
    # descend level by level, cutting what cannot reach the kth score
    alive_q, alive_n = np.arange(n), np.zeros(n, np.int64)
    leaves_q, leaves_n = [], []
    while len(alive_q):
        keep = bound[alive_q, alive_n] >= kth[alive_q]
        alive_q, alive_n = alive_q[keep], alive_n[keep]
        end = tree.children[alive_n, 0] < 0
        leaves_q.append(alive_q[end])
        leaves_n.append(alive_n[end])
        alive_q, alive_n = np.tile(alive_q[~end], 2), tree.children[alive_n[~end]].T.ravel()
    lq, ln = np.concatenate(leaves_q), np.concatenate(leaves_n)
    by = np.lexsort((-bound[lq, ln], lq))
    lq, ln = lq[by], ln[by]
    first = np.searchsorted(lq, np.arange(n + 1))
    turn = np.arange(len(lq)) - first[lq]
    # each round visits every query's best leaf that is left
    by_turn = np.argsort(turn, kind="stable")
    cut = np.searchsorted(turn[by_turn], np.arange(int(turn.max(initial=-1)) + 2))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at = by_turn[a:b]
        at = at[bound[lq[at], ln[at]] >= kth[lq[at]]]
        if not len(at):
            break  # bounds only fall and kth scores only rise
        at = at[np.argsort(ln[at], kind="stable")]
        for lo, hi in common.segments(ln[at]):
            who_asks = lq[at[lo:hi]]
            x, y = tree.ranges[ln[at[lo]]]
            members = tree.order[x:y]
            score = _exact(queries[who_asks], vectors[members])
            score[ids[members][None, :] == query_ids[who_asks][:, None]] = low
            some = score.max(axis=1) >= np.maximum(best[who_asks, k - 1], low + 1)
            if not some.any():
                continue
            who_asks, score = who_asks[some], score[some]
            all_s = np.concatenate([best[who_asks], score], axis=1)
            all_i = np.concatenate([who[who_asks], np.broadcast_to(ids[members], score.shape)], axis=1)
            all_i = np.where(all_s == low, -1, all_i)
            top = np.lexsort((all_i, -all_s.astype(np.float64)), axis=-1) if np.abs(all_s[all_s > low]).max(initial=0) < 1 << 53 else np.lexsort((all_i, ~all_s), axis=-1)
            top = top[:, :k]
            best[who_asks], who[who_asks] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            kth[who_asks] = np.maximum(kth[who_asks], np.where(who[who_asks, k - 1] >= 0, best[who_asks, k - 1], -np.inf))
    return who, best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def integers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): usable vectors as whole numbers, one row an id."""
    fit = F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null").where(fit)
    return own.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = K,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    sample: int = SAMPLE,
    leaf: int = LEAF,
) -> DataFrame:
    """(vec_id, v) candidates and queries -> query_id, rank, vec_id, score.

    ``sample`` bounds the candidates behind the first kth scores; it changes speed, not results."""
    spark = candidates.sparkSession
    n, m = candidates.count(), queries.count()
    shards = max(common.shuffle_partitions(spark), -(-n // shard_rows))
    blocks = max(1, -(-m // query_rows))
    seeds = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # sample rows at most
    by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in {len(r.v) for r in seeds}:
        own = [r for r in seeds if len(r.v) == width]
        by_width[width] = (np.array([r.vec_id for r in own]), np.array([r.v for r in own], np.int64).reshape(len(own), width))

    def cell(key: tuple[Any, ...], shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not shard.num_rows or not asked.num_rows:
            return _FOUND.empty_table()
        ids, vectors = shard["vec_id"].to_numpy(), _matrix(shard["v"])
        query_ids, q = asked["vec_id"].to_numpy(), _matrix(asked["v"])
        floor = np.full(len(q), -np.inf)
        some_ids, some = by_width.get(q.shape[1], (np.empty(0, np.int64), np.empty((0, q.shape[1]), np.int64)))
        if len(some) > k:
            score = _exact(q, some).astype(np.float64)
            score[some_ids[None, :] == query_ids[:, None]] = -np.inf
            floor = np.partition(score, len(some) - k, axis=1)[:, len(some) - k]
        who, best = search(ids, vectors, query_ids, q, floor, k, leaf)
        real = who >= 0
        return pa.Table.from_arrays([pa.array(np.broadcast_to(query_ids[:, None], who.shape)[real]), pa.array(who[real]), pa.array(best[real])], schema=_FOUND)

    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    right = F.size("v").alias("width")
    left = candidates.select("vec_id", "v", right, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), every_block)
    asked = queries.select("vec_id", "v", right, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every_shard)
    cells = ["shard", "block", "width"]
    found = left.groupBy(*cells).cogroup(asked.groupBy(*cells)).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP2_SQL = """
WITH ok AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
