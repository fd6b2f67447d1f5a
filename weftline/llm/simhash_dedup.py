"""Operator 4, SimHash near-dedup by covering locality-sensitive hashing.

Every bit position of the 64-bit fingerprint carries a vector of ``radius + 1`` bits; each nonzero
vector v gives a mask of the positions whose vector has odd inner product with v.  Two fingerprints that
differ in at most ``radius`` positions leave some v orthogonal to all the differing positions'
vectors, so their masked values agree under v: all 2**(radius+1) - 1 tables together miss no pair.

How it runs: fingerprints are computed text by text; identical ones collapse before anything else.
The distinct fingerprints go to every table; only keys with two or more members go on.  A key with
more than ``cell`` members is cut into parts, and every pair of parts is one cell, so no task sees
more than two parts.  A cell returns a spanning forest of its links, never all of its pairs.
Components follow from the forests, and each fingerprint's component id goes back to its documents.

Defined cases: null and blank texts have fingerprint zero and link like any other; a null id never
becomes a component id (a component of null ids only has none); repeated rows stay repeated; an
empty table gives an empty result; input columns other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.components import connected, ensure_checkpoint_dir
from weftline.llm.hashing import mix64

SHINGLE, RADIUS, SEED, CELL = 4, 4, 42, 2048
_BIT = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit set where over half of the shingles' XXH64 have it; 0 without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)  # digests are big-endian
    set_bits = bits.sum(axis=0, dtype=np.int64) * 2 > len(starts)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return common.keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _with_fingerprint(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, text_hash, text) -> (doc_id, text_hash, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, "doc_id long, text_hash string, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The tables' masks; positions get nonzero vectors in turn, in a fixed shuffled order."""
    n = (1 << (radius + 1)) - 1
    order = np.argsort(mix64(_BIT + np.uint64(1)), kind="stable")
    vector = np.empty(64, np.int64)
    vector[order] = np.arange(64) % n + 1
    return [sum(1 << i for i in range(64) if (int(vector[i]) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that joins values at most ``radius`` bits apart."""
    links, open_ = [], np.arange(len(values))
    while len(open_) > 1:
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            near = np.bitwise_count(values[open_] ^ values[at]) <= radius
            for x in open_[near].tolist():
                links.append((at, x))
                queue.append(x)
            open_ = open_[~near]
    return links


def _links_in_cells(radius: int):
    """Rows sorted by (t, k, i, j) -> links of each cell; a cell may span Arrow batches."""

    def solve(keys: np.ndarray, fps: np.ndarray) -> tuple[list[int], list[int]]:
        a, b = [], []
        edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        size = np.diff(np.r_[edge, len(fps)])
        two = edge[size == 2]
        close = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        a += fps[close].view(np.int64).tolist()
        b += fps[close + 1].view(np.int64).tolist()
        for start, n in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = fps[start : start + n]
            for x, y in spanning_links(own, radius):
                a.append(int(own[x].view(np.int64)))
                b.append(int(own[y].view(np.int64)))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            fps = batch.column(4).to_numpy().view(np.uint64)
            if held is not None:
                keys, fps = np.concatenate([held[0], keys]), np.concatenate([held[1], fps])
            last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys[0] != keys[-1]).any() else 0
            a, b = solve(keys[:last], fps[:last]) if last else ([], [])
            held = keys[last:], fps[last:]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if held is not None:
            a, b = solve(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def hamming_links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Distinct (fp) rows -> (a, b): for every pair within the radius, a path of returned links."""
    n = common.shuffle_partitions(fps.sparkSession)
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(covering_masks(radius))])
    keys = fps.select("fp", F.explode(masks).alias("m")).select("m.t", "m.k", "fp")
    shared = keys.groupBy("t", "k").agg(F.count("*").alias("members")).where("members > 1")
    found = keys.join(shared, ["t", "k"])
    parts = F.ceil(F.col("members") / cell).cast("int")
    found = found.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = found.select("t", "k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = cells.repartition(n, "t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return dealt.mapInArrow(_links_in_cells(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (smallest id reachable)."""
    ensure_checkpoint_dir(docs.sparkSession)
    all_fps = fingerprints(docs, id_col, text_col, shingle, seed).checkpoint()
    distinct = all_fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")).checkpoint()
    roots = connected(hamming_links(distinct.select("fp"), radius, cell))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(ids, "root").select("fp", "component_id")
    # fingerprints of hot groups repeat: the skewed side is the documents', the other is unique
    return all_fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """docs with one document of each component, columns unchanged.

    The document of the smallest id stays; of rows that share it, one with the smallest text.  A component
    of rows without ids keeps one row by the same order."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    columns = docs.columns
    own = docs.select(F.struct(*columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # what a group needs to know of a row: narrow, so no text moves for it
    narrow = own.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), "text")
    marked = _with_fingerprint(narrow, shingle, seed).checkpoint()
    distinct = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")).alias("first")).checkpoint()
    roots = connected(hamming_links(distinct.select("fp"), radius, cell))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    winners = labelled.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    hashed = own.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    winners = winners.withColumnRenamed("doc_id", "w_id").withColumnRenamed("text_hash", "w_hash")
    kept = hashed.join(winners, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")), "left_semi")
    # rows equal in id and text: one
    alone = kept.groupBy("doc_id", "text_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return alone.select("row.*")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
