"""Shared pieces of the corpus operators: table access, word splitting, packed blocks.

Packed blocks
-------------
Several operators need every position of every text, and positions outnumber documents by
three orders of magnitude, so one Spark row per position would be mostly overhead.  They work on
*blocks* instead: one Arrow pass cuts each input partition into blocks of a few megabytes and
writes, through one exchange,

* ``kind 0`` rows - the block itself (texts, compressed), keyed by block;
* ``kind 1`` rows - the block's part of a global key space (hashes, words), keyed by bucket.

Buckets are merged on their own; what a block has to learn goes back keyed by block, and the
block is finished beside its answers.  Both consumers read the same exchange, so the first pass
runs once.  A block repeats a key once at most, so a key that a third of all rows share costs one
entry a block and no more.
"""

from __future__ import annotations

import ctypes
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters end words; nothing else does.
WORD = r"[^\x20\x09-\x0D]+"
PACKED = "kind int, key long, src long, payload binary"
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str, rest: list[str] | None = None) -> DataFrame:
    """The two columns an operator needs, under names of its own: extra columns cannot clash.

    ``rest`` names columns that travel along unchanged, in one struct."""
    own = [column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")]
    if rest:
        own.append(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"))
    return docs.select(*own)


def zip_bytes(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unzip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays to bytes: byte planes, compressed, so that slowly changing high bytes cost nothing."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T if len(a) else np.empty((a.dtype.itemsize, 0), np.uint8)
        parts = [zip_bytes(np.ascontiguousarray(p).tobytes()) if len(a) else b"" for p in planes]
        out.append(struct.pack("<3sq", a.dtype.str[1:].encode().ljust(3), len(a)) + struct.pack(f"<{len(parts)}q", *map(len, parts)))
        out += parts
    return b"".join(out)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    return unpack_arrays_at(data)[:-1]


def unpack_arrays_at(data: bytes) -> list:
    """The arrays, and where in data they end."""
    (n,), at, out = struct.unpack_from("<B", data), 1, []
    for _ in range(n):
        code, size = struct.unpack_from("<3sq", data, at)
        kind = np.dtype(code.decode().strip())
        at += 11
        lengths = struct.unpack_from(f"<{kind.itemsize}q", data, at)
        at += 8 * kind.itemsize
        planes = np.empty((kind.itemsize, size), np.uint8)
        for i, length in enumerate(lengths):
            if size:
                planes[i] = np.frombuffer(unzip_bytes(data[at : at + length]), np.uint8)
            at += length
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
    return [*out, at]


class Block:
    """Documents of one block, ascending by doc_id (null ids last) and text, as one UTF-8 buffer.

    ``rest`` is what travels along with each document, as an Arrow array."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, offsets: np.ndarray, data: bytes, rest: pa.Array | None = None):
        self.ids, self.known, self.offsets, self.data, self.rest = ids, known, offsets, data, rest

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]], rest: pa.Array | None = None) -> Block:
        order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
        rows = [rows[k] for k in order]
        return cls(
            np.array([r[0] or 0 for r in rows], np.int64),
            np.array([r[0] is not None for r in rows], bool),
            np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int64),
            b"".join(r[1] for r in rows),
            None if rest is None else rest.take(pa.array(order, pa.int64())),
        )

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)]

    def id_list(self) -> list[int | None]:
        return [i if k else None for i, k in zip(self.ids.tolist(), self.known.tolist(), strict=True)]

    def pack(self) -> bytes:
        head = pack_arrays(self.ids, self.known.view(np.uint8), self.offsets)
        rest = b""
        if self.rest is not None:
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([self.rest], names=["rest"])
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            rest = zip_bytes(sink.getvalue().to_pybytes())
        return struct.pack("<qq", len(head), len(rest)) + head + rest + zip_bytes(self.data, 2)

    @classmethod
    def unpack(cls, payload: bytes) -> Block:
        n, m = struct.unpack_from("<qq", payload)
        ids, known, offsets = unpack_arrays(payload[16 : 16 + n])
        rest = None
        if m:
            rest = pa.ipc.open_stream(unzip_bytes(payload[16 + n : 16 + n + m])).read_all().column(0).combine_chunks()
        return cls(ids, known.view(bool), offsets, unzip_bytes(payload[16 + n + m :]), rest)


def blocks_of(batches: Iterable[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """(block key, block) of a partition's (doc_id, text) batches; the key holds partition and ordinal."""
    from pyspark import TaskContext

    base, seq = TaskContext.get().partitionId() << 24, 0
    rows: list[tuple[int | None, bytes]] = []
    rest: list[pa.Array] = []
    size = 0

    def cut() -> Block:
        return Block.of(rows, pa.concat_arrays(rest) if rest else None)

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
        begin = 0
        for k, (i, text) in enumerate(zip(ids, texts, strict=True)):
            rows.append((i, text or b""))
            size += len(text or b"")
            if size >= block_bytes or len(rows) >= BLOCK_DOCS:
                if batch.num_columns > 2:
                    rest.append(batch.column(2).slice(begin, k + 1 - begin))
                yield base | seq, cut()
                rows, rest, size, seq, begin = [], [], 0, seq + 1, k + 1
        if batch.num_columns > 2 and begin < batch.num_rows:
            rest.append(batch.column(2).slice(begin))
    if rows:
        yield base | seq, cut()


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def saved(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared checkpoint folder and read again: what follows does not compute
    it anew, and a lost executor costs no more than what it was about."""
    from weftline.llm.components import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kind, key, src, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(src, pa.int64()), pa.array(payload, pa.binary())],
        names=["kind", "key", "src", "payload"],
    )


def packed_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([packed(rows)])


def pass_one(texts: DataFrame, emit: Callable[[int, Block], Iterator[list[tuple[int, int, int, bytes]]]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One exchange with what ``emit(key, block)`` yields for every block of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in blocks_of(batches, block_bytes):
            for rows in emit(key, block):
                yield packed(rows)
        release()

    n = shuffle_partitions(texts.sparkSession)
    return texts.mapInArrow(run, PACKED).repartition(n, "kind", "key")


def merge_buckets(rows: DataFrame, merge: Callable[[int, list[tuple[int, bytes]]], list[tuple[int, int, int, bytes]]], kind: int = 1) -> DataFrame:
    """``merge(bucket, [(src, payload)])`` for every bucket, other kinds passed over."""

    def run(key: tuple[Any, ...], group: pa.Table) -> pa.Table:
        if key[0].as_py() != kind:
            return packed_table([])
        return packed_table(merge(key[1].as_py(), list(zip(group["src"].to_pylist(), group["payload"].to_pylist(), strict=True))))

    return rows.groupBy("kind", "key").applyInArrow(run, PACKED)


def finish_blocks(rows: DataFrame, answers: DataFrame, finish: Callable[[int, bytes, list[tuple[int, bytes]]], pa.Table], schema: pa.Schema, spark_schema: str) -> DataFrame:
    """``finish(block key, payload, [(src, answer)])`` for every block."""

    def run(key: tuple[Any, ...], group: pa.Table, answer: pa.Table) -> pa.Table:
        if key[0].as_py() != 0 or not group.num_rows:
            return schema.empty_table()
        got = list(zip(answer["src"].to_pylist(), answer["payload"].to_pylist(), strict=True))
        out = finish(key[1].as_py(), group["payload"][0].as_py(), got)
        release()
        return out

    return rows.groupBy("kind", "key").cogroup(answers.groupBy("kind", "key")).applyInArrow(run, spark_schema)


def segments(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each stretch of equal neighbours."""
    if not len(keys[0]):
        return []
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    edge = np.flatnonzero(new)
    return list(zip(edge.tolist(), [*edge[1:].tolist(), len(new)], strict=True))


def split_by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes -> (bucket numbers present, bounds); buckets are equal ranges of the hash."""
    where = bucket_of(hashes, buckets)
    starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.empty(0, np.int64)
    return where[starts], np.r_[starts, len(where)]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack_sorted(hashes: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted hashes as differences, with arrays beside them."""
    return pack_arrays(np.diff(hashes, prepend=np.uint64(0)), *others)


def unpack_sorted(data: bytes) -> list[np.ndarray]:
    first, *others = unpack_arrays(data)
    return [np.cumsum(first, dtype=np.uint64), *others]


WORD_RE = re.compile(WORD)
