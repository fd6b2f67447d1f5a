"""Operator 3, byte-level BPE encoding and decoding through a global distinct-word shuffle.

Encoding: texts fall into pre-tokens with positions; each distinct pre-token of the corpus is
encoded once, in the bucket its hash names; its ids go back to the blocks that hold it and the
texts are reassembled by position.  Decoding joins the ids with the token-byte table.

A block keeps one entry for each distinct word, so common words cost an entry a block.  No
token of the default pattern ever reaches over the start of a white-space run, so a text cut before its
single spaces can be split piece by piece; the pattern runs on each block's distinct pieces, and on the
whole text where white space comes in other forms or the pattern is another.

The vocabulary is read once on the driver and broadcast: it has a fixed size (50,256 entries for
the default file).

Defined cases: null text encodes as empty (no ids, digests of the empty string); null and
repeated ids stay as they are; bytes that are not UTF-8 read as the replacement character; an empty
table gives an empty result; input columns other than id and text play no part.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.common import Block

VOCABULARY = "byte_bpe_50k.tiktoken"
_POSITIONS = 1 << 16  # pieces that are put together at once
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_OUT_SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
_cache: dict = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class _Vocabulary:
    """Per process: the word encoder, the token-byte table, and the ids in decimal."""

    def __init__(self, raw: bytes):
        import tiktoken

        ranks = _ranks(raw)
        # the pre-token is given, so the pattern takes all of it
        self.encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.starts = np.cumsum([0, *map(len, table)], dtype=np.int64)
        self.decimal = [str(i) for i in range(len(table))]


def _vocabulary(raw: bytes) -> _Vocabulary:
    key = hashlib.sha256(raw).digest()
    if key not in _cache:
        _cache[key] = _Vocabulary(raw)
    return _cache[key]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each span, one span after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def _pieces(block: Block, findall, by_space: bool) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """(piece code of every position, bounds by document, pre-tokens of each piece).

    ``by_space``: the pattern allows texts to be cut before single spaces; else each text is one piece."""
    inner: defaultdict[str, int] = defaultdict(itertools.count().__next__)  # after a space
    whole: dict[str, int] = {}  # as it stands
    codes: list[np.ndarray] = []
    texts = [t.decode("utf-8", "replace") for t in block.texts()]
    for text in texts:
        if not by_space:
            codes.append(np.array([~whole.setdefault(text, len(whole))]))
            continue
        first, *rest = text.split(" ")
        own = np.empty(len(rest) + 1, np.int64)
        own[0] = ~whole.setdefault(first, len(whole))
        own[1:] = list(map(inner.__getitem__, rest))
        codes.append(own)
    plain = np.fromiter((bool(w) and not w[-1].isspace() for w in inner), bool, len(inner))
    opening = np.fromiter((bool(w) and not w[-1].isspace() for w in whole), bool, len(whole))
    for k, own in enumerate(codes):
        if len(own) > 1 and not (opening[~own[0]] and plain[own[1:]].all()):
            codes[k] = np.array([~whole.setdefault(texts[k], len(whole))])
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
    used, flat = np.unique(flat, return_inverse=True)
    outer, within = list(whole), list(inner)
    del inner, whole, codes, texts
    parts = [findall(outer[~c]) if c < 0 else findall(" " + within[c]) for c in used.tolist()]
    return flat, np.r_[0, np.cumsum(sizes)], parts


def _emit(pattern: str, buckets: int):
    def emit(key: int, block: Block) -> Iterator[list[tuple[int, int, int, bytes]]]:
        import regex

        compiled = regex.compile(pattern)  # the module keeps it
        findall = compiled.findall if not compiled.groups else lambda text: [m[0] for m in compiled.finditer(text)]
        flat, bounds, parts = _pieces(block, findall, pattern == public_tokenizers.PATTERN)
        # frequent pieces get small codes, which compress well
        order = np.argsort(-np.bincount(flat, minlength=len(parts)), kind="stable")
        rank = np.empty(len(parts), np.int64)
        rank[order] = np.arange(len(parts))
        parts = [parts[i] for i in order.tolist()]
        words: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        tokens = np.fromiter((words[t] for p in parts for t in p), np.int64)
        raw = [w.encode() for w in words]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
        by_bucket = np.argsort(bucket, kind="stable")
        place = np.empty(len(raw), np.int64)
        place[by_bucket] = np.arange(len(raw))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        yield [(0, key, 0, common.pack_arrays(block.ids, block.known.view(np.uint8), bounds, rank[flat].astype(np.uint32), lengths.astype(np.uint32), place[tokens].astype(np.uint32)))]
        ranked = bucket[by_bucket]
        rows = []
        for a, b in common.segments(ranked):
            rows.append((1, int(ranked[a]), key, _pack_words([raw[i] for i in by_bucket[a:b].tolist()])))
        if rows:
            yield rows

    return emit


def _pack_words(words: list[bytes]) -> bytes:
    head = common.pack_arrays(np.fromiter(map(len, words), np.uint32, len(words)))
    return struct.pack("<q", len(head)) + head + common.zip_bytes(b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", data)
    (lengths,) = common.unpack_arrays(data[8 : 8 + n])
    text, ends = common.unzip_bytes(data[8 + n :]), np.cumsum(lengths, dtype=np.int64)
    return [text[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def _merge(vocabulary):
    def merge(bucket: int, parts: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bytes]]:
        encode = _vocabulary(vocabulary.value).encode
        at: dict[bytes, int] = {}
        wanted = [(block, np.array([at.setdefault(w, len(at)) for w in _unpack_words(payload)], np.int64)) for block, payload in parts]
        ids = [encode(w.decode()) for w in at]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        out = [(0, block, bucket, common.pack_arrays(lengths[w].astype(np.uint32), flat[ragged(starts[w], lengths[w])])) for block, w in wanted]
        del at, ids, wanted
        common.release()
        return out

    return merge


def _finish(vocabulary, with_ids: bool, with_text: bool):
    def finish(key: int, payload: bytes, answers: list[tuple[int, bytes]]) -> pa.Table:
        vocab = _vocabulary(vocabulary.value)
        ids, known, bounds, codes, lengths, words = common.unpack_arrays(payload)
        known = known.view(bool)
        got = [common.unpack_arrays(a) for _, a in sorted(answers)]
        word_len = np.concatenate([np.empty(0, np.uint32), *(g[0] for g in got)]).astype(np.int64)
        word_ids = np.concatenate([np.empty(0, np.uint32), *(g[1] for g in got)])
        word_at = np.cumsum(word_len) - word_len
        # a piece's ids: those of its words, one after the other
        words, lengths = words.astype(np.int64), lengths.astype(np.int64)
        piece_ids = word_ids[ragged(word_at[words], word_len[words])]
        ends = np.r_[0, np.cumsum(word_len[words])]
        last = np.cumsum(lengths)
        piece_at, piece_end = ends[last - lengths], ends[last]
        own_len, token_len = piece_end - piece_at, np.diff(vocab.starts)
        counts, listed, id_sha, text_sha, texts = [], [], [], [], []
        # some documents at a time: the arrays of places are many times their text
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _POSITIONS, side="right")) - 1)
            code = codes[bounds[at] : bounds[to]].astype(np.int64)
            piece_len = own_len[code]
            tokens = piece_ids[ragged(piece_at[code], piece_len)].astype(np.int64)
            edge = np.r_[0, np.cumsum(piece_len)][bounds[at : to + 1] - bounds[at]]
            size = token_len[tokens]
            data = vocab.bytes[ragged(vocab.starts[tokens], size)].tobytes()
            cut, edges = np.r_[0, np.cumsum(size)][edge].tolist(), edge.tolist()
            for k in range(to - at):
                own = data[cut[k] : cut[k + 1]]
                id_sha.append(hashlib.sha256(" ".join([vocab.decimal[i] for i in tokens[edges[k] : edges[k + 1]].tolist()]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own).hexdigest())
                if with_text:
                    texts.append(own.decode("utf-8", "replace"))
            counts.append(np.diff(edge))
            if with_ids:
                listed.append(tokens.astype(np.int32))
            at = to
        n_tokens = np.concatenate([np.empty(0, np.int64), *counts])
        nothing = pa.nulls(len(ids))
        return pa.Table.from_arrays(
            [
                pa.array([i if n else None for i, n in zip(ids.tolist(), known.tolist(), strict=True)], pa.int64()),
                pa.array(n_tokens, pa.int64()),
                pa.array(id_sha, pa.string()),
                pa.array(text_sha, pa.string()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_tokens)], pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *listed]))) if with_ids else nothing.cast(_OUT.field("ids").type),
                pa.array(texts, pa.string()) if with_text else nothing.cast(pa.string()),
            ],
            schema=_OUT,
        )

    return finish


def encode_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    pattern: str | None = None,
    with_ids: bool = True,
    with_text: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded.

    ``with_ids`` and ``with_text`` choose whether the ids and the decoded text come along."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_ranks(vocabulary_path or public_tokenizers.path(VOCABULARY)))
    n = buckets or 2 * common.shuffle_partitions(spark)
    rows = common.pass_one(common.keyed_texts(docs, id_col, text_col), _emit(pattern or public_tokenizers.PATTERN, n))
    return common.finish_blocks(rows, common.merge_buckets(rows, _merge(vocabulary)), _finish(vocabulary, with_ids, with_text), _OUT, _OUT_SQL)


def token_table(spark: SparkSession, vocabulary_path: str | None = None) -> DataFrame:
    """(token_id, token) rows of a rank file."""
    ranks = _ranks(read_ranks(vocabulary_path or public_tokenizers.path(VOCABULARY)))
    return spark.createDataFrame([(i, bytearray(t)) for t, i in ranks.items()], "token_id int, token binary")


def decode_ids(encoded: DataFrame, table: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", table_limit: int = 1_000_000) -> DataFrame:
    """(id, decoded) by joining exploded ids with the token-byte table.

    The table is broadcast after its size is checked against ``table_limit`` rows, and shuffled
    otherwise.  An id that the table lacks decodes to nothing; null or empty ids give empty text."""
    side = F.broadcast(table) if table.limit(table_limit + 1).count() <= table_limit else table
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    flat = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "token_id")).join(side, "token_id", "left")
    byte = F.coalesce(F.hex("token"), F.lit(""))
    parts = flat.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", byte.alias("h")))).alias("p"))
    return parts.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8").alias("decoded"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(common.table(spark, sf_dir, "documents"), with_ids=False, with_text=False).drop("ids", "decoded")


