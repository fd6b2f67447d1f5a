"""Operator 1, substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in
Spark; repeated windows merge into maximal removal intervals.

A window is ``window`` consecutive words of one document.  Every word is removed that lies in a
window whose word sequence also starts in a document with a smaller id.  Windows are judged on the
input, so removals do not influence each other.

How it runs: each block hashes every window (a rolling polynomial hash over word hashes, 64 bits, and
24 more of a second one), keeps one entry for each distinct window with its smallest document, and deals the entries out by
hash range.  A bucket looks for windows that several blocks hold and tells each block but the
earliest holder; the block marks those windows and the ones repeated inside itself, and merges
them into maximal intervals.  What moves is one entry per distinct window and block: about 10 bytes
for each window of the corpus.

Different windows of several blocks get equal hashes with a chance of n**2 / 2**89 for n distinct windows
(less than one in a corpus of 100 TB), those of one block of 4 MB with n**2 / 2**65.

Defined cases: null text counts as empty; a row with null id keeps everything and causes no
removal; rows with equal ids do not remove from each other; documents shorter than a window are
kept whole; an empty table gives an empty result; input columns other than id and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import common, hashing
from weftline.llm.common import Block

WINDOW, CHECK_BITS = 50, 24
_CHECK_BASE = 0xA0761D6478BD642F
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64()), ("kept_text", pa.string())])
_OUT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, kept_text string"


def _windows(block: Block, width: int) -> tuple[np.ndarray, ...]:
    """Words, window starts, window hashes, the document ordinal of each window, and the words' hashes."""
    starts, ends, first = hashing.words(block.data, block.offsets)
    values = hashing.word_hashes(block.data, starts, ends)
    at, hashes = hashing.windows(values, first, width)
    owner = np.searchsorted(first, at, side="right") - 1
    return starts, ends, first, at, hashes, owner, values


def first_holders(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes ascending, smallest document ordinal of each, each window's distinct hash)."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.empty(0, bool)
    which = np.empty(len(hashes), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], owner[order[new]], which


def checks(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Further bits of each window, by a hash of its own."""
    _, hashes = hashing.windows(values, first, width, _CHECK_BASE)
    return (hashes >> np.uint64(64 - CHECK_BITS)).astype(np.uint32)


def _emit(width: int, buckets: int):
    def emit(key: int, block: Block) -> Iterator[list[tuple[int, int, int, bytes]]]:
        yield [(0, key, 0, block.pack())]
        _, _, first, _, hashes, owner, values = _windows(block, width)
        valid = block.known[owner]
        hashes, owner = hashes[valid], owner[valid]
        distinct, holder, which = first_holders(hashes, owner)
        check = np.empty(len(distinct), np.uint32)
        check[which] = checks(values, first, width)[valid]
        del hashes, owner, which, values
        where, bounds = common.split_by_bucket(distinct, buckets)
        rows = []
        for i, bucket in enumerate(where.tolist()):
            part = slice(bounds[i], bounds[i + 1])
            held, local = np.unique(holder[part], return_inverse=True)
            rows.append((1, bucket, key, common.pack_sorted(distinct[part], local.astype(np.uint16), block.ids[held], check[part])))
        if rows:
            yield rows

    return emit


def _merge(bucket: int, parts: list[tuple[int, bytes]]) -> list[tuple[int, int, int, bytes]]:
    """Tell each block which of its windows start in a smaller document elsewhere."""
    if len(parts) < 2:
        return []
    hashes, docs, src, more = [], [], [], []
    for key, payload in parts:
        h, local, ids, check = common.unpack_sorted(payload)
        more.append(check)
        hashes.append(h)
        docs.append(ids[local])
        src.append(np.full(len(h), key, np.int64))
    h, doc, block = np.concatenate(hashes), np.concatenate(docs), np.concatenate(src)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = ranked[1:] == ranked[:-1]
    shared = order[np.r_[False, same] | np.r_[same, False]]
    if not len(shared):
        return []
    h, doc, block, check = h[shared], doc[shared], block[shared], np.concatenate(more)[shared]
    apart = (h[1:] == h[:-1]) & (check[1:] != check[:-1])
    if apart.any():  # one hash, several windows
        order = np.lexsort((check, h))
        h, doc, block, check = h[order], doc[order], block[order], check[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
    least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.r_[start, len(h)]))
    late = doc > least
    h, block = h[late], block[late]
    order = np.argsort(block, kind="stable")
    h, block = h[order], block[order]
    return [(0, int(block[a]), bucket, common.pack_sorted(h[a:b])) for a, b in common.segments(block)]


def _finish(width: int, with_text: bool):
    def finish(key: int, payload: bytes, answers: list[tuple[int, bytes]]) -> pa.Table:
        block = Block.unpack(payload)
        starts, ends, first, at, hashes, owner, _ = _windows(block, width)
        valid = block.known[owner]
        at, hashes, owner = at[valid], hashes[valid], owner[valid]
        distinct, holder, which = first_holders(hashes, owner)
        seen = np.zeros(len(distinct), bool)
        for _, answer in answers:
            (told,) = common.unpack_sorted(answer)
            seen[np.searchsorted(distinct, told)] = True
        late = seen[which] | (block.ids[owner] > block.ids[holder[which]])
        gone = hashing.cover(at[late], width, len(starts))
        kept = ~gone
        removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), first[:-1]) * (np.diff(first) > 0) if len(block) else np.empty(0, np.int64)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = first[:-1][np.diff(first) > 0]
        opens[inner] = gone[inner]
        spans = np.add.reduceat(np.r_[opens, False].astype(np.int64), first[:-1]) * (np.diff(first) > 0)
        digests, texts = [], []
        for text, a, b in zip(block.texts(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            words = text.split()
            left = b" ".join(words if not removed[len(digests)] else [w for w, k in zip(words, kept[a:b].tolist(), strict=True) if k])
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                texts.append(left.decode("utf-8", "replace"))
        return pa.Table.from_arrays(
            [pa.array(block.id_list(), pa.int64()), pa.array(np.diff(first)), pa.array(removed), pa.array(digests), pa.array(spans), pa.array(texts if with_text else [None] * len(block), pa.string())],
            schema=_OUT,
        )

    return finish


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_spans, kept_text.

    ``with_text=False`` leaves kept_text null.  ``buckets`` sets the number of hash ranges
    (default: two for each shuffle partition)."""
    n = buckets or 2 * common.shuffle_partitions(docs.sparkSession)
    rows = common.pass_one(common.keyed_texts(docs, id_col, text_col), _emit(window, n))
    return common.finish_blocks(rows, common.merge_buckets(rows, _merge), _finish(window, with_text), _OUT, _OUT_SQL)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(common.table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
