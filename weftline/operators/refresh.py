"""Incremental refresh: a hash-confirmed diff of the corpus against the manifest.

The listing joins the manifest without contents; only new and touched files are read; only those whose hash
changed are parsed, cut and embedded; one commit replaces their rows and drops those of deleted files.  Rows
are keyed by path, so a renamed note keeps its chunks, and notes without an id do not displace each
other."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions.text import content_hash
from weftline.functions.vectors import Embedder, embed_udf, hashing_embedder, norm
from weftline.operators.chunk import chunk_notes
from weftline.operators.parse import parse_notes
from weftline.sources import corpus
from weftline.sources.store import Store


def classify(listing: DataFrame, manifest: DataFrame, rebuild: bool = False) -> DataFrame:
    """(path, mtime) against (path, uuid, content_hash, last_indexed_mtime): adds state new, touched or
    untouched.  A rebuild touches all."""
    known = manifest.select("path", F.col("uuid").alias("old_uuid"), F.col("content_hash").alias("old_hash"), "last_indexed_mtime", F.lit(True).alias("_known"))
    joined = listing.join(known, "path", "left")
    state = F.when(F.col("_known").isNull(), "new").when(F.lit(rebuild) | (F.col("mtime") > F.col("last_indexed_mtime")), "touched").otherwise("untouched")
    return joined.withColumn("state", state).drop("_known")


def confirm(classified: DataFrame, texts: DataFrame, rebuild: bool = False) -> DataFrame:
    """Touched rows with their texts' hashes: action index, reindex or skip, and watermark where only the
    time moved."""
    read = classified.where("state <> 'untouched'").join(texts.select("path", content_hash(F.col("text")).alias("content_hash")), "path", "left")
    quiet = classified.where("state = 'untouched'").withColumn("content_hash", F.col("old_hash"))
    same = (F.col("state") == "touched") & F.col("content_hash").eqNullSafe(F.col("old_hash")) & F.lit(not rebuild)
    action = F.when(F.col("state") == "new", "index").when((F.col("state") == "untouched") | same, "skip").otherwise("reindex")
    return read.unionByName(quiet).withColumn("action", action).withColumn("watermark", same)


def deletions(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose path is gone."""
    return manifest.join(listing.select("path"), "path", "left_anti")


def orphaned_uuids(gone: DataFrame, live: DataFrame) -> DataFrame:
    """Ids of deleted paths that no live note claims: a rename is no deletion."""
    return gone.select("uuid").distinct().join(live.select("uuid").distinct(), "uuid", "left_anti")


def stats(confirmed: DataFrame, deleted: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: indexed, reindexed, skipped, deleted, chunks."""
    counts = confirmed.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("index", "indexed"), ("reindex", "reindexed"), ("skip", "skipped"))])
    return counts.join(deleted.agg(F.count("*").alias("deleted"))).join(chunks.agg(F.count("*").alias("chunks")))


def refresh(
    spark: SparkSession,
    settings: Settings,
    store: Store,
    make_embedder: Callable[[], Embedder] | None = None,
    rebuild: bool = False,
    progress: Callable[[int, int, str], None] | None = None,
) -> dict[str, int]:
    """Bring the index up to date; returns the counters.  ``progress`` hears of each step, not of data."""
    if not settings.corpus_dir:
        raise ValueError("no corpus folder: set corpus_dir")
    steps = 4

    def tell(n: int, what: str) -> None:
        if progress:
            progress(n, steps, what)

    make = make_embedder or (lambda dim=settings.embedding_dim: hashing_embedder(dim))
    now = store.snapshot()
    listing = corpus.list_corpus(spark, settings.corpus_dir).cache()
    manifest = now.manifest
    classified = classify(listing, manifest, rebuild).cache()
    tell(1, "listed")
    texts = corpus.read_named(spark, settings.corpus_dir, classified.where("state <> 'untouched'")).cache()
    confirmed = confirm(classified, texts, rebuild).cache()
    changed = confirmed.where("action <> 'skip'")
    notes = parse_notes(texts.join(changed.select("path"), "path", "left_semi"))
    tell(2, "parsed")
    embed = embed_udf(make, settings.embed_batch, settings.embed_attempts)
    chunks = chunk_notes(notes, settings).withColumn("embedding", embed(F.col("embed_text"))).withColumn("norm", norm(F.col("embedding"))).cache()
    tell(3, "embedded")
    gone = deletions(listing, manifest).cache()
    ids = notes.select("path", F.col("note_id").alias("uuid"))
    rows = changed.join(ids, "path").select("path", "uuid", "content_hash", F.col("mtime").alias("last_indexed_mtime"))
    moved = confirmed.where("watermark").select("path", F.col("old_uuid").alias("uuid"), "content_hash", F.col("mtime").alias("last_indexed_mtime"))
    written = rows.unionByName(moved).cache()
    out = stats(confirmed, gone, chunks).first().asDict()
    replaced = changed.select("path").unionByName(gone.select("path"))
    store.commit({"chunks": (replaced, chunks), "manifest": (written.select("path").unionByName(gone.select("path")), written)})
    tell(4, "committed")
    for df in (listing, classified, texts, confirmed, chunks, gone, written):
        df.unpersist()
    return {k: int(v) for k, v in out.items()}


def utc_now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
