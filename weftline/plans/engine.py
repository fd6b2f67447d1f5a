"""Index and query: the two entry points, from corpus to index and from buffer to result document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions.vectors import Embedder, embed_udf, hashing_embedder
from weftline.observability import Tracer
from weftline.operators import exclude, finalize, judge, retrieve
from weftline.operators.chunk import chunk_notes, without_drawers
from weftline.operators.parse import parse, parse_notes
from weftline.operators.refresh import refresh, utc_now
from weftline.sources.corpus import buffer_source
from weftline.sources.store import Snapshot, Store


def retrieve_candidates(sources: DataFrame, snapshot_chunks: DataFrame, links: DataFrame, settings: Settings) -> DataFrame:
    """Query chunks (src, src_note, v) against the index: selected candidates with their targets' columns.

    The k nearest come first, without regard to links; what is already linked drops out after the ranking."""
    # a note without an id is a note of its own, named by its path
    own = F.when(F.col("note_uuid") != "", F.col("note_uuid")).otherwise(F.concat(F.lit("file:"), F.col("note_path")))
    side = snapshot_chunks.withColumnRenamed("embedding", "v").withColumn("own", own)
    hits = retrieve.knn(sources, side.select(F.col("chunk_id").alias("tgt"), F.col("own").alias("tgt_note"), "v"), settings.top_k)
    about = side.select(
        F.col("chunk_id").alias("tgt"),
        F.col("own").alias("tgt_note"),
        F.col("note_uuid").alias("tgt_uuid"),
        F.col("note_path").alias("tgt_path"),
        F.col("note_title").alias("tgt_title"),
        F.col("heading_path").alias("tgt_crumbs"),
        F.col("text").alias("tgt_text"),
        F.col("heading_id").alias("tgt_heading_id"),
        F.col("heading_index").alias("tgt_heading_index"),
        F.col("heading_text").alias("tgt_heading_text"),
        F.col("heading_level").alias("tgt_heading_level"),
        "neighbour",
    )
    rich = hits.join(about, "tgt")
    open_ = exclude.not_linked_chunks(rich, links)
    return retrieve.select_candidates(open_, settings.sim_floor, settings.per_source_n, settings.global_cap_m)


class Engine:
    """One session, one index; embedder and judge are made where they run."""

    def __init__(self, spark: SparkSession, settings: Settings, make_embedder: Callable[[], Embedder] | None = None, make_judge: Callable[[], judge.Judge] | None = None, tracer: Tracer | None = None):
        self.spark, self.settings = spark, settings
        self.make_embedder = make_embedder or (lambda dim=settings.embedding_dim: hashing_embedder(dim))
        self.make_judge = make_judge
        self.tracer = tracer or Tracer(enabled=False)
        self._store: Store | None = None

    @property
    def store(self) -> Store:
        if self._store is None:
            self._store = Store(self.spark, self.settings.index_dir)
        return self._store

    def refresh(self, rebuild: bool = False, progress: Callable[[int, int, str], None] | None = None) -> dict[str, int]:
        with self.tracer.span("refresh", rebuild=rebuild):
            return refresh(self.spark, self.settings, self.store, self.make_embedder, rebuild, progress)

    def candidates(self, buffer: str, snapshot: Snapshot | None = None) -> DataFrame:
        """Selected candidates for a buffer; no rows for a buffer without prose."""
        notes = parse_notes(buffer_source(self.spark, buffer))
        embed = embed_udf(self.make_embedder, self.settings.embed_batch, self.settings.embed_attempts)
        own = chunk_notes(notes, self.settings).withColumn("v", embed(F.col("embed_text")))
        sources = own.select(F.col("ordinal").cast("int").alias("src"), F.col("note_uuid").alias("src_note"), "v")
        chunks = judge.with_neighbour((snapshot or self.store.snapshot()).chunks)
        links = notes.select(F.explode("links").alias("l")).select("l.*")
        return retrieve_candidates(sources, chunks, links, self.settings)

    def suggest(self, buffer: str) -> DataFrame:
        """One row: the result document for a buffer.  A pure query: the index is not refreshed."""
        if not self.settings.corpus_dir:
            raise ValueError("no corpus folder: set corpus_dir")
        if self.make_judge is None:
            raise ValueError("no judge: give make_judge")
        settings, note = self.settings, parse(buffer)
        with self.tracer.span("suggest", note=note["note_id"]):
            with self.tracer.span("retrieval"):
                found = self.candidates(buffer).persist()
                found.count()
            with self.tracer.span("judge"):
                grouped = judge.group_candidates(found)
                asked = judge.ask(judge.prompts(grouped), self.make_judge, without_drawers(buffer), settings.judge_attempts, settings.judge_workers).persist()
                verdicts = judge.valid_verdicts(asked.where("error is null"))
                rows = judge.suggestions(verdicts, grouped, buffer, settings)
            links = self.spark.createDataFrame([(x["target_uuid"], x["search_string"]) for x in note["links"]], "target_uuid string, search_string string")
            final = finalize.rank_suggestions(rows, links, note["note_id"], settings.top_n)
            return finalize.envelope(final, note["title"], note["note_id"], buffer, utc_now())
