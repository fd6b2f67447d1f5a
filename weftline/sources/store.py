"""The index: chunks with vectors, and the manifest, as Parquet in hash buckets with versions.

A write touches the buckets of the notes it changes and no others: their new contents go to a new version's
folder, and one small append to the commit log makes the version current.  Readers resolve the log once and
keep reading the files it named, so a refresh never changes a result under way.  Everything goes through
Spark's readers and writers; any storage they reach will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.vectors import norm
from weftline.operators.chunk import CHUNK_SCHEMA

CHUNKS = CHUNK_SCHEMA.replace(", embed_text string", "") + ", embedding array<float>, norm double"
MANIFEST = "path string, uuid string, content_hash string, last_indexed_mtime double"
_SCHEMAS, _KEYS = {"chunks": CHUNKS, "manifest": MANIFEST}, {"chunks": "note_path", "manifest": "path"}
_LOG = "version long, table string, bucket int, data_version long"


class Snapshot:
    """The tables as of one version."""

    def __init__(self, store: Store, version: int, files: dict[str, dict[int, int]]):
        self.store, self.version, self.files = store, version, files

    def read(self, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        spark, root = self.store.spark, f"{self.store.root}/{table}"
        own = [f"{root}/v={v}/bucket={b}" for b, v in sorted(self.files.get(table, {}).items()) if v >= 0 and (buckets is None or b in buckets)]
        if not own:
            return spark.createDataFrame([], _SCHEMAS[table])
        return spark.read.schema(_SCHEMAS[table]).parquet(*own)

    @property
    def chunks(self) -> DataFrame:
        return self.read("chunks").withColumn("chunk_id", F.concat_ws(":", "note_path", "ordinal"))

    @property
    def manifest(self) -> DataFrame:
        return self.read("manifest")

    def get_chunk(self, note: str, heading_index: int, chunk_in_heading: int) -> DataFrame:
        """The chunk at a place in a note, or no row."""
        return self.chunks.where((F.col("note_uuid") == note) & (F.col("heading_index") == heading_index) & (F.col("chunk_in_heading") == chunk_in_heading))

    def get_manifest(self, path: str) -> DataFrame:
        return self.manifest.where(F.col("path") == path)

    def manifest_paths(self) -> DataFrame:
        return self.manifest.select("path")

    def counts(self) -> DataFrame:
        """notes, chunks, last_refresh (newest indexed time)."""
        chunks = self.chunks.agg(F.count("*").alias("chunks")).first()[0]
        return self.manifest.agg(F.count("*").alias("notes"), F.lit(chunks).alias("chunks"), F.max("last_indexed_mtime").alias("last_refresh"))


class Store:
    """Opens, and creates, an index folder."""

    def __init__(self, spark: SparkSession, index_dir: str | None, buckets: int = 16):
        if not index_dir:
            raise ValueError("no index folder: set index_dir, or corpus_dir to put it beside the notes")
        self.spark, self.root, self.buckets = spark, index_dir.rstrip("/"), buckets

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.root}/commits")
        except AnalysisException:
            return self.spark.createDataFrame([], _LOG)

    def snapshot(self) -> Snapshot:
        """The newest committed version; a bucket's files are those of its latest write."""
        log = self._log()
        newest = log.groupBy("table", "bucket").agg(F.max_by("data_version", "version").alias("v"), F.max("version").alias("version")).collect()  # tables x buckets rows
        files: dict[str, dict[int, int]] = {}
        for r in newest:
            files.setdefault(r.table, {})[r.bucket] = r.v
        return Snapshot(self, max((r.version for r in newest), default=0), files)

    def _bucket(self, table: str):  # noqa: ANN202
        return F.pmod(F.xxhash64(_KEYS[table]), F.lit(self.buckets)).cast("int")

    def commit(self, changes: dict[str, tuple[DataFrame, DataFrame | None]]) -> Snapshot:
        """Atomically replace rows: table -> (keys whose rows go, rows that come or None)."""
        now = self.snapshot()
        version, entries = now.version + 1, []
        for table, (keys, rows) in changes.items():
            key = _KEYS[table]
            gone = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
            touched = gone.select(self._bucket(table).alias("b"))
            if rows is not None:
                rows = rows.select(*[c.split()[0] for c in _SCHEMAS[table].split(", ")])
                touched = touched.unionByName(rows.select(self._bucket(table).alias("b")))
            hit = sorted(r.b for r in touched.distinct().collect())  # at most the number of buckets
            if not hit:
                continue
            kept = now.read(table, hit).join(gone, key, "left_anti")
            new = kept if rows is None else kept.unionByName(rows)
            at = f"{self.root}/{table}/v={version}"
            placed = new.withColumn("bucket", self._bucket(table)).repartition(len(hit), "bucket")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(at)
            full = {r.bucket for r in self.spark.read.parquet(at).select("bucket").distinct().collect()} if self._any(at) else set()
            entries += [(version, table, b, version if b in full else -1) for b in hit]
        if entries:
            self.spark.createDataFrame(entries, _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return self.snapshot()

    def _any(self, at: str) -> bool:
        try:
            return bool(self.spark.read.parquet(at).head(1))
        except AnalysisException:
            return False

    # -- the narrow operations

    def upsert_chunks(self, chunks: DataFrame) -> Snapshot:
        """Chunks with embeddings replace those of their notes; no rows: nothing happens; a chunk without a
        vector is refused."""
        if chunks.where("embedding is null").head(1):
            raise ValueError("a chunk has no embedding")
        rows = chunks.withColumn("norm", norm(F.col("embedding")))
        return self.commit({"chunks": (rows.select("note_path"), rows)})

    def delete_notes(self, paths: DataFrame) -> Snapshot:
        """Chunks and manifest rows of the paths go; unknown paths are fine."""
        return self.commit({"chunks": (paths, None), "manifest": (paths, None)})

    def upsert_manifest(self, rows: DataFrame) -> Snapshot:
        latest = rows.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("last_indexed_mtime")))).where("_n = 1").drop("_n")
        return self.commit({"manifest": (latest.select("path"), latest)})
