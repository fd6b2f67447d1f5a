"""From judged suggestions to the final, ranked result document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import content_hash, suggestion_id
from weftline.operators.exclude import not_linked_suggestions

#: Fixed values of the wire format.
CONNECTION_TYPES = ("elaborates", "analogous-mechanism", "contradicts", "instance-of", "generalizes", "mention")


def rank_suggestions(rows: DataFrame, links: DataFrame | None, query_note: str | Column, top_n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Suggestions (pos, file_id, heading_id, heading_text, confidence, ...) -> id and rank.

    Those that point at the query note or repeat a link of it go; of several for one target the most
    confident stays, the first of equals; order is confidence, then where the target was first seen; the first
    ``top_n`` are numbered s01, s02 ...  An empty id is no id: it names neither the query note nor another."""
    own = query_note if isinstance(query_note, Column) else F.lit(query_note)
    kept = rows.where(~(F.col("file_id").eqNullSafe(own) & ~own.eqNullSafe(F.lit(""))))
    if links is not None:
        kept = not_linked_suggestions(kept, links, by)
    # notes without ids are different notes
    note = F.when(F.col("file_id") == "", F.col("target.file")).otherwise(F.col("file_id")) if "target" in rows.columns else F.col("file_id")
    target = W.partitionBy(*by, note, "heading_text")
    kept = kept.withColumn("_first", F.min("pos").over(target)).withColumn("_rn", F.row_number().over(target.orderBy(F.desc("confidence"), "pos")))
    one = kept.where("_rn = 1").drop("_rn")
    order = [F.desc("confidence"), F.col("_first")]
    if not by:
        one = one.orderBy(*order).limit(top_n)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order))
    out = one.withColumn("rank", rank).where(F.col("rank") <= top_n)
    return out.withColumn("id", suggestion_id(F.col("rank"))).drop("_first")


def envelope(suggestions: DataFrame, title: str, note_id: str, buffer: str, queried_at: str) -> DataFrame:
    """One row: the versioned result document, suggestions in rank order (at most top_n of them)."""
    item = F.struct("rank", F.struct("id", "type", "confidence", "why", "target_excerpt", "target", "source_anchor").alias("s"))
    listed = suggestions.agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]).alias("suggestions"))
    source = F.struct(F.lit(title).alias("title"), F.lit(note_id).alias("id"), F.lit(queried_at).alias("queried_at"), content_hash(F.lit(buffer)).alias("content_hash"))
    return listed.select(F.lit(1).alias("version"), source.alias("source"), "suggestions")


def to_json(document: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON text, null fields kept."""
    return document.select(F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false"}).alias(name))
