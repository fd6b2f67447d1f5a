"""What an editor does with a result document, as operators over suggestions and buffers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import assemble_link, fill_template


def confident(suggestions: DataFrame, least: int = 2) -> DataFrame:
    return suggestions.where(F.coalesce("confidence", F.lit(0)) >= least)


def with_link(suggestions: DataFrame) -> DataFrame:
    """Adds link and filled: the assembled link, and the template with it."""
    link = assemble_link(F.col("file_id"), F.col("heading_id"), F.col("heading_text"), F.col("link_description"))
    return suggestions.withColumn("link", link).withColumn("filled", fill_template(F.col("template"), F.col("link")))


def reanchor(suggestions: DataFrame) -> DataFrame:
    """Adds beg and end: where before + expect + after stands now, nearest to where it stood; null if
    nowhere.  Rows carry buffer, before, expect, after, char_start.  Of two equally near the later wins."""
    whole = F.concat(F.coalesce("before", F.lit("")), F.coalesce("expect", F.lit("")), F.coalesce("after", F.lit("")))
    lead = F.length(F.coalesce("before", F.lit("")))
    guess = F.greatest(F.lit(0), F.coalesce("char_start", F.lit(0)) - lead)
    rows = suggestions.withColumn("_whole", whole).withColumn("_lead", lead).withColumn("_guess", guess)
    # a split at the phrase leaves the gaps between its occurrences
    gaps = F.when(F.length("_whole") > 0, F.split("buffer", F.concat(F.lit("\\Q"), F.col("_whole"), F.lit("\\E")), -1))
    found = F.transform(gaps, lambda g, i: F.struct(i.alias("i"), F.length(g).alias("n")))
    starts = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"), F.lit(None).cast("int").alias("far")),
        lambda acc, g: F.struct(
            (acc["at"] + g["n"] + F.length("_whole")).alias("at"),
            F.when((g["i"] < F.size(gaps) - 1) & (acc["far"].isNull() | (F.abs(acc["at"] + g["n"] - F.col("_guess")) <= acc["far"])), acc["at"] + g["n"]).otherwise(acc["best"]).alias("best"),
            F.when((g["i"] < F.size(gaps) - 1) & (acc["far"].isNull() | (F.abs(acc["at"] + g["n"] - F.col("_guess")) <= acc["far"])), F.abs(acc["at"] + g["n"] - F.col("_guess"))).otherwise(acc["far"]).alias("far"),
        ),
        lambda acc: acc["best"],
    )
    rows = rows.withColumn("_at", starts)
    return rows.withColumn("beg", F.col("_at") + F.col("_lead")).withColumn("end", F.col("beg") + F.length(F.coalesce("expect", F.lit("")))).drop("_whole", "_lead", "_guess", "_at")


def overlapping_pairs(anchored: DataFrame, by: tuple[str, ...] = ("note",)) -> DataFrame:
    """(id, other) of ranges that overlap; half open, so touching ones do not, nor empty ones.

    Ranges meet in 256-character cells of their note, so the join is an equi-join."""
    cells = F.explode(F.sequence(F.floor(F.col("beg") / 256), F.floor(F.greatest(F.col("end") - 1, F.col("beg")) / 256)))
    a = anchored.where("end > beg").select(*by, "id", "beg", "end", cells.alias("_cell"))
    b = a.select(*by, F.col("id").alias("other"), F.col("beg").alias("_b"), F.col("end").alias("_e"), "_cell")
    return a.join(b, [*by, "_cell"]).where("id < other and beg < _e and _b < end").select(*by, "id", "other").distinct()


def keep_without_overlap(anchored: DataFrame, by: tuple[str, ...] = ("note",)) -> DataFrame:
    """Adds kept: greedy by confidence, then pos, a range goes if one that stays overlaps it.

    Each choice depends on those before it, so a note's ranges (at most top_n of them) go to one call."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchored.schema.fields)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values(["confidence", "pos"], ascending=[False, True], kind="stable")
        taken: list[tuple[int, int]] = []
        kept = {}
        for at, b, e in zip(order.index, order["beg"], order["end"], strict=True):
            free = pd.notna(b) and not any(b < y and x < e for x, y in taken)
            kept[at] = free
            if free:
                taken.append((b, e))
        return group.assign(kept=[kept[i] for i in group.index])

    return anchored.groupBy(*by).applyInPandas(choose, f"{fields}, kept boolean")


def group_inserts(inserts: DataFrame, by: tuple[str, ...] = ("note",)) -> DataFrame:
    """Inserts at one place as one text, in order, single spaces between and, where words would touch,
    around.  Rows carry buffer, beg, pos, filled."""
    listed = inserts.groupBy(*by, "beg").agg(F.first("buffer").alias("_buffer"), F.sort_array(F.collect_list(F.struct("pos", "filled"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["filled"]), " ")
    out = listed.withColumn("_text", text)
    left, right = F.substring("_buffer", F.col("beg"), F.lit(1)), F.substring("_buffer", F.col("beg") + 1, F.lit(1))
    word = r"^[^ \t\n]$"
    lead = F.when((F.col("beg") > 0) & left.rlike(word) & F.col("_text").rlike(r"^[^ \t\n]"), " ").otherwise("")
    trail = F.when(right.rlike(word) & F.col("_text").rlike(r"[^ \t\n]$"), " ").otherwise("")
    return out.select(*by, "beg", F.concat(lead, "_text", trail).alias("text"), F.size("_l").alias("n"))


def navigation_order(suggestions: DataFrame, order: str = "buffer") -> DataFrame:
    """Numbered for stepping through: by place in the buffer, or by confidence."""
    by = ["beg", "pos"] if order == "buffer" else [F.desc("confidence"), "beg", "pos"]
    return suggestions.withColumn("stop", F.row_number().over(W.partitionBy("note").orderBy(*by)))


def outcomes(suggestions: DataFrame, least: int = 2) -> DataFrame:
    """Rows with confidence, beg and kept -> how many were kept, unanchorable, overlapping or too weak."""
    outcome = (
        F.when(F.coalesce("confidence", F.lit(0)) < least, "low-confidence").when(F.col("beg").isNull(), "unanchorable").when(F.col("kept"), "kept").otherwise("overlap-discarded")
    )
    return suggestions.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def apply_edit(buffer: str, start: int, end: int, text: str) -> str:
    """The buffer with a region replaced; accepting a suggestion is this, rejecting is its inverse."""
    if not 0 <= start <= end <= len(buffer):
        raise ValueError("the region lies outside the buffer")
    return buffer[:start] + text + buffer[end:]


def apply_edits(rows: DataFrame) -> DataFrame:
    """Rows of (note, buffer, beg, end, filled), not overlapping -> the edited buffer of each note, every
    region replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for buffer, edits in zip(batch["buffer"], batch["edits"], strict=True):
                for e in sorted(edits, key=lambda e: (e["beg"], e["end"]), reverse=True):
                    buffer = apply_edit(buffer, e["beg"], e["end"], e["filled"])
                out.append(buffer)
            yield pd.DataFrame({"note": batch["note"], "buffer": out})

    listed = rows.groupBy("note").agg(F.first("buffer").alias("buffer"), F.collect_list(F.struct("beg", "end", "filled")).alias("edits"))
    return listed.mapInPandas(run, "note string, buffer string")
