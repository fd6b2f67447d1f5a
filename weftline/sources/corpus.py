"""Notes as tables: a directory of .org files, a buffer, or the driver's document table as org text."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that readers take for patterns in names, and their escape.
_PATTERN, _ESCAPED = re.compile(r"([][{}*?\\])"), r"\\\1"
#: Up to so many changed files are opened by name; beyond, the tree is scanned and joined.
NAMED_FILES = 50_000


def _scan(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.org").option("recursiveFileLookup", "true").load(root)


def _relative(path: Column, root: str) -> Column:
    """Path below the root; scans report absolute URIs."""
    tail = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.substring(path, F.instr(path, F.lit(f"/{tail}/")) + len(tail) + 2, F.length(path))


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every note, decoded as UTF-8."""
    return _scan(spark, root).select(_relative(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("text"))


def list_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) without reading contents; mtime in seconds."""
    when = F.unix_micros("modificationTime") / 1e6
    return _scan(spark, root).select(_relative(F.col("path"), root).alias("path"), when.alias("mtime"))


def read_named(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, text) of the given relative paths, opening only those files while they are few."""
    few = paths.select("path").limit(NAMED_FILES + 1).collect()
    if not few:
        return spark.createDataFrame([], "path string, text string")
    if len(few) > NAMED_FILES:
        return scan_corpus(spark, root).join(paths.select("path"), "path", "left_semi")
    names = [f"{root.rstrip('/')}/{_PATTERN.sub(_ESCAPED, r.path)}" for r in few]
    return spark.read.format("binaryFile").load(names).select(_relative(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("text"))


def buffer_source(spark: SparkSession, buffer: str | None = None, stream: TextIO | None = None, unix_newlines: bool = False) -> DataFrame:
    """One unsaved note as a row; from stdin unless a buffer is given.

    Offsets refer to the text as given; ``unix_newlines`` turns CRLF into LF first."""
    text = buffer if buffer is not None else (stream or sys.stdin).read()
    if unix_newlines:
        text = text.replace("\r\n", "\n")
    return spark.createDataFrame([("", text)], "path string, text string")


def org_view(docs: DataFrame, links_mod: int = 1000) -> DataFrame:
    """Documents as org notes: a drawer with an id, a title, every fifth line a heading, every tenth
    one level deeper, and a link at the end."""
    n = F.col("doc_id").cast("string")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 10 == 9, F.concat(F.lit("** "), x)).when(i % 5 == 4, F.concat(F.lit("* "), x)).otherwise(x))
    head = F.concat(F.lit(":PROPERTIES:\n:ID: doc-"), n, F.lit("\n:END:\n#+title: "), F.coalesce("lang", F.lit("")), F.lit(" "), n, F.lit("\n"))
    target = ((F.col("doc_id") * 7) % links_mod).cast("string")
    tail = F.concat(F.lit("\n[[id:doc-"), target, F.lit("]]"))
    return docs.select(F.concat(F.lit("notes/doc_"), n, F.lit(".org")).alias("path"), F.concat(head, F.array_join(lines, "\n"), tail).alias("text"))


def create_texts(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "path string, text string")
