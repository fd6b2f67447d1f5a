"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result as Parquet beside the checkpoints and rereads it,
so no stage's lineage reaches into the one before.

* toxicity - documents that the machine predicts toxic go, all others stay unchanged;
* line dedup - of repeated and nearly repeated lines the first occurrence stays; documents stay, with
  what is left of their text;
* SimHash near-dedup - of each group of near-duplicates the document with the smallest id stays, rows
  without id last; of rows that share it, one;
* mixing - sources are brought to their target weights: documents repeat, drop out, or, once a source, are cut;
* tokens - every mixed document is encoded and decoded again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import byte_bpe, common, line_dedup, mixing, simhash_dedup, toxicity
from weftline.llm.components import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.documents_without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_texts(docs, with_ids=True, with_text=False).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: A factorization machine, SimHash links and seeded draws have no SQL: tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs


