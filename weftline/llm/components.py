"""Connected components of a link table, by alternating large-star and small-star rounds.

Links stay distributed; each round is two shuffles of the remaining links, and the lineage is cut
through the shared checkpoint folder.  The driver sees two counters a round and nothing else.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a local session that names none gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not (context.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "weftline-checkpoints"))


def connected(links: DataFrame) -> DataFrame:
    """(a, b) links over one ordered key type -> (node, root): root is the least node reachable.

    Nodes without a link do not appear.  Loops, repeated links and either direction are fine; null
    ends are ignored."""
    spark = links.sparkSession
    ensure_checkpoint_dir(spark)
    kind = links.schema[0].dataType
    ends = links.select(F.col(links.columns[0]).alias("a"), F.col(links.columns[1]).alias("b")).where("a <> b")
    # child > parent throughout
    edges = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:  # each round shrinks a component's depth; one that changes nothing is the last
        # large star: neighbours above a node point at the least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("n"), F.col("u").alias("w")).join(least.withColumnRenamed("u", "n"), "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node's parents, and the node itself, point at the least parent
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = small.where("u <> v").distinct().checkpoint()
        count = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast(T.DecimalType(38, 0))).alias("s")).first()
        if (count.n, count.s) == before:
            break
        before = (count.n, count.s)
    pairs = edges.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root")).distinct()
