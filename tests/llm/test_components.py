from __future__ import annotations

import random

import pytest

from weftline.llm.components import connected, ensure_checkpoint_dir


def test_chains_stars_loops_and_nulls(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    ring = [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in [*chain, *star, *ring]]
    rng.shuffle(links)
    links += [(5, 5), (3000, 3000), (None, 4), (4, None), (7, 8), (7, 8)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(401)} | {1000 + i: 1000 for i in range(300)} | {2000 + i: 2000 for i in range(50)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_shared_folder_is_asked_for_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
