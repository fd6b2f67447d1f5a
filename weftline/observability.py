"""Logging to stderr, spans as Spark job groups, and small debug views."""

from __future__ import annotations

import logging
import sys
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.judge import json_part

NAME = "weftline"
_span: ContextVar[tuple[str, str] | None] = ContextVar("span", default=None)


def logger(debug: bool = False) -> logging.Logger:
    """The package's logger, on stderr so that stdout stays pure JSON; repeated calls add nothing."""
    log = logging.getLogger(NAME)
    if not any(getattr(h, "_weftline", False) for h in log.handlers):
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        handler._weftline = True  # type: ignore[attr-defined]
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(logging.DEBUG if debug else logging.WARNING)
    return log


class Tracer:
    """Spans: jobs started inside one carry its trace id and name in the UI and the event log."""

    def __init__(self, spark: SparkSession | None = None, enabled: bool = True):
        self.spark, self.enabled = spark, enabled
        self.finished: list[dict] = []

    def span(self, name: str, **attributes: object):  # noqa: ANN201
        return self._open(name, attributes) if self.enabled else nullcontext({})

    @contextmanager
    def _open(self, name: str, attributes: dict) -> Iterator[dict]:
        parent = _span.get()
        trace = parent[0] if parent else uuid.uuid4().hex
        record = {"trace": trace, "name": name, "parent": parent[1] if parent else None, **attributes}
        token, start = _span.set((trace, name)), time.perf_counter()
        if self.spark is not None:
            self.spark.sparkContext.setJobGroup(trace, name)
        try:
            yield record
        finally:
            record["elapsed_s"] = time.perf_counter() - start
            self.finished.append(record)
            _span.reset(token)
            if self.spark is not None and parent:
                self.spark.sparkContext.setJobGroup(*parent)


def retrieval_documents(candidates: DataFrame) -> DataFrame:
    """(id, text, score) of retrieved chunks, best first, for debugging."""
    return candidates.select(F.col("tgt").alias("id"), F.col("tgt_text").alias("text"), F.col("sim").alias("score")).orderBy(F.desc("score"), "id")


def judge_cost(asked: DataFrame) -> DataFrame:
    """What ``judge.ask`` returns -> returned verdicts, seconds and failure of each group; no answer returns none."""
    returned = F.coalesce(F.json_array_length(F.get_json_object(json_part(F.col("answer")), "$.suggestions")), F.lit(0))
    return asked.groupBy("tgt_note").agg(F.sum(returned).alias("n_returned"), F.sum("elapsed_s").alias("elapsed_s"), F.max(F.col("error").isNotNull().cast("int")).alias("failed"))
