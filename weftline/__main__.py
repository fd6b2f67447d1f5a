"""python -m weftline: index, suggest and serve with the models that the settings name."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from weftline.config import Settings
from weftline.plans.engine import Engine
from weftline.plans.service import main
from weftline.sources import models


def engine(spark: SparkSession, settings: Settings) -> Engine:
    return Engine(spark, settings, lambda: models.embedder(settings), lambda: models.judge(settings))


if __name__ == "__main__":
    session = SparkSession.builder.appName("weftline").getOrCreate()
    sys.exit(main(sys.argv[1:], session, engine))
