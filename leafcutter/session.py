"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Set small Arrow batches, and let Python workers import this package from where the driver did.

    On a cluster the package is installed or sent with ``--py-files``; this adds the
    driver's folder for local sessions that were started elsewhere.
    """
    # texts travel to Python workers in small batches
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, *paths) if p)
    return spark
