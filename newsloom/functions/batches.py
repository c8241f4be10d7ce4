"""Sizes of the Arrow batches that pass between the JVM and Python."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch between the JVM and Python, and rows where texts are short.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most BATCH_ROWS rows and about BATCH_BYTES."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        number = int(re.sub(r"\D", "", now)) if now and not now.startswith("-") and re.fullmatch(r"\d+b?", now) else 0
        if not 0 < number <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
