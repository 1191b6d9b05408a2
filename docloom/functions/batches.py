"""Bounds on what Python workers are handed at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Text that a Python worker is handed at once, unless the session sets a bound.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches to Python workers by bytes: 10000 rows, Spark's bound, are of any size.

    A bound that the session has already is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)
