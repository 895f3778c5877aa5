"""How much text goes to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of `rows` documents, unless the session asks for fewer: the default of 10,000 whole texts doesn't fit a worker."""
    if int(spark.conf.get(ROWS)) > rows:
        spark.conf.set(ROWS, str(rows))
