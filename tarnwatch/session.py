"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job of this package relies on. Sizes (shuffle partitions,
# memory, cores) belong to the cluster and are left to it.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Call sites of every column expression are not worth a round trip each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# What a query has shuffled goes when it ends. Else it stays on disk until the driver happens to collect its garbage.
SPENT_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
FIRST_PARTS = 200           # of a large join, before Spark merges small ones; more would be sorted, and spilled, where they are written
# Files are not packed into parts of 128 MB; no part has more rows than a file.
FILE_BY_FILE = {"spark.sql.files.openCostInBytes": str(1 << 40)}


def build_session(app_name: str = "tarnwatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def large_join(spark: SparkSession) -> dict[str, str]:
    """Settings for a join of large tables: sorts nothing if the other table's parts can be hashed, splits a hot key even if what follows
    has to be shuffled again, and starts with many parts, which Spark merges to half its usual size, so that what follows need not spill."""
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    given = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(first, None) or 0))
    return {
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
        first: str(max(FIRST_PARTS, given)),
    }


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can read, as the cluster names it; else one in the warehouse, which executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@contextmanager
def settings(spark: SparkSession, added: Mapping[str, str]) -> Iterator[None]:
    """Settings for the queries begun inside; afterwards the session has its own again."""
    known = spark.conf.getAll
    before = {k: known.get(k) for k in added}
    try:
        for k, v in added.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
