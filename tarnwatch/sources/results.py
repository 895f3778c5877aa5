"""Write-once results under the key of their inputs."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarnwatch.sources.files import delete_folder
from tarnwatch.sources.publish import publish, published


def result_key(inputs: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


@dataclass(frozen=True)
class StoredResult:
    key: str
    reused: bool
    data: DataFrame


def write_once(spark: SparkSession, folder: str, inputs: Mapping[str, object], compute: Callable[[], DataFrame]) -> StoredResult:
    """Compute and store, or read back what an identical run stored.

    Each run writes to a folder of its own, and the first to finish makes its folder the result by one marker. A run that died
    half-way left no marker; of two at once, the later one reads the result of the earlier.
    """
    key = result_key(inputs)
    home = f"{folder.rstrip('/')}/key={key}"

    def stored() -> str | None:
        found = published(spark, f"{home}/marker")
        return f"{home}/{found[0][1]}" if found else None

    if path := stored():
        return StoredResult(key, True, spark.read.parquet(path))
    run = f"run-{uuid.uuid4().hex}"
    compute().write.parquet(f"{home}/{run}")
    if publish(spark, f"{home}/marker/result", run):
        return StoredResult(key, False, spark.read.parquet(f"{home}/{run}"))
    delete_folder(spark, f"{home}/{run}")
    return StoredResult(key, True, spark.read.parquet(stored()))
