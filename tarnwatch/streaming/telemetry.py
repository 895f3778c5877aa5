"""Streaming rollups: windows close when the watermark passes, late rows are counted beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwatch.operators.telemetry import rollup

# State goes to local disk, one store for all that a join keeps. The default keeps every row that a join waits with on the heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def hourly_rollup(events: DataFrame, at: str, latency: str, failed: Column, watermark: str = "24 hours") -> DataFrame:
    return rollup(events, at, latency, failed, "1 hour", watermark=watermark)


def daily_windows(events: DataFrame, at: str, watermark: str = "24 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """Non-overlapping UTC days, final once the grace period is over."""
    counts = events.withWatermark(at, watermark).groupBy(F.window(at, "1 day").alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("day"), *by, "n")


def late_counts(events: DataFrame, at: str, arrived: str, grace_hours: int = 24) -> DataFrame:
    """Late rows per arrival day. The watermark of this query follows arrival time, so none of them is dropped."""
    late = F.unix_micros(arrived) - F.unix_micros(F.window(at, "1 day")["end"]) > grace_hours * 3_600_000_000
    return (
        events.withColumn("is_late", late).withWatermark(arrived, "1 hour")
        .groupBy(F.window(arrived, "1 day").alias("w")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_late")).alias("late"))
        .select(F.col("w.start").alias("arrival_day"), "n", "late"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; restarts continue from the checkpoint, with the state store they began with."""
    conf = df.sparkSession.conf
    added = {} if any(k in conf.getAll for k in STATE) else STATE
    try:
        for k, v in added.items():
            conf.set(k, v)
        query = (
            df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k in added:
            conf.unset(k)
    return query
