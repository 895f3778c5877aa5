"""Service telemetry: value counts, cumulative latency histograms, rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.config import LATENCY_BUCKETS_MS
from tarnwatch.plans.longform import melt
from tarnwatch.plans.ordering import quantiles


def value_counts(df: DataFrame, dimensions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by..., dimension, value, n) of several columns in one pass."""
    cells = melt(df, by, {name: F.struct(c.cast("string").alias("value")) for name, c in dimensions.items()})
    return cells.groupBy(*by, F.col("feature").alias("dimension"), "value").agg(F.count(F.lit(1)).alias("n"))


def histogram_aggregates(latency: Column, buckets: Sequence[float] = LATENCY_BUCKETS_MS) -> list[Column]:
    return [
        *[F.count_if(latency <= b).alias(f"le_{b}") for b in buckets],
        F.count(latency).alias("le_inf"), F.sum(latency).alias("latency_sum"),
    ]


def latency_histogram(df: DataFrame, latency: str, by: Sequence[str] = (), buckets: Sequence[float] = LATENCY_BUCKETS_MS) -> DataFrame:
    """Cumulative buckets in tidy form: (by..., le, n, latency_sum, latency_count)."""
    wide = df.groupBy(*by).agg(*histogram_aggregates(F.col(latency), buckets))
    rows = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{b}").alias("n")) for b in buckets],
        F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
    return wide.select(*by, F.inline(rows), "latency_sum", F.col("le_inf").alias("latency_count"))


def rollup(
    events: DataFrame, at: str, latency: str, failed: Column, length: str = "1 hour", by: Sequence[str] = (),
    watermark: str | None = None,
) -> DataFrame:
    """Requests, errors, rates and latency histogram per tumbling window. Batch and stream alike."""
    source = events.withWatermark(at, watermark) if watermark else events
    sums = source.groupBy(F.window(at, length).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("errors"), *histogram_aggregates(F.col(latency)))
    return sums.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "requests", "errors",
        (F.col("errors") / F.col("requests")).alias("error_rate"),
        (1 - F.col("errors") / F.col("requests")).alias("success_rate"),
        *[f"le_{b}" for b in LATENCY_BUCKETS_MS], "le_inf", "latency_sum")


def latency_p95(events: DataFrame, at: str, latency: str, length: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """Exact p95 per tumbling window."""
    windowed = events.withColumn("window_start", F.window(at, length)["start"])
    rows = quantiles(windowed, {"latency": F.col(latency)}, [0.95], by=["window_start", *by])
    return rows.select("window_start", *by, F.col("value").alias("latency_p95_ms"))


def day_windows(events: DataFrame, at: str, arrived: str, grace_hours: int = 24) -> DataFrame:
    """Per UTC day: rows in time and rows that came after the day's end plus grace."""
    day = F.window(at, "1 day")
    late = F.unix_micros(arrived) - F.unix_micros(F.col("w.end")) > grace_hours * 3_600_000_000
    return events.withColumn("w", day).groupBy(F.col("w.start").alias("day")).agg(
        F.count_if(~late).alias("on_time"), F.count_if(late).alias("late"))
