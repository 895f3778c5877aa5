"""Redelivery removal and prediction-label matching on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def without_redeliveries(events: DataFrame, key: Sequence[str], at: str, delay: str = "24 hours") -> DataFrame:
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def matched_stream(
    predictions: DataFrame, labels: DataFrame, horizon_days: int = 91, delay: str = "24 hours", how: str = "leftOuter",
) -> DataFrame:
    """Each prediction with the labels received within the horizon; unmatched ones after it.

    Watermarks on both sides and the time bound let the state be dropped.
    """
    p = predictions.withWatermark("prediction_at", delay).alias("p")
    l = labels.withWatermark("received_at", delay).alias("l")  # noqa: E741
    condition = (
        (F.col("p.prediction_id") == F.col("l.prediction_id")) & (F.col("p.entity_key") == F.col("l.entity_key"))
        & (F.col("p.key_id") == F.col("l.key_id")) & (F.col("l.received_at") >= F.col("p.prediction_at"))
        & (F.col("l.received_at") <= F.col("p.prediction_at") + F.expr(f"INTERVAL {horizon_days} DAYS")))
    return p.join(l, condition, how).select(
        F.col("p.prediction_id").alias("prediction_id"), F.col("p.prediction_at").alias("prediction_at"),
        F.col("p.probability").alias("probability"), F.col("l.churned_within_horizon").alias("churned_within_horizon"),
        F.col("l.received_at").alias("received_at"), F.col("l.label_revision").alias("label_revision"))
