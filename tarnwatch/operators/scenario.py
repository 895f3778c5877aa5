"""Controlled drift for calibrating thresholds, and the score of a calibration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tarnwatch.config import CalibrationPolicy, PolicyError, as_dict
from tarnwatch.plans.ordering import assign_parts


def shift_numeric(df: DataFrame, column: str, shift: float) -> DataFrame:
    return df.withColumn(column, F.col(column) + F.lit(shift))


def _chosen(df: DataFrame, key: Sequence[str], fraction: float, seed: int, by: Sequence[str]) -> DataFrame:
    """Mark exactly round(n * fraction) rows per group."""
    if not 0 <= fraction <= 1:
        raise PolicyError("fraction must be between zero and one")
    cut = F.array(F.bround(F.col("size") * fraction).cast("long"))
    return assign_parts(df, key=key, seed=seed, cuts=cut, by=by, out="__part").withColumn(
        "__chosen", (F.col("__part") == 0) & F.lit(fraction > 0)).drop("__part")


def replace_category(
    df: DataFrame, column: str, *, value: str, fraction: float, seed: int, key: Sequence[str], by: Sequence[str] = (),
) -> DataFrame:
    marked = _chosen(df, key, fraction, seed, by)
    return marked.withColumn(column, F.when(F.col("__chosen"), F.lit(value)).otherwise(F.col(column))).drop("__chosen")


def blank_out(df: DataFrame, column: str, *, fraction: float, seed: int, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    marked = _chosen(df, key, fraction, seed, by)
    return marked.withColumn(column, F.when(~F.col("__chosen"), F.col(column))).drop("__chosen")


def calibration_score(outcomes: DataFrame, policy: CalibrationPolicy = CalibrationPolicy(), by: Sequence[str] = ()) -> DataFrame:
    """Outcomes are (by..., scenario in stable/material, status, detection_windows)."""
    raised = F.col("status").isin("warning", "critical")
    stable, material = F.col("scenario") == "stable", F.col("scenario") == "material"
    rate = lambda hit, base: F.count_if(hit & raised) / F.greatest(F.count_if(base), F.lit(1))
    scored = outcomes.groupBy(*by).agg(
        rate(stable, stable).alias("fpr"), rate(material, material).alias("sens"),
        F.coalesce(F.max("detection_windows"), F.lit(policy.max_detection_windows + 1)).cast("long").alias("max_detection_windows"))
    accepted = (
        (F.col("fpr") <= policy.target_false_positive_rate) & (F.col("sens") >= policy.target_sensitivity)
        & (F.col("max_detection_windows") <= policy.max_detection_windows))
    return scored.select(
        *by, F.round("fpr", 8).alias("false_positive_rate"), F.round("sens", 8).alias("sensitivity"),
        "max_detection_windows", accepted.alias("accepted"))


def policy_identity(policy: CalibrationPolicy) -> str:
    """Content-addressed version of a calibration policy."""
    return hashlib.sha256(json.dumps(as_dict(policy), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
