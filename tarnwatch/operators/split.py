"""Seeded, exactly sized, stratified splits that depend on keys only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tarnwatch.config import PolicyError
from tarnwatch.plans.ordering import assign_parts

NAMES = ("train", "validation", "test")


def stratified_split(
    df: DataFrame, *, key: Sequence[str], stratum: Sequence[str], seed: int = 42,
    fractions: Sequence[float] = (0.70, 0.15, 0.15), names: Sequence[str] = NAMES, out: str = "split",
) -> DataFrame:
    """Add `split`. Sizes per stratum are the rounded fractions; the rows are not shuffled."""
    if abs(sum(fractions) - 1) > 1e-9 or len(fractions) != len(names) or any(f <= 0 for f in fractions):
        raise PolicyError("fractions must be positive and sum to 1")
    edges = [sum(fractions[: i + 1]) for i in range(len(fractions) - 1)]
    cuts = F.array(*[F.round(F.col("size") * e).cast("long") for e in edges])
    parts = assign_parts(df, key=key, seed=seed, cuts=cuts, by=stratum, out="__part")
    return parts.withColumn(out, F.element_at(F.lit(list(names)), F.col("__part") + 1)).drop("__part")


def only(df: DataFrame, name: str, column: str = "split") -> DataFrame:
    """One partition again: the split is a pure function of key and seed."""
    return df.where(F.col(column) == name).drop(column)
