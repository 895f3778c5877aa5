"""What follows a score: validity, decision, risk band, batch summary, blended scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.functions.expressions import risk_band, valid_probability


def score_with_model(model: PipelineModel, df: DataFrame, out: str = "probability", keep: Sequence[str] = ()) -> DataFrame:
    scored = model.transform(df)
    columns = keep or df.columns
    return scored.select(*columns, vector_to_array("probability")[1].alias(out))


def score_with_function(
    df: DataFrame, predict: Callable[[pd.DataFrame], Sequence[float]], schema: str, out: str = "probability",
) -> DataFrame:
    """For a model that only exists in Python: Arrow batches in, one column more out."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: list(predict(frame))})

    return df.mapInPandas(batches, schema)


def probability_audit(df: DataFrame, probability: str, by: Sequence[str] = ()) -> DataFrame:
    p = F.col(probability)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~valid_probability(p)).alias("n_invalid"))


def bands_around(threshold: float, width: float = 0.2) -> tuple[float, float]:
    return max(0.0, threshold - width), min(1.0, threshold + width)


def decided(df: DataFrame, probability: str, *, threshold: float, low: float, high: float) -> DataFrame:
    p = F.col(probability)
    return df.withColumns({
        "decision": F.coalesce((valid_probability(p) & (p >= threshold)).cast("int"), F.lit(0)),
        "risk_band": F.when(valid_probability(p), risk_band(p, low, threshold, high)),
    })


def batch_summary(df: DataFrame, probability: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    p = F.col(probability)
    positives = F.count_if(p >= threshold)
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("n"), positives.alias("n_positive"), F.round(positives / n * 100, 2).alias("positive_rate_pct"),
        F.round(F.avg(p), 4).alias("mean_probability"))


def weighted_vote(weights: Mapping[str, float]) -> Column:
    """Soft vote of probability columns of one table."""
    total = sum(weights.values())
    votes = [F.col(c) * (w / total) for c, w in weights.items()]
    blended = votes[0]
    for v in votes[1:]:
        blended = blended + v
    return blended


def joined_vote(scores: Sequence[tuple[DataFrame, float]], key: Sequence[str], probability: str = "probability") -> DataFrame:
    """Soft vote of separate score tables. One shuffle for all: union, then a weighted sum per key."""
    total = sum(w for _, w in scores)
    stacked = None
    for df, weight in scores:
        part = df.select(*key, (F.col(probability) * (weight / total)).alias("vote"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*key).agg(F.sum("vote").alias(probability), F.count(F.lit(1)).alias("votes")).where(
        F.col("votes") == len(scores)).drop("votes")
