"""Fit, pick a threshold, evaluate: Spark ML on a keyed, stratified split."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tarnwatch.config import GatePolicy, PolicyError
from tarnwatch.operators.gates import evaluate
from tarnwatch.operators.metrics import best_f1_threshold, ranking_metrics, threshold_metrics
from tarnwatch.operators.scoring import bands_around, score_with_model
from tarnwatch.operators.split import only, stratified_split
from tarnwatch.plans.freeze import freeze
from tarnwatch.session import FILE_BY_FILE, SPENT_SHUFFLES, settings

FIT_ROWS = 250_000          # rows of a part that a fit keeps in memory and reads again in every pass


def logistic(features: Sequence[str], label: str, rows: int, c: float = 1.0, max_iter: int = 400) -> Pipeline:
    """L2 logistic regression with the penalty 1/C on the summed loss."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
        LogisticRegression(
            labelCol=label, regParam=1.0 / (c * rows), elasticNetParam=0.0, standardization=False, maxIter=max_iter)])


def boosted_trees(features: Sequence[str], label: str, seed: int = 42, **params) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
        GBTClassifier(labelCol=label, seed=seed, **params)])


def random_forest(features: Sequence[str], label: str, seed: int = 42, **params) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
        RandomForestClassifier(labelCol=label, seed=seed, **params)])


@dataclass(frozen=True)
class TrainedModel:
    model: PipelineModel
    threshold: float
    low: float
    high: float
    metrics: Mapping[str, float | None]
    split_rows: Mapping[str, int]


def training_parts(
    df: DataFrame, *, key: Sequence[str], label: str, seed: int = 42, fractions: Sequence[float] = (0.70, 0.15, 0.15),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """df and its split, written in files of bounded rows; of df only the columns in `keep`, if given. Trees need the key among them."""
    parts = stratified_split(df, key=key, stratum=[label], seed=seed, fractions=fractions)
    return freeze(parts.select(*keep, "split") if keep else parts, "training", maxRecordsPerFile=FIT_ROWS)


def fit_parts(rows: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """n rows dealt by key to as many parts as they need. Files are cut by their packed bytes; a fit keeps many times those."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / FIT_ROWS)), *key)


def train(
    df: DataFrame, *, key: Sequence[str], label: str, features: Sequence[str], family: str = "logistic_regression",
    seed: int = 42, fractions: Sequence[float] = (0.70, 0.15, 0.15), parts: DataFrame | None = None, **params,
) -> TrainedModel:
    """Fit on train, choose the threshold on validation, report on test.

    What the split and an iterative fit read many times is written once. Models of the same rows share `parts`, the result of
    `training_parts` with the same key, label, seed and fractions.

    Spark executes a shuffle below a logistic fit up to four times and keeps its files as long as the model. So a logistic fit, which
    packs its rows into blocks that may go to disk, reads files of bounded rows; only trees have their rows dealt by key.
    """
    spark, linear = df.sparkSession, family == "logistic_regression"
    if parts is None:
        prepared = freeze(df.select(*key, label, *features), "prepared")
        parts = training_parts(
            prepared, key=key, label=label, seed=seed, fractions=fractions, keep=[label, *features] if linear else None)
    sizes = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    fit_rows = only(parts, "train")
    if linear:
        estimator = logistic(features, label, sizes.get("train", 0), **params)
    elif family == "boosted_trees":
        estimator = boosted_trees(features, label, seed, **params)
    elif family == "random_forest":
        estimator = random_forest(features, label, seed, **params)
    else:
        raise PolicyError(f"model family {family!r} is not supported")
    with settings(spark, FILE_BY_FILE if linear else {}):
        model = estimator.fit(fit_rows if linear else fit_parts(fit_rows, key, sizes.get("train", 0)))
    scores = freeze(score_with_model(model, parts.where(F.col("split") != "train"), keep=[label, "split"]), "scores")
    with settings(spark, SPENT_SHUFFLES):
        threshold = float(best_f1_threshold(only(scores, "validation"), label, "probability").first()["threshold"])
        test = only(scores, "test")
        ranking = ranking_metrics(test, label, "probability").first()
        at = threshold_metrics(test, label, "probability", threshold).first()
    low, high = bands_around(threshold)
    return TrainedModel(
        model, threshold, low, high,
        {"average_precision": ranking["average_precision"], "roc_auc": ranking["roc_auc"], "f1": at["f1"],
         "precision": at["precision"], "recall": at["recall"], "brier_score": at["brier_score"],
         "decision_threshold": threshold}, sizes)


def run_record(trained: TrainedModel, spark, *, run_name: str, family: str, seed: int, code_revision: str) -> DataFrame:
    return spark.createDataFrame(
        [(run_name, family, seed, code_revision, trained.threshold, trained.low, trained.high,
          {k: float(v) for k, v in trained.metrics.items() if v is not None}, dict(trained.split_rows))],
        "run_name string, model_family string, seed int, code_revision string, decision_threshold double, "
        "low_risk_threshold double, high_risk_threshold double, metrics map<string,double>, split_rows map<string,long>")


def evaluate_candidate(
    df: DataFrame, *, key: Sequence[str], label: str, candidate: TrainedModel, champion: TrainedModel | None = None,
    policy: GatePolicy = GatePolicy(), seed: int = 42, fractions: Sequence[float] = (0.70, 0.15, 0.15),
) -> DataFrame:
    """Gate a candidate on the test part, rebuilt from keys and seed alone."""
    test = only(stratified_split(df, key=key, stratum=[label], seed=seed, fractions=fractions), "test")
    rows = score_with_model(candidate.model, test, out="candidate_score", keep=test.columns)
    if champion is not None:
        rows = score_with_model(champion.model, rows, out="champion_score", keep=rows.columns)
    columns = [*key, label, "candidate_score"] + (["champion_score"] if champion else [])
    scores = freeze(rows.select(*columns), "candidate-scores", compression="zstd")
    return evaluate(
        scores, label, "candidate_score", candidate.threshold, key[0], policy,
        champion_score="champion_score" if champion else None,
        champion_threshold=champion.threshold if champion else None)
