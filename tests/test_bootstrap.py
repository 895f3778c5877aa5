"""Stratified bootstrap of the differences between two models, against plain NumPy over drawn rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import bootstrap as bs


def scored(n=900, seed=1, steps=20):
    """Scores in the middle of steps, so that cells lose nothing."""
    draw = np.random.default_rng(seed)
    y = (draw.random(n) < 0.35).astype(int)
    a = np.clip(0.3 * y + draw.random(n) * 0.7, 0, 0.999)
    b = np.clip(0.2 * y + draw.random(n) * 0.8, 0, 0.999)
    a, b = (np.floor(x * steps) / steps + 0.5 / steps for x in (a, b))
    return y, a, b


def plain_metrics(y, p, threshold, bins=10):
    """Metrics of rows, one by one: AP and AUC by their definitions, calibration over rows split at the bin ends."""
    thresholds = sorted(set(p), reverse=True)
    ap, before = 0.0, 0.0
    for t in thresholds:
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        ap += (recall - before) * y[hit].mean()
        before = recall
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    hit = p >= threshold
    tp, fp, fn = (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 1)).sum()
    cells = sorted(set(p))
    gap, ends = np.zeros(bins), np.linspace(0, len(y), bins + 1)
    at = 0
    for value in cells:
        own = p == value
        n = own.sum()
        for k in range(bins):
            share = max(0.0, min(at + n, ends[k + 1]) - max(at, ends[k])) / n
            gap[k] += share * (p[own] - y[own]).sum()
        at += n
    return (ap, tp / (tp + fn), tp / (tp + fp) if tp + fp else 0.0, 2 * tp / (2 * tp + fp + fn), auc, ((p - y) ** 2).mean(),
            np.abs(gap).sum() / len(y))


def frame(spark, y, a, b):
    rows = [(k, int(u), float(v), float(w)) for k, (u, v, w) in enumerate(zip(y, a, b))]
    return spark.createDataFrame(rows, "id long, y int, a double, b double")


def test_replicates_equal_rows_drawn_with_the_same_weights(spark):
    y, a, b = scored()
    thresholds = (0.5, 0.4)
    steps = bs.score_steps(20, thresholds)
    cells = bs.comparison_cells(frame(spark, y, a, b), "y", "a", "b", steps)
    drawn = {r["replicate"]: r for r in bs.bootstrap_replicates(cells, steps, thresholds, 60, 42, 10).collect()}
    assert sorted(drawn) == list(range(60))
    local = cells.orderBy("y", "candidate", "champion").collect()
    n, strata = np.array([r["n"] for r in local]), np.array([r["y"] for r in local])
    for replicate in (0, 7, 59):
        weight = bs.resampled(n, strata, 42, replicate)
        assert [weight[strata == k].sum() for k in (0, 1)] == [(y == k).sum() for k in (0, 1)]
        again = [np.repeat([r[c] for r in local], weight) for c in ("y", "candidate_sum", "champion_sum", "n")]
        yy, p, q = again[0], np.round(again[1] / again[3], 9), np.round(again[2] / again[3], 9)
        expected = [*plain_metrics(yy, p, 0.5), *plain_metrics(yy, q, 0.4)]
        assert [drawn[replicate][f"{m}_{k}"] for m in bs.MODELS for k in bs.METRICS] == pytest.approx(expected, abs=1e-9)


def test_intervals_are_those_of_a_plain_bootstrap(spark):
    y, a, b = scored(600, 3)
    found = bs.regression_evidence(frame(spark, y, a, b), "y", "a", "b", "id", 0.5, 0.5, resolution=20, replicates=1000).collect()
    draw, zeros, ones = np.random.default_rng(8), np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    deltas = []
    for _ in range(400):
        rows = np.concatenate((draw.choice(zeros, len(zeros)), draw.choice(ones, len(ones))))
        deltas.append(np.subtract(plain_metrics(y[rows], a[rows], 0.5), plain_metrics(y[rows], b[rows], 0.5)))
    deltas = np.array(deltas)
    by_name = {r["metric"]: r for r in found}
    assert list(by_name) == list(bs.METRICS) and all(r["replicates"] == 1000 and r["verdict"] is None for r in found)
    for k, metric in enumerate(bs.METRICS):
        low, high = np.quantile(deltas[:, k], (0.025, 0.975))
        spread = deltas[:, k].std()
        row = by_name[metric]
        assert abs(row["low"] - low) < 0.5 * spread and abs(row["high"] - high) < 0.5 * spread
        assert row["delta"] == pytest.approx(row["candidate"] - row["champion"])
    exact = np.subtract(plain_metrics(y, a, 0.5), plain_metrics(y, b, 0.5))
    assert [by_name[m]["delta"] for m in bs.METRICS[:6]] == pytest.approx(list(exact[:6]))


def test_intervals_do_not_depend_on_the_layout_and_groups_are_apart(spark):
    y, a, b = scored(500, 5)
    df = frame(spark, y, a, b)
    df = df.withColumn("g", F.when(F.col("id") % 2 == 0, F.lit("even")))          # the other group is null

    def run(rows, **more):
        found = bs.regression_evidence(rows, "y", "a", "b", "id", 0.5, 0.5, replicates=120, **more)
        return {(r["metric"], r["failed"], r["replicates"], *([r["g"]] if more else [])): [r[c] for c in ("candidate", "champion", "delta", "low", "high")]
                for r in found.collect()}

    grouped, again = run(df, by=["g"]), run(df.repartition(7, "a"), by=["g"])
    assert len(grouped) == 14 and grouped.keys() == again.keys()
    alone = run(df.where("g = 'even'"))
    for key, numbers in grouped.items():
        assert numbers == pytest.approx(again[key], abs=1e-12)
        if key[3] == "even":
            assert numbers == pytest.approx(alone[key[:3]], abs=1e-12)


def test_groups_that_cannot_be_compared_have_a_reason(spark):
    rows = [(1, "nan", 1, float("nan"), 0.5), (2, "nan", 0, 0.1, 0.5), (3, "one", 1, 0.2, 0.5), (4, "null", 1, 0.2, None), (5, "null", 0, 0.2, 0.2)]
    df = spark.createDataFrame(rows, "id long, g string, y int, a double, b double")
    found = bs.regression_evidence(df, "y", "a", "b", "id", 0.5, 0.5, by=["g"], replicates=10).collect()
    assert {(r["g"], r["verdict"]) for r in found} == {("nan", "probability_validity"), ("one", "target_class_coverage"),
                                                       ("null", "champion_probability_validity")}
    assert all(r[c] is None for r in found for c in ("candidate", "champion", "delta", "low", "high", "failed", "replicates"))
    empty = bs.regression_evidence(df.limit(0), "y", "a", "b", "id", 0.5, 0.5, replicates=10).collect()
    assert {r["verdict"] for r in empty} == {"evaluation_input"} and len(empty) == 7


def test_draws_of_a_cell_have_the_right_mean_and_spread():
    n, y = np.array([50, 150, 300, 20, 80]), np.array([0, 0, 0, 1, 1])
    drawn = np.array([bs.resampled(n, y, 1, k) for k in range(4000)])
    size = np.array([500, 500, 500, 100, 100])
    assert drawn.mean(0) == pytest.approx(n, rel=0.02)
    assert drawn.var(0) == pytest.approx(n * (1 - n / size), rel=0.1)
    assert pa.array(drawn[0]).null_count == 0
