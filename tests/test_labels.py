from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwatch import LabelPolicy
from tarnwatch.config import PolicyError
from tarnwatch.operators import metrics as mt
from tarnwatch.operators import reconcile as rc
from tarnwatch.operators.performance import PerformanceRun
from tarnwatch.sources.files import LABEL_SCHEMA, PREDICTION_SCHEMA

AS_OF = "2026-08-01 00:00:00"
POLICY = LabelPolicy(minimum_labels=4)


def p(i, probability, at=datetime(2026, 4, 1), entity=None):
    return (i, entity or f"entity-{i}", "k", at, probability, 0.5, "m", "a" * 64, "v1", "t", "r")


def l(i, churned, revision=1, entity=None, definition="d1", received=datetime(2026, 7, 2)):  # noqa: E743
    return (i, entity or f"entity-{i}", "k", churned, datetime(2026, 7, 1), received, revision, definition)


BASE_P = [p("p1", 0.9), p("p2", 0.8), p("p3", 0.4), p("p4", 0.1)]
BASE_L = [l("p1", True), l("p2", True), l("p3", False), l("p4", False)]


def run(spark, predictions, labels, policy=POLICY, origin="synthetic"):
    return PerformanceRun(
        spark.createDataFrame(predictions, PREDICTION_SCHEMA), spark.createDataFrame(labels, LABEL_SCHEMA),
        as_of=AS_OF, origin=origin, policy=policy)


def test_known_metrics(spark):
    row = run(spark, BASE_P, BASE_L).report().first()
    assert row["status"] == "stable" and row["coverage"] == 1.0
    assert [row[m] for m in ("average_precision", "roc_auc", "precision", "recall", "f1")] == [1.0] * 5
    assert row["brier_score"] == pytest.approx(0.055)
    assert [row[m] for m in ("tn", "fp", "fn", "tp")] == [2, 0, 0, 2]


def test_repeats_and_immature_predictions(spark):
    row = run(spark, [*BASE_P, BASE_P[0], p("p5", 0.9, datetime(2026, 7, 15))], [*BASE_L, BASE_L[0], l("p5", True)]).report().first()
    assert (row["mature_predictions"], row["joined_labels"]) == (4, 4)
    assert (row["duplicate_predictions"], row["duplicate_labels"], row["immature_predictions"]) == (1, 1, 1)
    assert row["unmatched_labels"] == 1


def test_low_coverage_and_no_labels(spark):
    low = run(spark, BASE_P, BASE_L[:2]).report().first()
    assert low["status"] == "insufficient_data" and low["roc_auc"] is None and low["tp"] is None
    assert run(spark, BASE_P, []).report().first()["status"] == "not_available"


def test_conflicts_and_latest_revision(spark):
    r = run(spark, [*BASE_P, p("p1", 0.2)], [*BASE_L, l("p2", False, revision=2)])
    row = r.report().first()
    assert (row["conflicting_predictions"], row["mature_predictions"], row["status"]) == (1, 3, "insufficient_data")
    assert {x["prediction_id"]: x["label_revision"] for x in r.selected_revisions().collect()}["p2"] == 2


def test_label_conflicts_count_every_copy_and_fall_back(spark):
    r = run(spark, BASE_P, [*BASE_L, l("p1", False, revision=2), l("p1", True, revision=2)])
    row = r.report().first()
    assert row["conflicting_labels"] == 2
    assert {x["prediction_id"]: x["label_revision"] for x in r.selected_revisions().collect()}["p1"] == 1


def test_foreign_entity_and_future_labels(spark):
    row = run(spark, BASE_P, [*BASE_L[:-1], l("p4", False, entity="wrong")]).report().first()
    assert (row["unmatched_labels"], row["unmatched_predictions"]) == (1, 1)
    row = run(spark, BASE_P, [*BASE_L[:-1], l("p4", False, received=datetime(2026, 8, 2))]).report().first()
    assert (row["unmatched_labels"], row["unmatched_predictions"]) == (0, 1)


def test_maturity_border_is_inclusive(spark):
    at = datetime(2026, 5, 2)  # 90 days and 24 hours before as_of
    row = run(spark, [p("p1", 0.9, at), p("p2", 0.9, datetime(2026, 5, 2, 0, 0, 1))], BASE_L).report().first()
    assert (row["mature_predictions"], row["immature_predictions"]) == (1, 1)


def test_cohorts_and_definitions(spark):
    rolling = run(spark, [*BASE_P, p("p5", 0.7, datetime(2026, 5, 1))], [*BASE_L, l("p5", True)])
    kind = rc.cohort(rolling.mature(), POLICY).first()
    assert (kind["kind"], kind["utc_months"], kind["acceptable"]) == ("rolling", "2026-04,2026-05", True)
    assert rolling.problems().count() == 0
    mixed = run(spark, BASE_P, [*BASE_L[:-1], l("p4", False, definition="d2")])
    assert [r["problem"] for r in mixed.problems().collect()] == ["label_definition"]
    gap = run(spark, [*BASE_P, p("p6", 0.7, datetime(2026, 2, 1))], BASE_L)
    assert [r["problem"] for r in gap.problems().collect()] == ["cohort"]


def test_an_unfit_cohort_is_refused(spark):
    """Mixed lineage, a null beside a value, two label definitions, a gap, and an unfit score: no metrics, and the reason."""
    def told(predictions, labels=BASE_L):
        row = run(spark, predictions, labels).report().first()
        assert row["roc_auc"] is None and row["tp"] is None
        return row["status"], row["reasons"]

    other = list(BASE_P[3])
    other[6] = "m2"
    assert told([*BASE_P[:3], tuple(other)]) == ("not_available", "lineage")
    other[6] = None
    assert told([*BASE_P[:3], tuple(other)]) == ("not_available", "lineage")
    assert told(BASE_P, [*BASE_L[:-1], l("p4", False, definition="d2")]) == ("not_available", "label_definition")
    assert told([*BASE_P, p("p6", 0.7, datetime(2026, 2, 1))]) == ("not_available", "cohort")
    assert told([*BASE_P[:3], p("p4", float("nan"))]) == ("not_available", "probability")
    both = run(spark, [*BASE_P, p("p6", 0.7, datetime(2026, 2, 1))], BASE_L).report({"month": F.date_format("prediction_at", "MM")})
    assert {r["month"]: r["status"] for r in both.collect()} == {"02": "not_available", "04": "stable"}


def test_production_needs_approval(spark):
    with pytest.raises(PolicyError):
        run(spark, BASE_P, BASE_L, origin="production")


def test_input_key_ignores_order_only(spark):
    a, b = spark.createDataFrame(BASE_P, PREDICTION_SCHEMA), spark.createDataFrame(BASE_L, LABEL_SCHEMA)
    key = lambda x, y: rc.input_key(x, y, POLICY, AS_OF, "synthetic").first()[0]
    assert key(a, b) == key(a.orderBy(F.desc("prediction_id")).repartition(3), b)
    assert key(a, b) != key(a, spark.createDataFrame(BASE_L[:3], LABEL_SCHEMA))


def test_a_hot_id_is_collapsed_before_the_shuffle(spark):
    """A third of all rows share one id: it arrives as one row per task."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("prediction_id"), F.lit(1).alias("x"))
    got = {r["prediction_id"]: (r["copies"], r["conflict"]) for r in rc.collapsed(rows, ["prediction_id"]).collect()}
    assert got["hot"] == (1000, False) and len(got) == 2001


# --- metrics against brute force ------------------------------------------------

def brute(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    ap = tp = 0.0
    for value in np.unique(s)[::-1]:
        block = y[s == value]
        tp += block.sum()
        ap += block.sum() / y.sum() * tp / (s >= value).sum()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    return ap, auc


@pytest.mark.parametrize("ties", [False, True])
def test_ranking_equals_brute_force(spark, ties):
    rng = np.random.default_rng(1)
    s = rng.random(2000)
    if ties:
        s = np.where(rng.random(2000) < 0.35, 0.5, np.round(s, 2))  # one score holds a third of the rows
    y = (rng.random(2000) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": range(2000), "y": y, "s": s}))
    row = mt.ranking_metrics(df, "y", "s", buckets=16).first()
    ap, auc = brute(y, s)
    assert row["average_precision"] == pytest.approx(ap, abs=1e-12) and row["roc_auc"] == pytest.approx(auc, abs=1e-12)


def test_single_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    row = mt.ranking_metrics(df, "y", "s").first()
    assert row["roc_auc"] is None and row["average_precision"] == 1.0


def test_best_threshold_takes_the_lowest_among_equals(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.3)], "y int, s double")
    best = mt.best_f1_threshold(df, "y", "s").first()
    assert best["threshold"] == 0.4 and best["f1"] == pytest.approx(0.8)


@pytest.mark.parametrize("n,bins", [(3, 5), (103, 10), (100, 10)])
def test_equal_frequency_bin_sizes(spark, n, bins):
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "y": np.arange(n) % 2, "s": np.where(np.arange(n) % 3 == 0, 0.5, np.arange(n) / n)}))
    got = {r["bin"]: r["n"] for r in mt.equal_frequency_bins(df, "y", "s", "id", bins, buckets=8).collect()}
    want = [len(part) for part in np.array_split(np.arange(n), bins) if len(part)]
    assert [got[i] for i in sorted(got)] == want


def test_two_sample_distances_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=700), 1), np.round(rng.normal(0.3, size=900), 1)
    df = spark.createDataFrame(pd.DataFrame({"v": np.r_[a, b], "ref": [1] * 700 + [0] * 900}))
    row = mt.two_sample_distances(df, "v", F.col("ref") == 1, buckets=8).first()
    grid = np.unique(np.r_[a, b])
    fa, fb = [np.searchsorted(np.sort(x), grid, side="right") / len(x) for x in (a, b)]
    assert row["ks"] == pytest.approx(np.max(np.abs(fa - fb)), abs=1e-12)
    assert row["wasserstein"] == pytest.approx(np.sum(np.abs(fa - fb)[:-1] * np.diff(grid)), abs=1e-12)
