"""Exact model-quality metrics at any size, for any number of groups at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwatch.functions.expressions import safe_ratio
from tarnwatch.plans.freeze import freeze
from tarnwatch.plans.ordering import (
    clean_number,
    hash_digits,
    rows_at_ranks,
    split_points,
    unwrapped,
    with_buckets,
    wrapped,
)

ALL = "__all"


def grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group columns as they go through joins: wrapped, so that a null group equals itself."""
    return (wrapped(df, by), list(by)) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def ungrouped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return unwrapped(df, by) if by else df.drop(ALL)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns that may be null; one row each if there are none."""
    (a, group), (b, _) = grouped(left, by), grouped(right, by)
    return ungrouped(a.join(b, group, how), by)


def score_audit(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose score is null or no number: (by..., bad_scores)."""
    return df.groupBy(*by).agg(F.count_if(clean_number(F.col(score)).isNull()).alias("bad_scores"))


def _scored(df: DataFrame, label: str, score: str, by: Sequence[str], *more: Column) -> DataFrame:
    return df.select(
        *by, clean_number(F.col(score)).alias("score"), F.col(label).cast("int").cast("long").alias("pos"), *more,
    ).where(F.col("score").isNotNull())


def ranked_scores(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None,
) -> DataFrame:
    return ungrouped(_ranked_scores(df, label, score, by, buckets), by)


def _ranked_scores(df: DataFrame, label: str, score: str, by: Sequence[str], buckets: int | None) -> DataFrame:
    """One row per distinct score, with what lies strictly above it; group columns wrapped.

    (by..., score, n, pos, above_n, above_pos, total_n, total_pos, higher), where
    `higher` is the next higher score of the group.

    Equal scores are merged map-side. Running counts are taken inside score
    buckets and shifted by the totals of the buckets above, so no task sorts a
    whole group.
    """
    df, group = grouped(df, by)
    base = _scored(df, label, score, group)
    splits = split_points(base, {"score": F.col("score")}, buckets)
    placed = with_buckets(base, {"score": "bucket"}, splits)
    # Said once and early, these filters are the same on both sides of the join
    # below, so that both read one and the same shuffle of `blocks`.
    placed = placed.where(F.col("bucket").isNotNull())
    for c in group:
        placed = placed.where(F.col(c).isNotNull())     # wrapped groups never are
    blocks = placed.groupBy(*group, "bucket", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))
    totals = blocks.groupBy(*group, "bucket").agg(
        F.sum("n").alias("bn"), F.sum("pos").alias("bp"), F.min("score").alias("lowest"))
    above = Window.partitionBy(*group).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    downward = Window.partitionBy(*group).orderBy(F.col("bucket").desc())
    whole = Window.partitionBy(*group)
    starts = totals.select(
        *group, "bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("start_n"),
        F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("start_pos"),
        F.sum("bn").over(whole).alias("total_n"), F.sum("bp").over(whole).alias("total_pos"),
        F.lag("lowest").over(downward).alias("bucket_above"))
    inside = Window.partitionBy(*group, "bucket").orderBy(F.col("score").desc())
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumns({
        "local_n": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "local_pos": F.coalesce(F.sum("pos").over(before), F.lit(0)),
        "next_up": F.lag("score").over(inside)})
    return local.join(starts, [*group, "bucket"]).select(
        *group, "score", "n", "pos", (F.col("start_n") + F.col("local_n")).alias("above_n"),
        (F.col("start_pos") + F.col("local_pos")).alias("above_pos"), "total_n", "total_pos",
        F.coalesce("next_up", "bucket_above").alias("higher"))


def ranking_from(ranked: DataFrame, group: Sequence[str]) -> DataFrame:
    n, pos, tp = F.col("n"), F.col("pos"), F.col("above_pos") + F.col("pos")
    negatives = F.col("total_n") - F.col("total_pos")
    ap = F.sum(safe_ratio(pos, F.col("total_pos")) * tp / (F.col("above_n") + n))
    wins = F.sum((n - pos) * (F.col("above_pos") + pos / 2))
    one = ranked.groupBy(*group).agg(
        F.max("total_n").alias("n"), F.max("total_pos").alias("n_positive"), ap.alias("average_precision"),
        wins.alias("wins"), F.max(negatives).alias("negatives"))
    return one.select(
        *group, "n", "n_positive", "average_precision",
        F.when((F.col("negatives") > 0) & (F.col("n_positive") > 0), F.col("wins") / (F.col("negatives") * F.col("n_positive")))
        .alias("roc_auc"))


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Step-wise average precision and tie-averaged ROC AUC (null for one class). A group with unfit scores is refused: it has its
    count of them in bad_scores and no metrics."""
    audit, group = grouped(score_audit(df, score, by), by)
    ranking = ranking_from(_ranked_scores(df, label, score, by, buckets), group)
    fit = F.col("bad_scores") == 0
    found = audit.join(ranking, group, "left").select(
        *group, "n", "n_positive", *[F.when(fit, F.col(m)).alias(m) for m in ("average_precision", "roc_auc")], "bad_scores")
    return ungrouped(found, by)


def precision_recall_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(by..., threshold, precision, recall): one point per distinct score. Groups with unfit scores are refused, they have none
    (`score_audit` counts these)."""
    tp = F.col("above_pos") + F.col("pos")
    bad = score_audit(df, score, by).where("bad_scores > 0")
    ranked = join_groups(ranked_scores(df, label, score, by, buckets), bad.select(*by), by, "left_anti")
    return ranked.select(
        *by, F.col("score").alias("threshold"), (tp / (F.col("above_n") + F.col("n"))).alias("precision"),
        safe_ratio(tp, F.col("total_pos")).alias("recall"))


def best_f1_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Highest F1; the lowest threshold among equals."""
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-12))
    points = precision_recall_curve(df, label, score, by, buckets).withColumn("f1", f1)
    best = points.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("low"), "precision", "recall")).alias("b"))
    return best.select(*by, (-F.col("b.low")).alias("threshold"), "b.f1", "b.precision", "b.recall")


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix, precision, recall, F1 (0 where undefined) and Brier score."""
    y, p = F.col(label).cast("int"), F.col(score).cast("double")
    hit = F.coalesce(~F.isnan(p) & (p >= threshold), F.lit(False))
    counts = df.groupBy(*by).agg(
        F.count_if(~hit & (y == 0)).alias("tn"), F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(hit & (y == 1)).alias("tp"),
        F.avg((p - y) * (p - y)).alias("brier_score"))
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select(
        *by, "tn", "fp", "fn", "tp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "brier_score")


def calibration_table(df: DataFrame, label: str, score: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Left-closed bins, empty ones kept: (by..., bin, lower, upper, n, mean_probability, observed_rate)."""
    inner = [-math.inf, *edges[1:-1], math.inf]
    base = df.select(*by, F.col(score).cast("double").alias("p"), F.col(label).cast("int").alias("y"))
    placed = Bucketizer(splits=inner, inputCol="p", outputCol="bin", handleInvalid="skip").transform(base)
    cells = placed.groupBy(*by, F.col("bin").cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("orate"))

    def one(i: int) -> Column:
        here = F.col("bin") == i
        return F.struct(
            F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("lower"), F.lit(float(edges[i + 1])).alias("upper"),
            F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias("n"),
            F.max(F.when(here, F.col("mp"))).alias("mean_probability"),
            F.max(F.when(here, F.col("orate"))).alias("observed_rate"))

    return cells.groupBy(*by).agg(F.array(*[one(i) for i in range(len(edges) - 1)]).alias("bins")).select(
        *by, F.inline("bins"))


def equal_frequency_bins(
    df: DataFrame, label: str, score: str, key: str, bins: int, by: Sequence[str] = (), buckets: int | None = None,
) -> DataFrame:
    """(by..., bin, n, mean_probability, observed_rate) over `bins` groups of near-equal size.

    Rows are ordered by score, then by a hash of `key`. Only the buckets that a
    bin border falls into are ranked; a score frequent enough to fill a bucket is
    cut further by hash prefix. Every row is then placed by comparing it with the
    few border rows, without a shuffle.
    """
    df, group = grouped(df, by)
    base = _scored(df, label, score, group, F.md5(F.col(key).cast("string")).alias("tie"))
    splits = split_points(base, {"score": F.col("score")}, buckets)
    heavy = list(splits["score"].heavy)
    placed = with_buckets(base, {"score": "bucket"}, splits)
    prefix = F.substring("tie", 1, hash_digits(df))
    placed = placed.withColumn("sub", F.when(F.col("bucket").isin(*heavy), prefix).otherwise("") if heavy else F.lit(""))
    quotient, remainder = F.floor(F.col("size") / bins), F.col("size") % bins
    starts = F.array(*[(i * quotient + F.least(F.lit(i), remainder)).cast("long") for i in range(1, bins)])
    border = rows_at_ranks(placed, by=group, bucket=["bucket", "sub"], order=["score", "tie"], ranks=starts)
    borders = freeze(border.groupBy(*group).agg(F.collect_list(F.struct("score", "tie")).alias("borders")), "bin-borders")
    passed = F.filter("borders", lambda b: (b["score"] < F.col("score")) | ((b["score"] == F.col("score")) & (b["tie"] <= F.col("tie"))))
    located = base.join(borders, group, "left").withColumn("bin", F.coalesce(F.size(passed), F.lit(0)))
    bins_found = located.groupBy(*group, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_probability"), F.avg("pos").alias("observed_rate"))
    return ungrouped(bins_found, by)


def expected_calibration_error(
    df: DataFrame, label: str, score: str, key: str, bins: int = 10, by: Sequence[str] = (), buckets: int | None = None,
) -> DataFrame:
    parts = equal_frequency_bins(df, label, score, key, bins, by, buckets)
    gap = F.abs(F.col("mean_probability") - F.col("observed_rate"))
    return parts.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("expected_calibration_error"))


def full_metrics(
    df: DataFrame, label: str, score: str, threshold: float, key: str, bins: int = 10, by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """All gate metrics, one row per group."""
    df, group = grouped(df, by)
    joined = (
        ranking_metrics(df, label, score, group, buckets).drop("bad_scores")
        .join(threshold_metrics(df, label, score, threshold, group), group)
        .join(expected_calibration_error(df, label, score, key, bins, group, buckets), group, "left")
    )
    return ungrouped(joined, by)


# --- distances to a raw reference ------------------------------------------------

def two_sample_distances(
    df: DataFrame, value: str, is_reference: Column, by: Sequence[str] = (), buckets: int | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov and first Wasserstein distance, exact.

    Reference rows count as positives; after that both distances are differences
    of cumulative shares along the ranked values.
    """
    ranked = _ranked_scores(df.withColumn("__ref", is_reference.cast("int")), "__ref", value, by, buckets)
    group = list(by) or [ALL]
    others = F.col("total_n") - F.col("total_pos")
    ref_above = F.col("above_pos") / F.col("total_pos")
    cur_above = (F.col("above_n") - F.col("above_pos")) / others
    split = F.abs(ref_above - cur_above)
    step = F.coalesce(F.col("higher") - F.col("score"), F.lit(0.0))
    found = ranked.groupBy(*group).agg(F.max(split).alias("ks"), F.sum(split * step).alias("wasserstein"))
    return ungrouped(found, by)
