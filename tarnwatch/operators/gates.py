"""Quality gates: validity first, then absolute limits, then loss against a champion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.config import GatePolicy
from tarnwatch.functions.expressions import valid_probability
from tarnwatch.operators.metrics import full_metrics, grouped, join_groups, ungrouped
from tarnwatch.plans.ordering import quantiles


def input_verdict(
    df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = (),
    champion_score: str | None = None, champion_threshold: float | None = None,
) -> DataFrame:
    """First reason why a group cannot be evaluated, or null: (by..., verdict, champion_verdict)."""
    y = F.col(label).cast("int")
    audit = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(~y.isin(0, 1), F.lit(True))).alias("bad_labels"),
        F.count_if(~valid_probability(F.col(score).cast("double"))).alias("bad_scores"),
        F.count_if(y == 1).alias("n_1"), F.count_if(y == 0).alias("n_0"),
        (F.count_if(~valid_probability(F.col(champion_score).cast("double"))) if champion_score else F.lit(0)).alias("bad_champion"),
    )
    verdict = (
        F.when((F.col("n") == 0) | (F.col("bad_labels") > 0) | F.lit(not 0 <= threshold <= 1), "evaluation_input")
        .when(F.col("bad_scores") > 0, "probability_validity")
        .when((F.col("n_1") == 0) | (F.col("n_0") == 0), "target_class_coverage"))
    champion = F.lit(None).cast("string")
    if champion_score:
        usable = champion_threshold is not None and 0 <= champion_threshold <= 1
        champion = F.when(F.col("bad_champion") > 0, "champion_probability_validity").when(F.lit(not usable), "champion_threshold")
    return audit.select(*by, F.col("n").alias("n_rows"), verdict.alias("verdict"), champion.alias("champion_verdict"))


def _named(failures: Mapping[str, Column]) -> Column:
    marks = F.array(*[F.when(failed, F.lit(name)) for name, failed in failures.items()])
    return F.filter(marks, lambda m: m.isNotNull())


def absolute_failures(policy: GatePolicy) -> Column:
    return _named({
        f"absolute.{m}": (F.col(m) > limit) if m in policy.lower_is_better else (F.col(m) < limit)
        for m, limit in policy.absolute.items()})


def regression_failures(policy: GatePolicy, champion: str = "champion_") -> Column:
    def loss(m: str) -> Column:
        gap = F.col(f"{champion}{m}") - F.col(m)
        return -gap if m in policy.lower_is_better else gap

    return _named({f"regression.{m}": loss(m) > limit for m, limit in policy.regression.items()})


def latency_failures(latencies: DataFrame, value: str, limits: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact p95 of recorded latencies against each limit: (by..., gate, p95, limit, failed)."""
    p95 = quantiles(latencies, {"latency": F.col(value)}, [0.95], by=by).select(*by, F.col("value").alias("p95"))
    rows = F.array(*[F.struct(F.lit(f"latency.{n}").alias("gate"), F.lit(float(v)).alias("limit")) for n, v in limits.items()])
    return p95.select(*by, "p95", F.inline(rows)).withColumn("failed", F.col("p95") > F.col("limit"))


def evaluate(
    df: DataFrame, label: str, score: str, threshold: float, key: str, policy: GatePolicy = GatePolicy(),
    by: Sequence[str] = (), champion_score: str | None = None, champion_threshold: float | None = None,
) -> DataFrame:
    """One row per group: status, failures, candidate and champion metrics."""
    verdict = input_verdict(df, label, score, threshold, by, champion_score, champion_threshold)
    verdict = grouped(verdict, by)[0]  # taken before grouping: an empty table still gets its verdict
    df, group = grouped(df, by)
    usable = df.where(valid_probability(F.col(score).cast("double")) & F.col(label).cast("int").isin(0, 1))
    rows = verdict.join(full_metrics(usable, label, score, threshold, key, policy.ece_bins, group), group, "left")
    failures = absolute_failures(policy)
    if champion_score:
        other = df.where(valid_probability(F.col(champion_score).cast("double")) & F.col(label).cast("int").isin(0, 1))
        names = [m for m in policy.regression]
        champion = full_metrics(other, label, champion_score, champion_threshold or 0.0, key, policy.ece_bins, group)
        champion = champion.select(*group, *[F.col(m).alias(f"champion_{m}") for m in names])
        rows = rows.join(champion, group, "left")
        failures = F.concat(failures, regression_failures(policy))
    passed = F.lit("passed" if champion_score else "not_comparable")
    reason = F.coalesce("verdict", "champion_verdict")
    metrics = [m for m in policy.absolute]
    hidden = F.col("verdict").isNotNull()
    verdicts = rows.select(
        *group, "n_rows",
        F.when(reason.isNotNull(), "invalid").when(F.size(failures) > 0, "failed").otherwise(passed).alias("status"),
        F.when(reason.isNotNull(), F.array(reason)).otherwise(failures).alias("failures"),
        *[F.when(~hidden, F.col(m)).alias(m) for m in metrics],
        *([F.col(f"champion_{m}") for m in policy.regression] if champion_score else []),
    )
    return ungrouped(verdicts, by)


def with_latency(verdicts: DataFrame, latencies: DataFrame, value: str, policy: GatePolicy = GatePolicy(), by: Sequence[str] = ()) -> DataFrame:
    """Verdicts of `evaluate` with the latency gates: a limit that is missed, or not measured, adds its name to the failures, and a
    verdict that is not invalid fails with them."""
    missed = latency_failures(latencies, value, policy.latency, by).where(F.coalesce("failed", F.lit(True)))
    missed = missed.groupBy(*by).agg(F.array_sort(F.collect_list("gate")).alias("__missed"))  # one row per gate
    unmeasured = F.array(*[F.lit(f"latency.{n}") for n in sorted(policy.latency)])
    known = latencies.where(F.col(value).isNotNull()).groupBy(*by).agg(F.lit(True).alias("__known"), F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")
    rows = join_groups(join_groups(verdicts, missed, by, "left"), known, by, "left")
    late = F.when(F.col("__known").isNull(), unmeasured).otherwise(F.coalesce("__missed", F.array().cast("array<string>")))
    both = F.when(F.col("status") == "invalid", F.col("failures")).otherwise(F.concat("failures", late))
    rows = rows.withColumn("failures", both)
    failed = (F.col("status") != "invalid") & (F.size("failures") > 0)
    return rows.withColumn("status", F.when(failed, "failed").otherwise(F.col("status"))).drop("__missed", "__known")
