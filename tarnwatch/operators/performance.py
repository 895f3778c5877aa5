"""The delayed-label report: reconciliation, evidence status and, when earned, metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.config import LabelPolicy
from tarnwatch.operators.metrics import calibration_table, join_groups, ranking_metrics, score_audit, threshold_metrics
from tarnwatch.operators.reconcile import (
    check_origin,
    cohort,
    matched_pairs,
    mixed_lineage,
    reconciled,
    reconciliation_counts,
)
from tarnwatch.plans.freeze import freeze


class PerformanceRun:
    """Reconciles once; every report reads the written outcome."""

    def __init__(self, predictions: DataFrame, labels: DataFrame, *, as_of: str, origin: str, policy: LabelPolicy = LabelPolicy()):
        check_origin(origin, policy)
        self.policy, self.origin, self.as_of = policy, origin, as_of
        self.rows = freeze(reconciled(predictions, labels, F.lit(as_of).cast("timestamp"), policy), "reconciled")
        self.pairs = matched_pairs(self.rows)

    def mature(self) -> DataFrame:
        return self.rows.where(F.col("state").isin("matched", "unmatched")).select("prediction_id", "prediction.*")

    def problems(self, by: Mapping[str, Column] | None = None) -> DataFrame:
        """Reasons why a cohort may not be evaluated as one: (by..., problem, detail)."""
        names = list(by or ())
        due, pairs = self.mature().withColumns(by or {}), self.pairs.withColumns(by or {})
        lineage = mixed_lineage(due, by=names).select(*names, F.lit("lineage").alias("problem"), F.col("field").alias("detail"))
        definitions = mixed_lineage(pairs, ["label_definition_version"], names).select(
            *names, F.lit("label_definition").alias("problem"), F.col("field").alias("detail"))
        months = cohort(due, self.policy, names).where("NOT acceptable").select(
            *names, F.lit("cohort").alias("problem"), F.col("utc_months").alias("detail"))
        scores = score_audit(pairs, "probability", names).where("bad_scores > 0").select(
            *names, F.lit("probability").alias("problem"), F.col("bad_scores").cast("string").alias("detail"))
        return lineage.unionByName(definitions).unionByName(months).unionByName(scores)

    def report(self, by: Mapping[str, Column] | None = None) -> DataFrame:
        """One row per cohort (`by`: name and expression over the fields of a prediction; labels without prediction fall
        under null). A cohort that may not be evaluated as one is refused: its status is not_available, `reasons` says why, and
        metrics are null, as they are until the evidence is sufficient."""
        names = list(by or ())
        rows, pairs = self.rows, self.pairs.withColumns(by or {})
        if by:
            rows = rows.select("*", "prediction.*").withColumns(by)
        counts = reconciliation_counts(rows, self.policy, names)
        ranking = ranking_metrics(pairs, "label", "probability", names).drop("n", "n_positive", "bad_scores")
        at = threshold_metrics(pairs, "label", "probability", F.col("decision_threshold"), names)
        reasons = self.problems(by).groupBy(*names).agg(
            F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("reasons"))  # a handful of kinds
        joined = counts
        for other in (ranking, at, reasons):
            joined = join_groups(joined, other, names, "left")
        metrics = ("average_precision", "roc_auc", "precision", "recall", "f1", "brier_score", "tn", "fp", "fn", "tp")
        refused = F.coalesce("reasons", F.lit("")) != ""
        earned = (F.col("status") == "stable") & ~refused
        return joined.select(
            F.lit(self.origin).alias("data_origin"), F.lit(self.as_of).alias("as_of"), *[c for c in counts.columns if c != "status"],
            F.when(refused, "not_available").otherwise(F.col("status")).alias("status"),
            F.coalesce("reasons", F.lit("")).alias("reasons"), *[F.when(earned, F.col(m)).alias(m) for m in metrics])

    def calibration(self) -> DataFrame:
        return calibration_table(self.pairs, "label", "probability", self.policy.calibration_edges)

    def selected_revisions(self) -> DataFrame:
        return self.pairs.select("prediction_id", "label_revision")
