"""Delayed labels: which prediction got which label, and what became of the rest.

Every id is collapsed map-side before it is shuffled, so repeated ids cost
nothing downstream and after that each side has one row per id. Both sides come
out of their aggregation partitioned by id, and the join reuses that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwatch.config import DATA_ORIGINS, LabelPolicy, PolicyError, as_dict
from tarnwatch.functions.expressions import month_index, safe_ratio

LINEAGE = (
    "model_version", "model_bundle_sha256", "schema_version", "threshold_version", "risk_policy_version",
    "decision_threshold",
)


def collapsed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., copies, conflict, content): one row per key.

    All copies agree exactly when the smallest content equals the largest one. Contents are sorted before they are collapsed, so
    rows first go to parts of bounded size: a part of a file holds as many as it packs. They are dealt by all columns, not by the
    key alone, so that an id with very many copies is still split and collapsed in many tasks.
    """
    rest = [c for c in df.columns if c not in key]
    content = F.struct(*[F.col(f"`{c}`") for c in rest])
    return df.hint("rebalance", *df.columns).groupBy(*key).agg(
        F.count(F.lit(1)).alias("copies"), F.min(content).alias("content"), F.max(content).alias("__largest"),
    ).select(*key, "copies", (~F.col("content").eqNullSafe(F.col("__largest"))).alias("conflict"), "content")


def is_visible(as_of: Column) -> Column:
    return F.col("received_at") <= as_of


def visible(labels: DataFrame, as_of: Column) -> DataFrame:
    return labels.where(is_visible(as_of))


def mature(prediction_at: Column, as_of: Column, policy: LabelPolicy) -> Column:
    delay = F.expr(f"make_dt_interval({policy.maturity_days}, {policy.grace_hours})")
    return prediction_at + delay <= as_of


def unique_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions without repeats; ids with differing copies are dropped whole."""
    return collapsed(predictions, ["prediction_id"]).where(~F.col("conflict")).select("prediction_id", "content.*")


def label_history(labels: DataFrame, as_of: Column) -> DataFrame:
    """One row per id: latest surviving revision, repeats and conflicts of all revisions."""
    revisions = collapsed(visible(labels, as_of), ["prediction_id", "label_revision"])
    kept = F.when(~F.col("conflict"), F.struct("label_revision", "content"))
    return revisions.groupBy("prediction_id").agg(
        F.max(kept).alias("latest"),
        F.sum(F.when(~F.col("conflict"), F.col("copies") - 1).otherwise(0)).alias("duplicate_labels"),
        F.sum(F.when(F.col("conflict"), F.col("copies")).otherwise(0)).alias("conflicting_labels"),
    )


def latest_labels(labels: DataFrame, as_of: Column) -> DataFrame:
    history = label_history(labels, as_of).where(F.col("latest").isNotNull())
    return history.select("prediction_id", "latest.label_revision", "latest.content.*")


def reconciled(predictions: DataFrame, labels: DataFrame, as_of: Column, policy: LabelPolicy = LabelPolicy()) -> DataFrame:
    """One row per id of either side, with its state and its share of every count.

    prediction / label are null where that side has nothing usable. State:
    matched, unmatched, immature, conflicting or none (a label without prediction).
    """
    p = collapsed(predictions, ["prediction_id"]).select(
        "prediction_id", F.col("copies").alias("__copies"), F.col("conflict").alias("__conflict"),
        F.when(~F.col("conflict"), F.col("content")).alias("prediction"))
    both = p.join(label_history(labels, as_of), "prediction_id", "full_outer")
    label = F.col("latest.content")
    same = (
        (F.col("prediction.entity_key") == label["entity_key"]) & (F.col("prediction.key_id") == label["key_id"]))
    due = mature(F.col("prediction.prediction_at"), as_of, policy)
    state = (
        F.when(F.col("__conflict"), "conflicting").when(F.col("prediction").isNull(), "none")
        .when(~due, "immature").when(F.coalesce(same, F.lit(False)), "matched").otherwise("unmatched"))
    spare = F.coalesce(F.col("__copies") - 1, F.lit(0))
    return both.select(
        "prediction_id", state.alias("state"), "prediction", label.alias("label"),
        F.col("latest.label_revision").alias("label_revision"),
        F.when(F.col("__conflict"), 0).otherwise(spare).cast("long").alias("duplicate_predictions"),
        F.when(F.col("__conflict"), spare).otherwise(0).cast("long").alias("conflicting_predictions"),
        F.coalesce("duplicate_labels", F.lit(0)).cast("long").alias("duplicate_labels"),
        F.coalesce("conflicting_labels", F.lit(0)).cast("long").alias("conflicting_labels"),
    )


def matched_pairs(rows: DataFrame, label_column: str = "churned_within_horizon") -> DataFrame:
    """Matched rows flat: all prediction fields, the label and its revision."""
    return rows.where(F.col("state") == "matched").select(
        "prediction_id", "prediction.*", F.col(f"label.{label_column}").cast("int").alias("label"),
        "label_revision", F.col("label.label_definition_version").alias("label_definition_version"))


def unmatched_predictions(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("state") == "unmatched").select("prediction_id", "prediction.*")


def unmatched_labels(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("state") != "matched") & F.col("label").isNotNull()).select(
        "prediction_id", "label_revision", "label.*")


def evidence_status(matched: Column, coverage: Column, policy: LabelPolicy) -> Column:
    return (
        F.when(matched == 0, "not_available")
        .when((matched < policy.minimum_labels) | (coverage < policy.minimum_coverage), "insufficient_data")
        .otherwise("stable"))


def reconciliation_counts(rows: DataFrame, policy: LabelPolicy = LabelPolicy(), by: Sequence[str] = ()) -> DataFrame:
    """All counts, coverage and evidence status in one aggregate."""
    state = F.col("state")
    counts = rows.groupBy(*by).agg(
        F.count_if(state.isin("matched", "unmatched")).alias("mature_predictions"),
        F.count_if(state == "matched").alias("joined_labels"),
        F.count_if(state == "unmatched").alias("unmatched_predictions"),
        F.count_if((state != "matched") & F.col("label").isNotNull()).alias("unmatched_labels"),
        F.count_if(state == "immature").alias("immature_predictions"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
            "duplicate_predictions", "duplicate_labels", "conflicting_predictions", "conflicting_labels")],
    )
    coverage = safe_ratio(F.col("joined_labels"), F.col("mature_predictions"))
    return counts.withColumn("coverage", coverage).withColumn(
        "status", evidence_status(F.col("joined_labels"), F.col("coverage"), policy))


def mixed_lineage(rows: DataFrame, fields: Sequence[str] = LINEAGE, by: Sequence[str] = ()) -> DataFrame:
    """Lineage fields that take more than one value in a group of predictions, null being one: (by..., field)."""
    extremes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *[
        x for f in fields for x in (F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"), F.count(f).alias(f"n_{f}"))])
    marks = F.array(*[
        F.when((F.col(f"lo_{f}") != F.col(f"hi_{f}")) | F.col(f"n_{f}").between(1, F.col("__n") - 1), F.lit(f)) for f in fields])
    return extremes.select(*by, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("field"))


def cohort(predictions: DataFrame, policy: LabelPolicy = LabelPolicy(), by: Sequence[str] = ()) -> DataFrame:
    """UTC months of a cohort: kind, first and last month, contiguous and short enough or not."""
    at = F.col("prediction_at")
    months = predictions.groupBy(*by, F.date_format(at, "yyyy-MM").alias("__month"), month_index(at).alias("__month_no")).agg(
        F.count(F.lit(1)).alias("__n"))
    span = F.max("__month_no") - F.min("__month_no") + 1
    return months.groupBy(*by).agg(
        F.when(F.count("__month") <= 1, "monthly").otherwise("rolling").alias("kind"),
        F.concat_ws(",", F.array_sort(F.collect_list("__month"))).alias("utc_months"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("prediction_count"),
        ((F.count("__month") == F.coalesce(span, F.lit(0))) & (F.count("__month") <= policy.maximum_months)).alias("acceptable"),
    )


def month_gaps(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Months with their distance to the month before."""
    at = F.col("prediction_at")
    months = predictions.groupBy(*by, month_index(at).alias("month_no"), F.date_format(at, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    # One row per calendar month: a window this small needs no splitting.
    return months.withColumn("gap", F.col("month_no") - F.lag("month_no").over(Window.partitionBy(*by).orderBy("month_no")))


def lineage_summary(pairs: DataFrame) -> DataFrame:
    """The cohort's serving lineage (after `mixed_lineage` found nothing) and its label definitions."""
    return pairs.agg(
        *[F.min(f).alias(f) for f in LINEAGE],
        F.concat_ws(",", F.array_sort(F.collect_set("label_definition_version"))).alias("label_definition_versions"))


def input_key(predictions: DataFrame, labels: DataFrame, policy: LabelPolicy, as_of: str, origin: str) -> DataFrame:
    """Content key of a run: same inputs in any order and layout give the same key."""
    def fingerprint(df: DataFrame, name: str) -> DataFrame:
        h = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).alias("h"))
        return h.agg(F.concat_ws(
            ":", F.lit(name), F.count(F.lit(1)).cast("string"), F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string"),
            F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")).alias(name), F.lit(1).alias("one"))

    settings = "|".join(f"{k}={v}" for k, v in sorted(as_dict(policy).items()))
    return fingerprint(predictions, "predictions").join(fingerprint(labels, "labels"), "one").select(
        F.sha2(F.concat_ws("|", "predictions", "labels", F.lit(settings), F.lit(as_of), F.lit(origin)), 256).alias("input_key"))


def check_origin(origin: str, policy: LabelPolicy) -> None:
    if origin not in DATA_ORIGINS:
        raise PolicyError("data origin is unsupported")
    if origin == "production" and not policy.allow_production:
        raise PolicyError("production origin needs an approved policy")


def current_predictions(predictions: DataFrame, entity: Sequence[str]) -> DataFrame:
    """One prediction per unit, the latest one, and how many it superseded. The unit of the policy is entity, model version and
    horizon; `entity` names its columns."""
    rest = [c for c in predictions.columns if c not in entity]
    newest = F.struct("prediction_at", "prediction_id")
    return predictions.groupBy(*entity).agg(
        F.max_by(F.struct(*rest), newest).alias("p"), (F.count(F.lit(1)) - 1).alias("superseded"),
    ).select(*entity, "p.*", "superseded")
