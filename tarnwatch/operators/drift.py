"""Data quality and distribution drift of many windows against a frozen profile.

All numeric features of all windows are measured in one scan and one small
shuffle: the long form is pre-aggregated map-side to one row per (window,
feature) that already holds the histogram. Categorical features take a second
scan, grouped by category.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException, PythonException
from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwatch.config import MISSING_CATEGORY, UNKNOWN_CATEGORY, DriftPolicy, as_dict
from tarnwatch.functions.expressions import ladder, worst, worst_of
from tarnwatch.functions.special import chi_square_p
from tarnwatch.operators.profile import (
    PROBABILITY_EDGES,
    Profile,
    binned,
    category_counts,
    count_array,
    prediction_histogram,
)
from tarnwatch.plans.freeze import freeze
from tarnwatch.plans.ordering import assign_parts

# --- fixed values: columns a window may carry beside its features ---
TOLERATED_COLUMNS = ("id", "customerID", "Churn")
# --- fixed values: SQL state classes of data exceptions, of failing functions and of errors raised by a query itself ---
VALUE_STATES = ("22", "38", "39", "P0")


def array_total(values: str) -> str:
    return f"aggregate({values}, 0D, (a, x) -> a + x)"


def psi(reference: str, current: str, epsilon: float) -> Column:
    """Population stability index of two count-array columns over the same bins."""
    r = f"r / greatest({array_total(reference)}, 1D)"
    c = f"c / greatest({array_total(current)}, 1D)"
    eps = f"CAST({epsilon!r} AS double)"
    terms = f"zip_with({reference}, {current}, (r, c) -> ({c} - {r}) * ln(({c} + {eps}) / ({r} + {eps})))"
    return F.expr(array_total(terms))


def binned_wasserstein(reference: str, current: str, edges: str) -> Column:
    """First Wasserstein distance with all mass at bin midpoints; null without mass."""
    r_total, c_total = array_total(reference), array_total(current)
    r_cdf = f"{array_total(f'slice({reference}, 1, i)')} / {r_total}"
    c_cdf = f"{array_total(f'slice({current}, 1, i)')} / {c_total}"
    # Midpoints i and i + 1 are half of edge[i + 1] - edge[i - 1] apart.
    step = f"abs({r_cdf} - {c_cdf}) * (get({edges}, i + 1) - get({edges}, i - 1)) / 2"
    steps = f"transform(sequence(1, greatest(size({reference}) - 1, 1)), i -> {step})"
    return F.expr(f"""
        CASE WHEN {r_total} > 0 AND {c_total} > 0 THEN
          CASE WHEN size({reference}) > 1 THEN {array_total(steps)} ELSE 0D END END""")


# --- quality ---------------------------------------------------------------

def numeric_counts(windows: DataFrame, profile: Profile, by: Sequence[str]) -> DataFrame:
    """Validity and bin counts: (by..., feature, bin, rows, missing, invalid, n, out_of_range).

    Plain counts, so they can be taken on a stream as well and added up later.
    """
    edges = profile.edges()

    def outside(row: dict) -> Column:
        value = F.col(f"`{row['feature']}__value`")
        return (value < row["min"]) | (value > row["max"])

    cells = binned(windows, edges, by, extra={row["feature"]: outside(row) for row in profile.numeric})
    return cells.groupBy(*by, "feature", "bin").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("missing")).alias("missing"),
        F.count_if(F.col("invalid")).alias("invalid"),
        F.count("value").alias("n"),
        F.count_if(F.col("flag")).alias("out_of_range"),
    )


def _rate(count: str) -> Column:
    return F.col(count) / F.col("n")


def _quality_status(increases: Sequence[Column], policy: DriftPolicy) -> Column:
    return ladder(F.greatest(F.lit(0.0), *increases), policy.quality_increase)


def numeric_evidence(counts: DataFrame, profile: Profile, policy: DriftPolicy, by: Sequence[str]) -> DataFrame:
    """PSI and Wasserstein distance from `numeric_counts`, one row per window and feature."""
    counts = counts.groupBy(*by, "feature").agg(
        F.sum("rows").alias("n"), F.sum("missing").alias("n_missing"), F.sum("invalid").alias("n_invalid"),
        F.sum("n").alias("n_valid"), F.sum("out_of_range").alias("n_out_of_range"),
        count_array(max(len(e) for e in profile.edges().values()) - 1).alias("all_counts"))
    frozen = profile.numeric_table().select(
        "feature", F.col("missing_rate").alias("baseline_missing_rate"), "edges",
        F.transform("counts", lambda c: c.cast("double")).alias("reference"))
    rows = counts.join(F.broadcast(frozen), "feature").withColumn(
        "current", F.transform(F.slice("all_counts", 1, F.size("edges") - 1), lambda c: c.cast("double")))
    enough = F.col("n_valid") >= policy.minimum_sample_size
    span = F.greatest(F.element_at("edges", -1) - F.get("edges", F.lit(0)), F.lit(1.0))
    measured = rows.select(
        *by, "feature", F.lit("numeric").alias("kind"), "n", "n_valid", "baseline_missing_rate",
        _rate("n_missing").alias("missing_rate"), _rate("n_invalid").alias("invalid_rate"),
        F.lit(0.0).alias("unknown_rate"), _rate("n_out_of_range").alias("out_of_range_rate"),
        (F.col("n_valid") - F.expr(f"CAST({array_total('current')} AS long)")).alias("n_outside"),
        F.when(enough, psi("reference", "current", policy.epsilon)).alias("psi"),
        F.when(enough, binned_wasserstein("reference", "current", "edges")).alias("wasserstein"),
        span.alias("span"), enough.alias("enough"),
    ).withColumn("wasserstein_normalized", F.col("wasserstein") / F.col("span"))
    none = F.lit(None).cast("double")
    return measured.select(
        *by, "feature", "kind", "n", "n_valid", "missing_rate", "invalid_rate", "unknown_rate", "out_of_range_rate",
        "n_outside", "psi", "wasserstein", "wasserstein_normalized",
        none.alias("jensen_shannon"), none.alias("chi_square"), F.lit(None).cast("long").alias("chi_square_degrees"),
        _quality_status(
            [F.col("missing_rate") - F.col("baseline_missing_rate"), F.col("invalid_rate"), F.col("out_of_range_rate")],
            policy).alias("quality_status"),
        F.when(F.col("enough"), worst_of(
            ladder(F.col("psi"), policy.psi), ladder(F.col("wasserstein_normalized"), policy.wasserstein)))
        .otherwise("insufficient_data").alias("distribution_status"),
        F.lit("not_applicable").alias("ks_status"),
    )


def categorical_evidence(counts: DataFrame, profile: Profile, policy: DriftPolicy, by: Sequence[str]) -> DataFrame:
    """Jensen-Shannon and chi-square per window and feature, from `category_counts`.

    Categories absent from a window are never materialised: their part of every
    sum follows from the reference mass that was not met.
    """
    frozen = profile.categorical_table().select(
        "feature", F.col("n").alias("reference_n"), F.col("missing_rate").alias("baseline_missing_rate"),
        "n_categories", "smallest", "literal_unknown")
    known = profile.categories.select("feature", "category", F.col("n").alias("r"))
    counts = counts.join(known, ["feature", "category"], "left")
    is_unknown = F.col("r").isNull()
    # A known category that is literally called like the unknown cell is counted in no cell.
    in_cell = ~is_unknown & (F.col("category") != UNKNOWN_CATEGORY)
    totals = counts.groupBy(*by, "feature").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("category") == MISSING_CATEGORY, F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(is_unknown, F.col("n")).otherwise(0)).alias("n_unknown"),
        F.sum(F.when(in_cell, F.col("n")).otherwise(0)).alias("n_known"),
    ).withColumn("cells_n", F.col("n_known") + F.col("n_unknown"))
    # (window, feature) totals next to per-category counts; AQE broadcasts the
    # totals when they are small and splits skewed features when they are not.
    p, q = F.col("r") / F.col("reference_n"), F.col("n") / F.col("cells_n")
    middle = (p + q) / 2
    expected = p * F.col("cells_n")
    met = (
        counts.where(in_cell).select(*by, "feature", "n", "r")
        .join(totals.select(*by, "feature", "cells_n"), [*by, "feature"])
        .join(F.broadcast(frozen.select("feature", "reference_n")), "feature")
        .groupBy(*by, "feature")
        .agg(
            F.sum(p * F.ln(p / middle) + q * F.ln(q / middle)).alias("met_divergence"),
            F.sum(p).alias("met_mass"),
            F.sum((F.col("n") - expected) * (F.col("n") - expected) / expected).alias("met_chi"),
        )
    )
    rows = totals.join(met, [*by, "feature"], "left").join(F.broadcast(frozen), "feature")
    zero = F.lit(0.0)
    u_q = F.col("n_unknown") / F.col("cells_n")
    u_p = F.col("literal_unknown") / F.col("reference_n")
    u_m = (u_p + u_q) / 2
    unknown_divergence = (
        F.when(u_p > 0, u_p * F.ln(u_p / u_m)).otherwise(zero) + F.when(u_q > 0, u_q * F.ln(u_q / u_m)).otherwise(zero))
    met_mass = F.coalesce("met_mass", zero)
    missed_mass = F.greatest(zero, 1 - met_mass - u_p)
    # Where every category was met, what is left of 1 is rounding noise.
    missed_mass = F.when(missed_mass > 1e-12, missed_mass).otherwise(zero)
    divergence = F.coalesce("met_divergence", zero) + unknown_divergence + missed_mass * math.log(2)
    u_expected = u_p * F.col("cells_n")
    chi = (
        F.coalesce("met_chi", zero) + missed_mass * F.col("cells_n")
        + F.when(u_p > 0, (F.col("n_unknown") - u_expected) * (F.col("n_unknown") - u_expected) / u_expected).otherwise(zero))
    cells = F.col("n_categories") + F.when((F.col("literal_unknown") == 0) & (F.col("n_unknown") > 0), 1).otherwise(0)
    eligible = (
        (F.col("smallest") / F.col("reference_n") * F.col("cells_n") >= 5) & (cells > 1)
        & ((F.col("literal_unknown") > 0) | (F.lit(not policy.strict_unknown) & (F.col("n_unknown") == 0))))
    none = F.lit(None).cast("double")
    measured = rows.select(
        *by, "feature", F.lit("categorical").alias("kind"), F.col("rows").alias("n"),
        F.col("cells_n").alias("n_valid"),
        (F.col("n_missing") / F.col("rows")).alias("missing_rate"), zero.alias("invalid_rate"),
        (F.col("n_unknown") / F.col("rows")).alias("unknown_rate"), zero.alias("out_of_range_rate"),
        F.lit(0).cast("long").alias("n_outside"), none.alias("psi"), none.alias("wasserstein"),
        none.alias("wasserstein_normalized"),
        F.when(F.col("cells_n") > 0, F.sqrt(F.greatest(zero, divergence / 2))).alias("jensen_shannon"),
        F.when(eligible, chi).alias("chi_square"), F.when(eligible, (cells - 1).cast("long")).alias("chi_square_degrees"),
        "baseline_missing_rate",
    )
    return measured.select(
        *[c for c in measured.columns if c != "baseline_missing_rate"],
        _quality_status([F.col("missing_rate") - F.col("baseline_missing_rate"), F.col("unknown_rate")], policy)
        .alias("quality_status"),
        ladder(F.col("jensen_shannon"), policy.jensen_shannon).alias("distribution_status"),
        F.lit("not_applicable").alias("ks_status"),
    )


# --- multiple testing --------------------------------------------------------

def adjust_p_values(rows: DataFrame, p_value: str, by: Sequence[str], out: str = "adjusted_p_value", tie: str = "feature") -> DataFrame:
    """Benjamini-Hochberg within each group, over rows that have a p-value.

    A group is one run's features, so its windows are bounded by the schema.
    """
    p = F.col(p_value)
    tests = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(p.asc_nulls_last(), tie))
    scaled = rows.withColumn("__m", tests).withColumn("__rank", rank).withColumn(
        "__scaled", F.when(p.isNotNull(), p * F.col("__m") / F.col("__rank")))
    upward = Window.partitionBy(*by).orderBy("__rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return scaled.withColumn(
        out, F.when(p.isNotNull(), F.least(F.lit(1.0), F.min("__scaled").over(upward)))
    ).drop("__m", "__rank", "__scaled")


# --- assembled results -------------------------------------------------------

def feature_evidence(windows: DataFrame, profile: Profile, policy: DriftPolicy = DriftPolicy(), by: Sequence[str] = ("window_id",)) -> DataFrame:
    """Quality and drift of every feature in every window, one row each."""
    parts = []
    if profile.numeric_features:
        parts.append(numeric_evidence(numeric_counts(windows, profile, by), profile, policy, by))
    if profile.categorical_features:
        counts = category_counts(windows, profile.categorical_features, by)
        parts.append(categorical_evidence(counts, profile, policy, by))
    return with_status(parts, by)


def with_status(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Numeric and categorical evidence together, p-values adjusted, overall status set."""
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("p_value", chi_square_p(F.col("chi_square"), F.col("chi_square_degrees")))
    rows = adjust_p_values(rows, "p_value", by)
    return rows.withColumn("status", worst_of(F.col("quality_status"), F.col("distribution_status")))


def run_status(
    features: DataFrame, window_sizes: DataFrame, policy: DriftPolicy = DriftPolicy(),
    by: Sequence[str] = ("window_id",), prediction: DataFrame | None = None,
) -> DataFrame:
    """One row per window: worst status, or insufficient_data for a small window."""
    statuses = features.select(*by, "status")
    if prediction is not None:
        statuses = statuses.unionByName(prediction.select(*by, "status"))
    worst_status = statuses.groupBy(*by).agg(worst(F.col("status")).alias("worst"))
    return window_sizes.join(worst_status, list(by), "left").select(
        *by, F.col("n").alias("sample_size"),
        F.when(F.col("n") < policy.minimum_sample_size, "insufficient_data")
        .otherwise(F.coalesce("worst", F.lit("stable"))).alias("run_status"),
    )


def method_rows(features: DataFrame, by: Sequence[str] = ("window_id",)) -> DataFrame:
    """Evidence in tidy form: one row per window, feature and method."""
    def method(name: str, effect: str, p: str | None = None, adjusted: str | None = None) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(
            F.lit(name).alias("method"), F.col(effect).alias("effect_size"),
            (F.col(p) if p else none).alias("p_value"), (F.col(adjusted) if adjusted else none).alias("adjusted_p_value"))

    methods = F.array(
        method("psi", "psi"), method("wasserstein", "wasserstein"),
        method("wasserstein_normalized", "wasserstein_normalized"), method("jensen_shannon", "jensen_shannon"),
        method("chi_square", "chi_square", "p_value", "adjusted_p_value"))
    return features.select(*by, "feature", "kind", "n_valid", "status", F.inline(methods)).where(
        F.col("effect_size").isNotNull())


def prediction_drift(
    reference: DataFrame, current: DataFrame, probability: str, *, threshold: float, low: float, high: float,
    by: Sequence[str] = ("window_id",), policy: DriftPolicy = DriftPolicy(), edges: Sequence[float] = PROBABILITY_EDGES,
) -> DataFrame:
    """PSI of scores per window against one reference population."""
    now = prediction_histogram(current, probability, threshold=threshold, low=low, high=high, by=by, edges=edges)
    base = prediction_histogram(reference, probability, threshold=threshold, low=low, high=high, edges=edges)
    # The reference side is a single aggregate row, joined on a constant.
    paired = now.select("*", F.lit(1).alias("__one")).join(
        F.broadcast(base.select(F.lit(1).alias("__one"), F.col("counts").alias("reference"))), "__one")
    return histogram_drift(paired, by, policy)


def histogram_drift(paired: DataFrame, by: Sequence[str], policy: DriftPolicy) -> DataFrame:
    """PSI and status of rows of `prediction_histogram` that carry the counts they are held against as `reference`."""
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    paired = paired.withColumn("current", as_double(F.col("counts"))).withColumn("reference", as_double(F.col("reference")))
    measured = paired.withColumn("psi", psi("reference", "current", policy.epsilon))
    return measured.select(
        *by, "n", "n_invalid", "psi", "mean", "positive_rate", "n_safe", "n_low", "n_medium", "n_high",
        F.when(F.col("n_invalid") > 0, "unknown").otherwise(ladder(F.col("psi"), policy.psi)).alias("status"))


@dataclass(frozen=True)
class DriftRun:
    features: DataFrame
    runs: DataFrame
    predictions: DataFrame | None = None


def monitor(
    windows: DataFrame, profile: Profile, *, by: Sequence[str] = ("window_id",), policy: DriftPolicy = DriftPolicy(),
    reference_scores: DataFrame | None = None, probability: str | None = None,
    threshold: float = 0.5, low: float = 0.2, high: float = 0.7,
) -> DriftRun:
    """Full run over any number of windows."""
    features = feature_evidence(windows, profile, policy, by)
    predictions = None
    if probability is not None and reference_scores is not None:
        predictions = prediction_drift(
            reference_scores, windows, probability, threshold=threshold, low=low, high=high, by=by, policy=policy)
    sizes = windows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    small = features.join(sizes.select(*by, F.col("n").alias("window_n")), list(by)).where(
        F.col("window_n") >= policy.minimum_sample_size).drop("window_n")
    return DriftRun(small, run_status(small, sizes, policy, by, predictions), predictions)


def window_problems(windows: DataFrame, profile: Profile, by: Sequence[str] = ("window_id",)) -> list[str]:
    """Schema reasons why a window cannot be measured. Reads no rows."""
    columns = set(windows.columns)
    missing = set(profile.features) - columns
    extra = columns - set(profile.features) - set(by) - set(TOLERATED_COLUMNS)
    return [f"missing:{c}" for c in sorted(missing)] + [f"unexpected:{c}" for c in sorted(extra)]


def caused_by_values(error: PySparkException) -> bool:
    """Whether values could not be read or computed. Lost executors, missing files and the like are no evidence about a window."""
    while error is not None:        # a failed write hides what failed as its cause
        if isinstance(error, PythonException) or (error.getSqlState() or "").startswith(VALUE_STATES):
            return True
        error = getattr(error, "_cause", None)
    return False


def checked_monitor(
    windows: DataFrame, profile: Profile, *, by: Sequence[str] = ("window_id",), policy: DriftPolicy = DriftPolicy(),
    profile_reasons: Sequence[str] = (), score_column: str | None = None, **scores,
) -> DataFrame:
    """Run rows with an error class: unsafe prerequisites and values that cannot be read give `unknown` for all windows
    (`monitoring.monitoring_run` tells the windows apart). Lost executors and missing files are raised."""
    def failed(reason: str) -> DataFrame:
        present = [c for c in by if c in windows.columns]
        ids = windows.select(*present).distinct() if present else windows.sparkSession.range(1).select()
        for c in by:
            if c not in present:
                ids = ids.withColumn(c, F.lit(None).cast("string"))
        return ids.select(*by, F.lit(None).cast("long").alias("sample_size"), F.lit("unknown").alias("run_status"),
                          F.lit(reason).alias("error_class"))

    if profile_reasons:
        return failed("baseline_incompatible")
    allowed = [c for c in windows.columns if c != score_column]
    if window_problems(windows.select(*allowed), profile, by):
        return failed("current_window_incompatible")
    try:
        # Measured here, so that what fails while it runs is evidence of an unusable run as well, not a crash later on.
        runs = freeze(monitor(windows, profile, by=by, policy=policy, **scores).runs, "runs")
    except PySparkException as error:
        if not caused_by_values(error):
            raise
        return failed("monitoring_failure")
    return runs.withColumn("error_class", F.lit(None).cast("string"))


def result_document(run: DriftRun, profile: Profile, profile_id: str, policy: DriftPolicy, by: Sequence[str] = ("window_id",)) -> DataFrame:
    """One JSON document per window. A window holds at most one entry per feature."""
    entries = run.features.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(
        "feature", "kind", "status", "quality_status", "distribution_status", "missing_rate", "invalid_rate",
        "unknown_rate", "out_of_range_rate", "psi", "wasserstein", "wasserstein_normalized", "jensen_shannon",
        "chi_square", "p_value", "adjusted_p_value"))).alias("features"))
    lineage = {"profile_id": profile_id, **profile.lineage}
    config = {k: str(v) for k, v in as_dict(policy).items()}
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])
    return run.runs.join(entries, list(by), "left").select(
        *by, "run_status", F.to_json(F.struct(
            "run_status", "sample_size", as_map(lineage).alias("lineage"), as_map(config).alias("config"),
            "features")).alias("document"))


# --- raw-reference measures ----------------------------------------------------

def bounded_sample(windows: DataFrame, key: Sequence[str], cap: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """All rows of a window up to `cap`, else exactly `cap` seeded ones (a scoring budget, not a skew escape)."""
    cut = F.array(F.lit(cap).cast("long"))
    return assign_parts(windows, key=key, seed=seed, cuts=cut, by=by, out="__part").where("__part = 0").drop("__part")
