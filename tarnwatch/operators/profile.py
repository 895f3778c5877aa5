"""Frozen reference profiles: what a population looked like, without its rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tarnwatch.config import MISSING_CATEGORY, RISK_BANDS, UNKNOWN_CATEGORY, PolicyError
from tarnwatch.functions.expressions import number_from_text, risk_band, valid_probability
from tarnwatch.plans.freeze import freeze
from tarnwatch.plans.longform import melt
from tarnwatch.plans.ordering import quantiles

# --- fixed values: what a numeric profile records ---
SUMMARY_PROBS = {
    "min": 0.0, "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1.0,
}
DECILES = tuple(i / 10 for i in range(11))
PROBABILITY_EDGES = tuple(round(i / 10, 1) for i in range(11))
PROFILE_VERSION = "profile/v1"
# ----------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """A frozen reference.

    What there is once per column (edges, counts, moments) is held as plain rows:
    its size is bounded by the schema. Categories are a written table, because a
    column may have any number of them.

    numeric:     feature, n, missing_rate, mean, std, min..max, edges, counts
    categorical: feature, n, missing_rate, n_categories, smallest, literal_unknown
    categories:  feature, category, n
    """

    numeric: tuple[dict, ...]
    categorical: tuple[dict, ...]
    categories: DataFrame
    lineage: Mapping[str, str] = field(default_factory=dict)

    @property
    def numeric_features(self) -> tuple[str, ...]:
        return tuple(row["feature"] for row in self.numeric)

    @property
    def categorical_features(self) -> tuple[str, ...]:
        return tuple(row["feature"] for row in self.categorical)

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numeric_features, *self.categorical_features)

    def edges(self) -> dict[str, list[float]]:
        return {row["feature"]: list(row["edges"]) for row in self.numeric}

    def numeric_table(self) -> DataFrame:
        return self.categories.sparkSession.createDataFrame([dict(r) for r in self.numeric], NUMERIC_SCHEMA)

    def categorical_table(self) -> DataFrame:
        return self.categories.sparkSession.createDataFrame([dict(r) for r in self.categorical], CATEGORICAL_SCHEMA)


def default_kinds(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Numeric and categorical columns by declared type, identifiers left out."""
    kept = [f for f in df.schema.fields if f.name not in exclude]
    numeric = tuple(f.name for f in kept if isinstance(f.dataType, T.NumericType))
    return numeric, tuple(f.name for f in kept if f.name not in numeric)


def numeric_parts(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(missing, value) of one numeric feature, from numbers or from text.

    In a number column NaN is missing. In a text column only null is, and text
    that is no number is invalid: neither missing nor a value.
    """
    raw = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return raw.isNull(), number_from_text(raw)
    number = raw.cast("double")
    missing = raw.isNull() | F.isnan(number)
    return missing, F.when(~missing, number + F.lit(0.0))


def category_cell(name: str) -> Column:
    raw = F.col(f"`{name}`").cast("string")
    return F.struct(raw.isNull().alias("missing"), F.coalesce(raw, F.lit(MISSING_CATEGORY)).alias("category"))


def numeric_summary(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, missing rate, mean and population deviation of every numeric feature."""
    parts = {f: numeric_parts(df, f) for f in features}
    cells = melt(df, by, {f: F.struct(m.alias("missing"), v.alias("value")) for f, (m, v) in parts.items()})
    return cells.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("missing").cast("double")).alias("missing_rate"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    )


def numeric_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return quantiles(df, {f: numeric_parts(df, f)[1] for f in features}, probs, by=by)


def frozen_edges(deciles: Sequence[float]) -> list[float]:
    """Distinct deciles at 8 decimals; a constant gets one bin of width 1."""
    edges = sorted({round(float(v), 8) for v in deciles})
    return edges if len(edges) > 1 else [edges[0], edges[0] + 1.0]


def right_closed_splits(edges: Sequence[float]) -> list[float]:
    """Bucketizer splits (closed left) that give (a, b] bins, the first one [a, b].

    Bucket 0 is below the edges, the last one above, bin i is bucket i + 1.
    """
    uppers = [math.nextafter(e, math.inf) for e in edges[1:]]
    return [-math.inf, edges[0], *uppers, math.inf]


def binned(df: DataFrame, edges: Mapping[str, Sequence[float]], by: Sequence[str], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """(by..., feature, missing, invalid, value, bin[, flag]); `bin` is null outside the edges.

    Values are parsed once, into columns `<feature>__value` that `extra` may refer to.
    """
    features = list(edges)
    parts = {f: numeric_parts(df, f) for f in features}
    base = df.select(*by, *[
        c for f, (missing, value) in parts.items() for c in (missing.alias(f"{f}__missing"), value.alias(f"{f}__value"))])
    placed = Bucketizer(
        inputCols=[f"{f}__value" for f in features], outputCols=[f"{f}__bin" for f in features],
        splitsArray=[right_closed_splits(edges[f]) for f in features], handleInvalid="keep",
    ).transform(base)

    def cell(f: str) -> Column:
        missing, value = F.col(f"`{f}__missing`"), F.col(f"`{f}__value`")
        position = F.col(f"`{f}__bin`").cast("int") - 1
        inside = (position >= 0) & (position < len(edges[f]) - 1)
        fields = [
            missing.alias("missing"), (~missing & value.isNull()).alias("invalid"), value.alias("value"),
            F.when(inside, position).alias("bin")]
        if extra:
            fields.append(extra[f].alias("flag"))
        return F.struct(*fields)

    return melt(placed, by, {f: cell(f) for f in features})


def count_array(bins: int) -> Column:
    """Aggregate over (bin, n) rows of one group: counts as an array, empty bins included."""
    return F.expr(f"array({', '.join(f'coalesce(sum(CASE WHEN bin = {i} THEN n END), 0L)' for i in range(bins))})")


def histogram(df: DataFrame, edges: Mapping[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """Counts over frozen right-closed bins: (by..., feature, counts).

    The scan is pre-aggregated to one row per group and bin; arrays are built
    from those few rows.
    """
    cells = binned(df, edges, by).groupBy(*by, "feature", "bin").agg(F.count("value").alias("n"))
    return cells.groupBy(*by, "feature").agg(count_array(max(len(e) for e in edges.values()) - 1).alias("all_counts")).select(
        *by, "feature", _own_length(edges).alias("counts"))


def _own_length(edges: Mapping[str, Sequence[float]]) -> Column:
    lengths = F.create_map(*[x for f, e in edges.items() for x in (F.lit(f), F.lit(len(e) - 1))])
    return F.slice("all_counts", 1, F.element_at(lengths, F.col("feature")))


def histogram_rows(profile: Profile) -> DataFrame:
    """Tidy bins: (feature, bin_idx, lo, hi, n)."""
    return profile.numeric_table().select(
        "feature", "edges", F.posexplode("counts").alias("bin_idx", "n")
    ).select(
        "feature", "bin_idx", F.get("edges", F.col("bin_idx")).alias("lo"),
        F.get("edges", F.col("bin_idx") + 1).alias("hi"), "n",
    )


def category_counts(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    cells = melt(df, by, {f: category_cell(f) for f in features})
    return cells.groupBy(*by, "feature", "category").agg(F.count(F.lit(1)).alias("n"))


def _category_summary(counts: DataFrame) -> DataFrame:
    n_missing = F.sum(F.when(F.col("category") == MISSING_CATEGORY, F.col("n")).otherwise(0))
    return counts.groupBy("feature").agg(
        F.sum("n").alias("n"),
        (n_missing / F.sum("n")).alias("missing_rate"),
        F.count(F.lit(1)).alias("n_categories"),
        F.min("n").alias("smallest"),
        F.sum(F.when(F.col("category") == UNKNOWN_CATEGORY, F.col("n")).otherwise(0)).alias("literal_unknown"),
    )


NUMERIC_SCHEMA = (
    "feature string, n long, missing_rate double, mean double, std double, "
    + ", ".join(f"{name} double" for name in SUMMARY_PROBS) + ", edges array<double>, counts array<long>"
)
CATEGORICAL_SCHEMA = (
    "feature string, n long, missing_rate double, n_categories long, smallest long, literal_unknown long")


def _rounded(value: float | None) -> float | None:
    return None if value is None else round(value, 8)


def _bin_moments(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> dict[str, list]:
    """Counts and moments per feature and bin in one scan; a dozen rows per feature come back."""
    rows = binned(df, edges, []).groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("missing")).alias("missing"), F.count("value").alias("n"),
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance")).collect()
    found: dict[str, list] = {}
    for row in rows:
        found.setdefault(row["feature"], []).append(row)
    return found


def _numeric_row(feature: str, edges: list[float], cells: list, quantile: Mapping[float, float]) -> dict:
    total = sum(c["rows"] for c in cells)
    filled = [c for c in cells if c["n"]]
    n = sum(c["n"] for c in filled)
    mean = sum(c["n"] * c["mean"] for c in filled) / n
    variance = sum(c["n"] * (c["variance"] + (c["mean"] - mean) ** 2) for c in filled) / n
    by_bin = {c["bin"]: c["n"] for c in cells if c["bin"] is not None}
    return {
        "feature": feature, "n": total, "missing_rate": _rounded(sum(c["missing"] for c in cells) / total),
        "mean": _rounded(mean), "std": _rounded(math.sqrt(variance)),
        **{name: _rounded(quantile[p]) for name, p in SUMMARY_PROBS.items()},
        "edges": edges, "counts": [by_bin.get(i, 0) for i in range(len(edges) - 1)],
    }


def _numeric_reference(df: DataFrame, features: Sequence[str]) -> tuple[dict, ...]:
    probs = sorted({*SUMMARY_PROBS.values(), *DECILES})
    found: dict[str, dict[float, float]] = {}
    for row in numeric_quantiles(df, features, probs).collect():  # len(features) * len(probs) rows
        found.setdefault(row["feature"], {})[row["prob"]] = row["value"]
    empty = [f for f in features if f not in found]
    if empty:
        raise PolicyError(f"numeric features without any value: {', '.join(empty)}")
    edges = {f: frozen_edges([found[f][p] for p in DECILES]) for f in features}
    cells = _bin_moments(df, edges)
    return tuple(_numeric_row(f, edges[f], cells[f], found[f]) for f in features)


def build_profile(
    df: DataFrame, *, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None,
    exclude: Sequence[str] = (), lineage: Mapping[str, str] | None = None,
) -> Profile:
    """Profile a reference population. Runs now: a profile is frozen by definition."""
    if numeric is None or categorical is None:
        by_type = default_kinds(df, exclude)
        numeric = by_type[0] if numeric is None else numeric
        categorical = by_type[1] if categorical is None else categorical
    if not numeric and not categorical:
        raise PolicyError("the reference has no feature columns")
    numeric_rows = _numeric_reference(df, list(numeric)) if numeric else ()
    if not categorical:
        none = df.sparkSession.createDataFrame([], "feature string, category string, n long")
        return Profile(numeric_rows, (), none, dict(lineage or {}))
    categories = freeze(category_counts(df, categorical), "profile-categories")
    found = {r["feature"]: r.asDict() for r in _category_summary(categories).collect()}
    return Profile(numeric_rows, tuple(found[f] for f in categorical), categories, dict(lineage or {}))


def covered(profile: Profile, allowed: Sequence[str]) -> Profile:
    """The part of a profile that covers an allow-list of features."""
    keep = set(allowed)
    return replace(
        profile,
        numeric=tuple(r for r in profile.numeric if r["feature"] in keep),
        categorical=tuple(r for r in profile.categorical if r["feature"] in keep),
        categories=profile.categories.where(F.col("feature").isin(*keep)),
    )


def proportions(profile: Profile) -> DataFrame:
    totals = profile.categorical_table().select("feature", F.col("n").alias("total"))
    return profile.categories.join(F.broadcast(totals), "feature").select(
        "feature", "category", "n", F.round(F.col("n") / F.col("total"), 8).alias("proportion"))


def tidy(profile: Profile) -> DataFrame:
    """The whole profile as one (feature, item, position, value) table, for hashing and export."""
    n = profile.numeric_table()
    scalars = n.select("feature", F.explode(F.create_map(*[
        x for name in ("n", "missing_rate", "mean", "std", *SUMMARY_PROBS)
        for x in (F.lit(name), F.col(name).cast("double"))])).alias("item", "value"))
    arrays = n.select("feature", F.lit("edge").alias("item"), F.posexplode("edges").alias("position", "value")).unionByName(
        n.select("feature", F.lit("bin_count").alias("item"),
                 F.posexplode(F.transform("counts", lambda c: c.cast("double"))).alias("position", "value")))
    cats = profile.categories.select(
        "feature", F.concat(F.lit("category:"), F.col("category")).alias("item"), F.lit(0).alias("position"),
        F.col("n").cast("double").alias("value"))
    return scalars.select("feature", "item", F.lit(0).alias("position"), "value").unionByName(arrays).unionByName(cats)


def profile_identity(profile: Profile) -> DataFrame:
    """One row: content hash over all profile rows in any order, plus lineage."""
    rows = tidy(profile).select(F.xxhash64("feature", "item", "position", "value").alias("h"))
    lineage = F.lit("|".join(f"{k}={v}" for k, v in sorted(profile.lineage.items())))
    return rows.agg(
        F.count(F.lit(1)).alias("profile_rows"),
        F.sha2(F.concat_ws(
            "|", F.lit(PROFILE_VERSION), lineage, F.lit(",".join(profile.features)),
            F.count(F.lit(1)).cast("string"), F.bit_xor("h").cast("string"),
            F.sum(F.col("h").cast("decimal(38,0)")).cast("string")), 256).alias("profile_id"),
    )


# --- prediction reference ---------------------------------------------------

def prediction_histogram(
    scored: DataFrame, probability: str, *, threshold: float, low: float, high: float, by: Sequence[str] = (),
    edges: Sequence[float] = PROBABILITY_EDGES,
) -> DataFrame:
    """Ten fixed bins, mean, positive rate and risk-band counts, one row per group."""
    base = scored.select(*by, F.col(probability).cast("double").alias("p"))
    placed = Bucketizer(
        splits=right_closed_splits(edges), inputCol="p", outputCol="bucket", handleInvalid="keep").transform(base)
    p, n_bins = F.col("p"), len(edges) - 1
    cells = placed.withColumn("bin", F.col("bucket").cast("int") - 1).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(valid_probability(p), p)).alias("total"),
        F.count_if(valid_probability(p)).alias("n_ok"),
        F.count_if(p >= threshold).alias("n_positive"),
        *[F.count_if(risk_band(p, low, threshold, high) == name).alias(f"n_{name.lower()}") for name in RISK_BANDS],
    )
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum("n") - F.sum("n_ok")).alias("n_invalid"),
        (F.sum("total") / F.sum("n")).alias("mean"), (F.sum("n_positive") / F.sum("n")).alias("positive_rate"),
        count_array(n_bins).alias("counts"), *[F.sum(f"n_{name.lower()}").alias(f"n_{name.lower()}") for name in RISK_BANDS],
    )


def prediction_quantiles(scored: DataFrame, probability: str, by: Sequence[str] = ()) -> DataFrame:
    return (
        quantiles(scored, {"probability": F.col(probability)}, (0.5, 0.95), by=by)
        .groupBy(*by).agg(
            F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("p50"),
            F.max(F.when(F.col("prob") == 0.95, F.col("value"))).alias("p95"))
    )


# --- keeping and trusting a profile ------------------------------------------

def save_profile(profile: Profile, folder: str) -> str:
    """Write once under its own content id."""
    identity = profile_identity(profile).first()["profile_id"]
    home = f"{folder.rstrip('/')}/profile_id={identity}"
    spark = profile.categories.sparkSession
    profile.categories.write.mode("errorifexists").parquet(f"{home}/categories")
    profile.numeric_table().coalesce(1).write.mode("errorifexists").parquet(f"{home}/numeric")
    profile.categorical_table().coalesce(1).write.mode("errorifexists").parquet(f"{home}/categorical")
    order = [list(profile.numeric_features), list(profile.categorical_features)]
    # Written last: a folder without a manifest is not a profile.
    spark.createDataFrame(
        [(identity, PROFILE_VERSION, *order, dict(profile.lineage))],
        "profile_id string, version string, numeric array<string>, categorical array<string>, lineage map<string,string>",
    ).coalesce(1).write.mode("errorifexists").parquet(f"{home}/manifest")
    return home


def load_profile(spark: SparkSession, home: str) -> tuple[Profile, str]:
    head = spark.read.parquet(f"{home}/manifest").first()
    if head["version"] != PROFILE_VERSION:
        raise PolicyError("profile version is not supported")

    def rows(name: str) -> tuple[dict, ...]:
        found = {r["feature"]: r.asDict() for r in spark.read.parquet(f"{home}/{name}").collect()}
        return tuple(found[f] for f in head[name] if f in found)

    profile = Profile(
        rows("numeric"), rows("categorical"), spark.read.parquet(f"{home}/categories"), dict(head["lineage"] or {}))
    return profile, head["profile_id"]


def check_profile(profile: Profile, profile_id: str, *, lineage: Mapping[str, str], features: Sequence[str]) -> list[str]:
    """Reasons why a profile may not be used; empty when it may."""
    reasons = []
    if profile_identity(profile).first()["profile_id"] != profile_id:
        reasons.append("checksum")
    reasons += [f"lineage.{k}" for k, v in lineage.items() if profile.lineage.get(k) != v]
    if list(profile.features) != list(features):
        reasons.append("feature_order")
    if any(not row["edges"] for row in profile.numeric):
        reasons.append("feature_statistics")
    return reasons
