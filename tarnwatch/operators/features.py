"""Feature engineering as column expressions, and encoders fitted by one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwatch.config import PolicyError
from tarnwatch.functions.expressions import number_from_text, right_closed_labels
from tarnwatch.plans.freeze import freeze
from tarnwatch.plans.longform import melt


def number_or_estimate(text: Column, estimate: Column) -> Column:
    return F.coalesce(number_from_text(text), estimate)


def residual(total: Column, estimate: Column) -> Column:
    return total - estimate


def ratio(part: Column, total: Column) -> Column:
    return part / (total + F.lit(1e-6))


def count_equal(columns: Sequence[str], value: str) -> Column:
    marks = [F.coalesce((F.col(f"`{c}`") == value).cast("int"), F.lit(0)) for c in columns]
    return reduce(lambda a, b: a + b, marks)


def is_member(column: Column, values: Sequence[str]) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False)).cast("int")


def mapped_number(column: Column, mapping: Mapping[str, int]) -> Column:
    """Mapped value, else the column's own number; text that is neither gives null."""
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))])
    text = column.cast("string")
    return F.coalesce(F.try_element_at(table, text), number_from_text(text))


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


# --- fitted encoders -----------------------------------------------------------

def category_positions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, category, position) of all columns' categories in one pass, positions from 0 in order of category.

    Positions come from bucket totals as other ranks do, so no task holds a whole feature's categories."""
    cells = melt(df, [], {c: F.struct(F.col(f"`{c}`").cast("string").alias("category")) for c in columns})
    found = cells.where(F.col("category").isNotNull()).distinct()
    part = F.substring("category", 1, 2)
    totals = found.groupBy("feature", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("feature", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("feature", "part").orderBy("category")) - 1
    return found.withColumn("part", part).withColumn("at", inside).join(starts, ["feature", "part"]).select(
        "feature", "category", (F.col("start") + F.col("at")).alias("position"))


def encoded(df: DataFrame, column: str, positions: DataFrame, out: str) -> DataFrame:
    """Adds `out`, the position of the row's category (null: unknown), by a join: for features of any number of categories, as
    the index of a sparse vector."""
    own = positions.where(F.col("feature") == column).select(F.col("category").alias("__category"), F.col("position").alias(out))
    return df.join(own, F.col(f"`{column}`").cast("string") == F.col("__category"), "left").drop("__category")


def fit_categories(
    df: DataFrame, columns: Sequence[str], declared: Mapping[str, Sequence[str]] | None = None, most: int | None = None,
) -> dict[str, list[str]]:
    """Sorted categories per column, all columns in one pass; those `declared` by the caller aren't looked for.

    Each category becomes a column, so they come to the driver. `most` is the caller's own limit per column, counted before
    anything is fetched; features beyond it belong to `category_positions` and `encoded`."""
    found = {c: sorted(values) for c, values in (declared or {}).items() if c in columns}
    open_columns = [c for c in columns if c not in found]
    if not open_columns:
        return found
    rows = category_positions(df, open_columns)
    if most is not None:
        rows = freeze(rows, "categories")
        large = rows.groupBy("feature").count().where(F.col("count") > most).orderBy("feature").collect()  # a row per column
        if large:
            raise PolicyError("more than " + str(most) + " categories: " + ", ".join(f"{r['feature']} ({r['count']})" for r in large))
    found |= {c: [] for c in open_columns}
    for row in rows.collect():
        found[row["feature"]].append(row["category"])
    return {c: sorted(found[c]) for c in columns}


def one_hot(column: str, categories: Sequence[str]) -> dict[str, Column]:
    """One 0/1 column per category but the first; an unknown value is all zeros."""
    value = F.col(f"`{column}`").cast("string")
    return {f"{column}_{c}": F.coalesce((value == c).cast("double"), F.lit(0.0)) for c in categories[1:]}


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column keeps scale 1."""
    row = df.agg(*[
        x for i, c in enumerate(columns)
        for x in (F.avg(f"`{c}`").alias(f"m{i}"), F.stddev_pop(f"`{c}`").alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled(column: str, mean: float, scale: float) -> Column:
    return (F.col(f"`{column}`").cast("double") - mean) / scale


@dataclass(frozen=True)
class FeatureRecipe:
    """What to derive, drop, map and encode. Column names are the caller's."""

    text_total: str | None = None
    rate: str | None = None
    duration: str | None = None
    duration_edges: tuple[float, ...] = ()
    duration_labels: tuple[str, ...] = ()
    duration_group: str = "duration_group"
    membership: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    counted: tuple[str, ...] = ()
    counted_value: str = "Yes"
    drop: tuple[str, ...] = ()
    maps: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    encode: tuple[str, ...] = ()
    categories: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    scale: tuple[str, ...] = ()


def derive(df: DataFrame, recipe: FeatureRecipe) -> DataFrame:
    have = set(df.columns)
    if recipe.text_total in have:
        estimate = F.col(f"`{recipe.rate}`") * F.col(f"`{recipe.duration}`")
        total = number_or_estimate(F.col(f"`{recipe.text_total}`").cast("string"), estimate)
        df = df.withColumns({
            "tc_residual": residual(total, estimate), "monthly_to_total_ratio": ratio(F.col(f"`{recipe.rate}`"), total)})
    new: dict[str, Column] = {}
    if recipe.duration in have and recipe.duration_edges:
        new[recipe.duration_group] = right_closed_labels(
            F.col(f"`{recipe.duration}`"), recipe.duration_edges, recipe.duration_labels)
    for out, (source, values) in recipe.membership.items():
        if source in have:
            new[out] = is_member(F.col(f"`{source}`"), values)
    present = [c for c in recipe.counted if c in have]
    if present:
        counted = count_equal(present, recipe.counted_value)
        new["service_count"] = counted
        new["has_any_addon"] = (counted > 0).cast("int")
    return df.withColumns(new) if new else df


@dataclass(frozen=True)
class FittedFeatures:
    recipe: FeatureRecipe
    categories: Mapping[str, list[str]]
    scales: Mapping[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        df = derive(df, self.recipe).drop(*self.recipe.drop)
        df = df.withColumns({
            c: mapped_number(F.col(f"`{c}`"), m) for c, m in self.recipe.maps.items() if c in df.columns})
        kept = [c for c in df.columns if c not in self.categories]
        columns = {c: scaled(c, *self.scales[c]) if c in self.scales else F.col(f"`{c}`") for c in kept}
        for c, values in self.categories.items():
            columns.update(one_hot(c, values))
        return df.select(*[column.alias(name) for name, column in columns.items()])


def fit_features(df: DataFrame, recipe: FeatureRecipe) -> FittedFeatures:
    """Fit on the training rows only; nothing of other rows is looked at."""
    derived = derive(df, recipe).drop(*recipe.drop)
    derived = derived.withColumns({
        c: mapped_number(F.col(f"`{c}`"), m) for c, m in recipe.maps.items() if c in derived.columns})
    have = set(derived.columns)
    encode = [c for c in recipe.encode if c in have]
    scale = [c for c in recipe.scale if c in have]
    return FittedFeatures(
        recipe, fit_categories(derived, encode, recipe.categories) if encode else {}, fit_scaler(derived, scale) if scale else {})
