"""Keyed, tolerant comparison of two results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T


def differences(
    actual: DataFrame, expected: DataFrame, key: Sequence[str], tolerance: float = 1e-4,
) -> DataFrame:
    """(key..., field, problem, actual, expected): empty when both agree.

    A row of one side only is one problem; otherwise each differing field is one.
    Two nulls or two NaN agree.
    """
    fields = [f for f in expected.schema.fields if f.name not in key]
    missing = [f for f in fields if f.name not in actual.columns]
    shared = [f for f in fields if f.name in actual.columns]
    extra = [c for c in actual.columns if c not in key and c not in {f.name for f in fields}]
    a = actual.select(*key, *[F.col(f"`{f.name}`").alias(f"a_{f.name}") for f in shared], F.lit(True).alias("in_a"))
    e = expected.select(*key, *[F.col(f"`{f.name}`").alias(f"e_{f.name}") for f in shared], F.lit(True).alias("in_e"))
    both = a.join(e, list(key), "full_outer")

    def check(f: T.StructField):
        x, y = F.col(f"`a_{f.name}`"), F.col(f"`e_{f.name}`")
        same = x.eqNullSafe(y)
        if isinstance(f.dataType, T.NumericType):
            same = same | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= tolerance, F.lit(False))
        return F.when(~same, F.struct(
            F.lit(f.name).alias("field"), F.lit("value").alias("problem"),
            x.cast("string").alias("actual"), y.cast("string").alias("expected")))

    def whole(problem: str, field: str):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), none.alias("actual"), none.alias("expected"))

    cells = F.filter(F.array(*[check(f) for f in shared]), lambda c: c.isNotNull()) if shared else F.array(whole("", "")).cast(
        "array<struct<field:string,problem:string,actual:string,expected:string>>")
    found = (
        F.when(F.col("in_a").isNull(), F.array(whole("missing", "*")))
        .when(F.col("in_e").isNull(), F.array(whole("unexpected", "*")))
        .otherwise(cells if shared else F.filter(cells, lambda c: F.lit(False))))
    rows = both.select(*key, F.inline(found))
    columns = [(c.name, "missing_field") for c in missing] + [(c, "unexpected_field") for c in extra]
    if columns:
        nulls = [F.lit(None).cast(expected.schema[k].dataType).alias(k) for k in key]
        table = actual.sparkSession.createDataFrame(columns, "field string, problem string")
        rows = rows.unionByName(table.select(
            *nulls, "field", "problem", F.lit(None).cast("string").alias("actual"), F.lit(None).cast("string").alias("expected")))
    return rows


def key_sets(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., side): every distinct key with `both`, `left` or `right`."""
    tagged = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = tagged.groupBy(*key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.select(*key, F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right").alias("side"))
