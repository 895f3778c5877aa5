"""Chi-square tail probability for integer degrees of freedom, as a column.

Spark SQL has no incomplete gamma function, but for integer degrees of freedom
the tail is a finite sum: exp(-h) or erfc(sqrt(h)) plus h^a exp(-h) / gamma(a+1)
for a = 1, 2, ... or 1/2, 3/2, ... below degrees / 2, with h = statistic / 2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_ERF_TERMS = 200  # enough for every h whose tail is above 1e-17
_NEGLIGIBLE = 40.0


def erfc_of_root(h: Column) -> Column:
    """erfc(sqrt(h)) to about 1e-16, from a series without cancellation."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * h / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_ERF_TERMS)), start, add, lambda acc: acc["total"])
    erf = F.exp(-h) * F.sqrt(h) * (2 / math.sqrt(math.pi)) * series
    return F.when(h > _NEGLIGIBLE, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - erf))


def chi_square_p(statistic: Column, degrees: Column) -> Column:
    """P(X > statistic); null without a statistic or without a degree of freedom."""
    h = statistic / 2
    odd = degrees % 2 == 1
    first = F.when(odd, 0.5).otherwise(1.0)
    base = F.when(odd, erfc_of_root(h)).otherwise(F.exp(-h))
    terms = F.when(odd, F.floor((degrees - 1) / 2)).otherwise(F.floor(degrees / 2) - 1).cast("int")
    log_first = first * F.ln(h) - h - F.when(odd, math.lgamma(1.5)).otherwise(0.0)
    start = F.struct(log_first.alias("log"), F.lit(0.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        return F.struct(
            (acc["log"] + F.ln(h) - F.ln(first + i + 1)).alias("log"), (acc["total"] + F.exp(acc["log"])).alias("total"))

    steps = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    tail = base + F.aggregate(steps, start, add, lambda acc: acc["total"])
    return (
        F.when(statistic.isNull() | degrees.isNull() | (degrees < 1) | F.isnan(statistic), F.lit(None).cast("double"))
        .when(statistic <= 0, 1.0).otherwise(F.least(F.lit(1.0), tail))
    )
