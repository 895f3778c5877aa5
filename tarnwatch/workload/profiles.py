"""Reference profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.operators import profile as pf
from tarnwatch.workload.base import (
    CATEGORICAL,
    NUMERIC,
    PROFILE_SQL,
    SCORED_SQL,
    query,
    reference,
    rounded,
    scored_orders,
    table,
)


def reference_profile(spark, sf, numeric=tuple(NUMERIC), categorical=tuple(CATEGORICAL)):
    return pf.build_profile(reference(spark, sf), numeric=numeric, categorical=categorical, lineage={"model_version": "model-1"})


# lineitem with nulls, NaN and text numbers, for rates that are not zero
def dirty_reference(spark, sf):
    k = F.col("l_orderkey") % 13
    return reference(spark, sf).select(
        F.when(k != 0, F.col("l_quantity")).alias("quantity"),
        F.when(k == 1, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("discount"),
        F.when(k != 2, F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status"))


DIRTY_SQL = """
dirty AS (
  SELECT CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity END AS quantity,
         CASE WHEN l_orderkey % 13 <> 1 THEN l_discount + 0e0 END AS discount,
         CASE WHEN l_orderkey % 13 <> 2 THEN l_returnflag END AS flag, l_linestatus AS status
  FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01')
"""


@query("profile_numeric_summary", f"""
WITH {DIRTY_SQL},
cells AS (SELECT 'quantity' AS feature, quantity AS value FROM dirty UNION ALL SELECT 'discount', discount FROM dirty)
SELECT feature, count(*) AS n, round(1 - count(value) / count(*), 6) AS missing_rate, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM cells GROUP BY feature
""")
def profile_numeric_summary(spark, sf):
    return rounded(pf.numeric_summary(dirty_reference(spark, sf), ["quantity", "discount"]), 6, "missing_rate", "mean", "std")


_PROBS = "[0e0, 0.01e0, 0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0, 0.99e0, 1e0]"


@query("profile_quantiles", f"""
WITH {PROFILE_SQL},
q AS (SELECT feature, quantile_cont(value, {_PROBS}) AS qs FROM ref_cells GROUP BY feature)
SELECT feature, unnest({_PROBS}) AS prob, round(unnest(qs), 6) + 0e0 AS value FROM q
""")
def profile_quantiles(spark, sf):
    rows = pf.numeric_quantiles(reference(spark, sf), NUMERIC, list(pf.SUMMARY_PROBS.values()))
    return rounded(rows, 6, "value")


@query("quantiles_per_group", """
WITH q AS (SELECT l_shipmode, quantile_cont(l_extendedprice, [0.1e0, 0.5e0, 0.95e0]) AS qs
  FROM (SELECT year(l_shipdate) AS l_shipmode, l_extendedprice FROM lineitem) GROUP BY l_shipmode)
SELECT CAST(l_shipmode AS INTEGER) AS ship_year, unnest([0.1e0, 0.5e0, 0.95e0]) AS prob, round(unnest(qs), 6) AS value FROM q
""")
def quantiles_per_group(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("ship_year"), "l_extendedprice")
    rows = pf.numeric_quantiles(lines, ["l_extendedprice"], [0.1, 0.5, 0.95], by=["ship_year"])
    return rounded(rows.select("ship_year", "prob", "value"), 6, "value")


@query("profile_frozen_bins", f"""
WITH {PROFILE_SQL}
SELECT feature, idx AS bin_idx, round(lo, 6) + 0e0 AS lo, round(hi, 6) + 0e0 AS hi, n FROM ref_bins
""")
def profile_frozen_bins(spark, sf):
    return rounded(pf.histogram_rows(reference_profile(spark, sf, categorical=())), 6, "lo", "hi")


@query("profile_categories", f"""
WITH {DIRTY_SQL},
cells AS (SELECT 'flag' AS feature, coalesce(flag, '__MISSING__') AS category FROM dirty UNION ALL SELECT 'status', status FROM dirty)
SELECT feature, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) AS proportion FROM cells GROUP BY feature, category
""")
def profile_categories(spark, sf):
    profile = pf.build_profile(dirty_reference(spark, sf), numeric=(), categorical=("flag", "status"))
    return rounded(pf.proportions(profile), 6, "proportion")


@query("profile_coverage_projection", f"""
WITH {DIRTY_SQL}
SELECT 'status' AS feature, status AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM dirty GROUP BY status
""")
def profile_coverage_projection(spark, sf):
    profile = pf.build_profile(dirty_reference(spark, sf), numeric=("quantity",), categorical=("flag", "status"))
    return rounded(pf.proportions(pf.covered(profile, ("quantity", "status"))), 6, "proportion")


@query("profile_predictions", f"""
WITH {SCORED_SQL},
b AS (SELECT *, CASE WHEN p <= 0.1 THEN 0 ELSE CAST(ceil(p * 10) AS INTEGER) - 1 END AS bin,
  CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.5 THEN 'MEDIUM' WHEN p >= 0.3 THEN 'LOW' ELSE 'SAFE' END AS band FROM scored)
SELECT count(*) AS n, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5e0), 6) AS p50, round(quantile_cont(p, 0.95e0), 6) AS p95,
  round(avg((p >= 0.5)::INT), 6) AS positive_rate, count(*) FILTER (WHERE band = 'SAFE') AS n_safe, count(*) FILTER (WHERE band = 'LOW') AS n_low,
  count(*) FILTER (WHERE band = 'MEDIUM') AS n_medium, count(*) FILTER (WHERE band = 'HIGH') AS n_high,
  array_to_string([count(*) FILTER (WHERE bin = 0), count(*) FILTER (WHERE bin = 1), count(*) FILTER (WHERE bin = 2), count(*) FILTER (WHERE bin = 3),
   count(*) FILTER (WHERE bin = 4), count(*) FILTER (WHERE bin = 5), count(*) FILTER (WHERE bin = 6), count(*) FILTER (WHERE bin = 7),
   count(*) FILTER (WHERE bin = 8), count(*) FILTER (WHERE bin = 9)], ',') AS counts
FROM b
""")
def profile_predictions(spark, sf):
    scored = scored_orders(spark, sf)
    bins = pf.prediction_histogram(scored, "probability", threshold=0.5, low=0.3, high=0.7).withColumn("one", F.lit(1))
    both = bins.join(pf.prediction_quantiles(scored, "probability").withColumn("one", F.lit(1)), "one")
    out = both.select(
        "n", "mean", "p50", "p95", "positive_rate", "n_safe", "n_low", "n_medium", "n_high",
        F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))
    return rounded(out, 6, "mean", "p50", "p95", "positive_rate")


@query("profile_identity")
def profile_identity(spark, sf):
    return pf.profile_identity(reference_profile(spark, sf))


@query("profile_tidy_rows", f"""
WITH {PROFILE_SQL},
cats AS (SELECT 'l_returnflag' AS feature, l_returnflag AS c, count(*) AS n FROM refl GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM refl GROUP BY ALL)
SELECT feature, 'bin_count' AS item, idx AS position, n + 0e0 AS value FROM ref_bins
UNION ALL SELECT feature, 'category:' || c, 0, n + 0e0 FROM cats
""")
def profile_tidy_rows(spark, sf):
    rows = pf.tidy(reference_profile(spark, sf))
    return rows.where(F.col("item").startswith("bin_count") | F.col("item").startswith("category:"))


@query("profile_compatibility", f"""
WITH {PROFILE_SQL},
size AS (SELECT (SELECT count(*) * 13 FROM edge_lists) + (SELECT sum(len(edges)) FROM edge_lists) + (SELECT count(*) FROM bins)
  + (SELECT count(DISTINCT l_returnflag) + count(DISTINCT l_linestatus) FROM refl) AS n)
SELECT CAST(n AS BIGINT) AS profile_rows, unnest(['lineage.model_version', 'feature_order']) AS reason FROM size
""")
def profile_compatibility(spark, sf):
    """Reasons found when the stored profile is offered to a wrong model and feature order."""
    profile = reference_profile(spark, sf)
    identity = pf.profile_identity(profile).first()["profile_id"]
    reasons = pf.check_profile(profile, identity, lineage={"model_version": "model-2"}, features=list(reversed(profile.features)))
    return pf.profile_identity(profile).select("profile_rows", F.explode(F.array(*[F.lit(r) for r in reasons])).alias("reason"))
