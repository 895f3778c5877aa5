"""Data quality and drift of lineitem windows against the earlier lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwatch.config import DriftPolicy
from tarnwatch.operators import drift as dr
from tarnwatch.operators import monitoring as mo
from tarnwatch.operators import profile as pf
from tarnwatch.operators import scenario as sc
from tarnwatch.operators.scoring import batch_summary, bands_around, decided, joined_vote, probability_audit, weighted_vote
from tarnwatch.plans.freeze import freeze
from tarnwatch.session import shared_folder
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
    text,
    windows,
)
from tarnwatch.workload.profiles import reference_profile


def ladder_sql(v: str, a: float, b: float, c: float) -> str:
    return f"CASE WHEN {v} >= {c}e0 THEN 'critical' WHEN {v} >= {b}e0 THEN 'warning' WHEN {v} >= {a}e0 THEN 'watch' ELSE 'stable' END"


SEVERITY_SQL = "CASE {s} WHEN 'insufficient_data' THEN -1 WHEN 'stable' THEN 0 WHEN 'watch' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 ELSE 4 END"

NUMERIC_DRIFT_SQL = f"""
{PROFILE_SQL},
numeric_drift AS (
  SELECT window_id, feature, CAST(sum(c) AS BIGINT) AS n_valid, sum((cs - rs) * ln((cs + 1e-6) / (rs + 1e-6))) AS psi,
         coalesce(sum(abs(rc - cc) * step), 0) AS w1, max(greatest(last_edge - first_edge, 1)) AS span
  FROM steps GROUP BY ALL)
"""


@query("psi_and_wasserstein", f"""
WITH {NUMERIC_DRIFT_SQL}
SELECT window_id, feature, n_valid, round(psi, 6) AS psi, round(w1, 4) AS wasserstein, round(w1 / span, 6) AS wasserstein_normalized FROM numeric_drift
""")
def psi_and_wasserstein(spark, sf):
    profile = reference_profile(spark, sf, categorical=())
    counts = dr.numeric_counts(windows(spark, sf), profile, ["window_id"])
    rows = dr.numeric_evidence(counts, profile, DriftPolicy(minimum_sample_size=1), ["window_id"])
    rows = rows.withColumn("n_valid", F.col("n_valid") - F.col("n_outside"))
    out = rounded(rounded(rows, 6, "psi", "wasserstein_normalized"), 4, "wasserstein")
    return out.select("window_id", "feature", "n_valid", "psi", "wasserstein", "wasserstein_normalized")


# Categories of the reference and the windows; some windows meet a new category and a missing one.
def shifted_windows(spark, sf):
    k = F.col("l_orderkey") % 23
    return windows(spark, sf).withColumn(
        "l_returnflag", F.when(k == 0, "X").when(k == 1, F.lit(None).cast("string")).otherwise(F.col("l_returnflag")))


CATEGORY_SQL = f"""
refl AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01'),
curl AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS window_id, l_linestatus,
         CASE WHEN l_orderkey % 23 = 0 THEN 'X' WHEN l_orderkey % 23 = 1 THEN NULL ELSE l_returnflag END AS l_returnflag
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01'),
rc AS (SELECT 'l_returnflag' AS feature, l_returnflag AS category, count(*) AS r FROM refl GROUP BY ALL
       UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM refl GROUP BY ALL),
raw_cur AS (SELECT window_id, 'l_returnflag' AS feature, coalesce(l_returnflag, '__MISSING__') AS category FROM curl
       UNION ALL SELECT window_id, 'l_linestatus', l_linestatus FROM curl),
cc AS (
  SELECT w.window_id, w.feature, CASE WHEN rc.category IS NULL THEN '__UNKNOWN__' ELSE w.category END AS category, count(*) AS c
  FROM raw_cur w LEFT JOIN rc USING (feature, category) GROUP BY ALL),
support AS (
  SELECT w.window_id, s.feature, s.category, s.r FROM (SELECT DISTINCT window_id FROM curl) w
  CROSS JOIN (SELECT * FROM rc UNION ALL SELECT DISTINCT feature, '__UNKNOWN__', 0 FROM rc) s),
cells AS (
  SELECT s.*, coalesce(cc.c, 0) AS c FROM support s LEFT JOIN cc USING (window_id, feature, category)),
pq AS (
  SELECT *, r / sum(r) OVER g AS p, c / sum(c) OVER g AS q, sum(c) OVER g AS cn FROM cells WINDOW g AS (PARTITION BY window_id, feature)),
cat_drift AS (
  SELECT window_id, feature, CAST(max(cn) AS BIGINT) AS n,
    sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS jsd,
    CAST(sum(c) FILTER (WHERE category = '__UNKNOWN__') AS BIGINT) AS n_unknown,
    sum(CASE WHEN r > 0 THEN (c - p * cn) * (c - p * cn) / (p * cn) END) AS chi,
    min(CASE WHEN r > 0 THEN p * cn END) AS smallest, count(*) FILTER (WHERE r > 0) - 1 AS degrees
  FROM pq GROUP BY ALL)
"""


def _categorical(spark, sf, rows=None, policy=DriftPolicy()):
    profile = pf.build_profile(reference(spark, sf), numeric=(), categorical=CATEGORICAL)
    counts = pf.category_counts(shifted_windows(spark, sf) if rows is None else rows, CATEGORICAL, ["window_id"])
    return dr.categorical_evidence(counts, profile, policy, ["window_id"])


@query("jensen_shannon", f"""
WITH {CATEGORY_SQL}
SELECT window_id, feature, n, round(jsd, 6) AS jensen_shannon, round(n_unknown / n, 6) AS unknown_rate,
  {ladder_sql('jsd', 0.05, 0.1, 0.2)} AS distribution_status FROM cat_drift
""")
def jensen_shannon(spark, sf):
    rows = rounded(_categorical(spark, sf), 6, "jensen_shannon", "unknown_rate")
    return rows.select("window_id", "feature", "n", "jensen_shannon", "unknown_rate", "distribution_status")


PLAIN_CATEGORY_SQL = CATEGORY_SQL.replace(
    "CASE WHEN l_orderkey % 23 = 0 THEN 'X' WHEN l_orderkey % 23 = 1 THEN NULL ELSE l_returnflag END AS l_returnflag", "l_returnflag")


@query("chi_square", f"""
WITH {PLAIN_CATEGORY_SQL}
SELECT window_id, feature, CASE WHEN smallest >= 5 THEN round(chi, 4) END AS chi_square,
  CASE WHEN smallest >= 5 AND degrees = 2 THEN round(exp(-chi / 2), 6) END AS p_value FROM cat_drift WHERE feature = 'l_returnflag'
""")
def chi_square(spark, sf):
    from tarnwatch.functions.special import chi_square_p

    rows = _categorical(spark, sf, windows(spark, sf)).where(F.col("feature") == "l_returnflag")
    rows = rows.withColumn("p_value", chi_square_p(F.col("chi_square"), F.col("chi_square_degrees")))
    return rounded(rounded(rows, 4, "chi_square"), 6, "p_value").select("window_id", "feature", "chi_square", "p_value")


@query("chi_square_strict", """
SELECT strftime(l_shipdate, '%Y-%m') AS window_id, f.feature, CAST(NULL AS DOUBLE) AS chi_square
FROM lineitem, (SELECT unnest(['l_returnflag', 'l_linestatus']) AS feature) f WHERE l_shipdate >= TIMESTAMP '1998-07-01' GROUP BY ALL
""")
def chi_square_strict(spark, sf):
    """With the unknown cell always in the support nothing is eligible."""
    return _categorical(spark, sf, windows(spark, sf), DriftPolicy(strict_unknown=True)).select("window_id", "feature", "chi_square")


@query("false_discovery_control", """
WITH p AS (SELECT event_type AS family, CAST(day(ts) AS INTEGER) AS feature, count(*) FILTER (WHERE value > 30) / count(*) AS p FROM events GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, feature) AS k FROM p)
SELECT family, feature, round(p, 6) AS p, round(least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted_p_value FROM r
""")
def false_discovery_control(spark, sf):
    p = table(spark, sf, "events").groupBy(F.col("event_type").alias("family"), F.dayofmonth("ts").alias("feature")).agg(
        (F.count_if(F.col("value") > 30) / F.count(F.lit(1))).alias("p"))
    return rounded(dr.adjust_p_values(p, "p", ["family"]), 6, "p", "adjusted_p_value")


# --- quality rates -----------------------------------------------------------------

def dirty_windows(spark, sf):
    k = F.col("l_orderkey") % 19
    return windows(spark, sf).select(
        "window_id",
        F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "bad").when(k == 2, "NaN")
        .when(k == 3, F.concat(F.lit("9"), text(F.col("l_quantity").cast("int")))).otherwise(text(F.col("l_quantity").cast("int"))).alias("l_quantity"),
        F.when(k == 4, F.col("l_discount") + 1).when(k == 5, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(k == 6, F.lit(None).cast("string")).when((k == 7) & (F.month("l_shipdate") > 6), "Z").otherwise(F.col("l_returnflag")).alias("l_returnflag"))


def _quality_sql() -> str:
    return f"""
    b AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1 FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01'),
    w AS (SELECT strftime(l_shipdate, '%Y-%m') AS window_id, l_orderkey % 19 AS k, l_quantity, l_discount, month(l_shipdate) AS m FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01'),
    q AS (
      SELECT window_id, 'l_quantity' AS feature, count(*) AS n, avg((k = 0)::INT) AS missing_rate, avg((k IN (1, 2))::INT) AS invalid_rate, 0e0 AS unknown_rate,
        avg(CASE WHEN k IN (0, 1, 2) THEN 0 WHEN k = 3 THEN (CAST('9' || CAST(l_quantity AS INTEGER) AS DOUBLE) > q1)::INT ELSE (l_quantity < q0 OR l_quantity > q1)::INT END) AS out_of_range_rate
      FROM w, b GROUP BY window_id
      UNION ALL SELECT window_id, 'l_discount', count(*), avg((k = 5)::INT), 0e0, 0e0,
        avg(CASE WHEN k = 5 THEN 0 WHEN k = 4 THEN (l_discount + 1 > d1)::INT ELSE (l_discount < d0 OR l_discount > d1)::INT END) FROM w, b GROUP BY window_id
      UNION ALL SELECT window_id, 'l_returnflag', count(*), avg((k = 6)::INT), 0e0, avg((k = 6 OR (k = 7 AND m > 6))::INT), 0e0 FROM w GROUP BY window_id),
    s AS (SELECT *, greatest(missing_rate, invalid_rate, unknown_rate, out_of_range_rate) AS worst FROM q)"""


@query("window_quality", f"""
WITH {_quality_sql()}
SELECT window_id, feature, n, round(missing_rate, 6) AS missing_rate, round(invalid_rate, 6) AS invalid_rate, round(unknown_rate, 6) AS unknown_rate,
  round(out_of_range_rate, 6) AS out_of_range_rate, {ladder_sql('worst', 0.01, 0.05, 0.15)} AS quality_status FROM s
""")
def window_quality(spark, sf):
    profile = pf.build_profile(reference(spark, sf), numeric=("l_quantity", "l_discount"), categorical=("l_returnflag",))
    rows = dr.feature_evidence(dirty_windows(spark, sf), profile)
    rates = ("missing_rate", "invalid_rate", "unknown_rate", "out_of_range_rate")
    return rounded(rows, 6, *rates).select("window_id", "feature", "n", *rates, "quality_status")


# --- whole runs ---------------------------------------------------------------------

FEATURES_SQL = f"""
{NUMERIC_DRIFT_SQL},
num AS (
  SELECT d.window_id, d.feature, 'numeric' AS kind, v.n, CASE WHEN v.n >= 30 THEN psi END AS psi, CASE WHEN v.n >= 30 THEN w1 / span END AS wn, CAST(NULL AS DOUBLE) AS jsd, v.o / v.n AS out_rate,
    CASE WHEN v.n < 30 THEN 'insufficient_data' ELSE CASE greatest({SEVERITY_SQL.format(s='(' + ladder_sql('d.psi', 0.1, 0.2, 0.3) + ')')},
      {SEVERITY_SQL.format(s='(' + ladder_sql('(w1 / span)', 0.05, 0.1, 0.2) + ')')}) WHEN 0 THEN 'stable' WHEN 1 THEN 'watch' WHEN 2 THEN 'warning' ELSE 'critical' END END AS distribution_status
  FROM numeric_drift d JOIN (
    SELECT window_id, c.feature, count(*) AS n, count(*) FILTER (WHERE value < lowest OR value > highest) AS o
    FROM cur_cells c JOIN edge_lists e USING (feature) GROUP BY ALL) v USING (window_id, feature)),
rc AS (SELECT 'l_returnflag' AS feature, l_returnflag AS category, count(*) AS r FROM refl GROUP BY ALL
       UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM refl GROUP BY ALL),
cc AS (SELECT window_id, 'l_returnflag' AS feature, l_returnflag AS category, count(*) AS c FROM curl GROUP BY ALL
       UNION ALL SELECT window_id, 'l_linestatus', l_linestatus, count(*) FROM curl GROUP BY ALL),
cells AS (SELECT w.window_id, rc.feature, rc.category, r, coalesce(c, 0) AS c FROM (SELECT DISTINCT window_id FROM curl) w CROSS JOIN rc
          LEFT JOIN cc ON cc.window_id = w.window_id AND cc.feature = rc.feature AND cc.category = rc.category),
pq AS (SELECT *, r / sum(r) OVER g AS p, c / sum(c) OVER g AS q, sum(c) OVER g AS cn FROM cells WINDOW g AS (PARTITION BY window_id, feature)),
cat AS (
  SELECT window_id, feature, 'categorical' AS kind, CAST(max(cn) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS psi, CAST(NULL AS DOUBLE) AS wn,
    sqrt(greatest(0, sum(p * ln(p / ((p + q) / 2)) + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS jsd, 0e0 AS out_rate
  FROM pq GROUP BY ALL),
feats AS (
  SELECT * FROM num UNION ALL SELECT *, {ladder_sql('jsd', 0.05, 0.1, 0.2)} FROM cat),
judged AS (
  SELECT *, {ladder_sql('out_rate', 0.01, 0.05, 0.15)} AS quality_status FROM feats),
final AS (
  SELECT *, CASE WHEN {SEVERITY_SQL.format(s='quality_status')} >= {SEVERITY_SQL.format(s='distribution_status')} THEN quality_status ELSE distribution_status END AS status
  FROM judged)
"""


@query("drift_features", f"""
WITH {FEATURES_SQL}
SELECT window_id, feature, kind, n, round(psi, 6) AS psi, round(wn, 6) AS wasserstein_normalized, round(jsd, 6) AS jensen_shannon,
  quality_status, distribution_status, status FROM final
""")
def drift_features(spark, sf):
    rows = dr.feature_evidence(windows(spark, sf), reference_profile(spark, sf))
    out = rounded(rows, 6, "psi", "wasserstein_normalized", "jensen_shannon")
    return out.select(
        "window_id", "feature", "kind", "n", "psi", "wasserstein_normalized", "jensen_shannon", "quality_status",
        "distribution_status", "status")


@query("drift_run_status", f"""
WITH {FEATURES_SQL},
sizes AS (SELECT window_id, count(*) AS n FROM curl GROUP BY window_id),
top AS (SELECT window_id, max({SEVERITY_SQL.format(s='status')}) AS level FROM final GROUP BY window_id)
SELECT window_id, n AS sample_size, CASE WHEN n < 500 THEN 'insufficient_data' ELSE CASE level WHEN -1 THEN 'insufficient_data' WHEN 0 THEN 'stable'
  WHEN 1 THEN 'watch' WHEN 2 THEN 'warning' WHEN 3 THEN 'critical' ELSE 'unknown' END END AS run_status
FROM sizes JOIN top USING (window_id)
""")
def drift_run_status(spark, sf):
    run = dr.monitor(windows(spark, sf), reference_profile(spark, sf), policy=DriftPolicy(minimum_sample_size=500))
    return run.runs


@query("drift_method_rows", f"""
WITH {FEATURES_SQL}
SELECT window_id, feature, method, count(*) AS n FROM (
  SELECT window_id, feature, unnest(['psi', 'wasserstein', 'wasserstein_normalized']) AS method FROM final WHERE kind = 'numeric' AND n >= 30
  UNION ALL SELECT window_id, feature, 'jensen_shannon' FROM final WHERE kind = 'categorical') GROUP BY ALL
""")
def drift_method_rows(spark, sf):
    rows = dr.method_rows(dr.feature_evidence(windows(spark, sf), reference_profile(spark, sf)))
    return rows.where("method <> 'chi_square'").groupBy("window_id", "feature", "method").agg(F.count(F.lit(1)).alias("n"))


@query("drift_ks_status", """
SELECT strftime(l_shipdate, '%Y-%m') AS window_id, f.feature, 'not_applicable' AS ks_status
FROM lineitem, (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature) f WHERE l_shipdate >= TIMESTAMP '1998-07-01' GROUP BY ALL
""")
def drift_ks_status(spark, sf):
    profile = reference_profile(spark, sf, categorical=())
    return dr.feature_evidence(windows(spark, sf), profile).select("window_id", "feature", "ks_status")


@query("drift_result_documents", f"""
WITH {FEATURES_SQL},
sizes AS (SELECT window_id, count(*) AS n FROM curl GROUP BY window_id),
top AS (SELECT window_id, max({SEVERITY_SQL.format(s='status')}) AS level, count(*) AS n_features, min(feature) AS first_feature FROM final GROUP BY window_id)
SELECT window_id, CASE WHEN n < 30 THEN 'insufficient_data' ELSE CASE level WHEN -1 THEN 'insufficient_data' WHEN 0 THEN 'stable' WHEN 1 THEN 'watch' WHEN 2 THEN 'warning' WHEN 3 THEN 'critical' ELSE 'unknown' END END AS run_status,
  CAST(n AS VARCHAR) AS sample_size, 'model-1' AS model_version, CASE WHEN n >= 30 THEN CAST(n_features AS INTEGER) END AS n_features,
  CASE WHEN n >= 30 THEN first_feature END AS first_feature FROM sizes JOIN top USING (window_id)
""")
def drift_result_documents(spark, sf):
    """Fields read back from the JSON documents of all windows."""
    profile = reference_profile(spark, sf)
    run = dr.monitor(windows(spark, sf), profile)
    identity = pf.profile_identity(profile).first()["profile_id"]
    documents = dr.result_document(run, profile, identity, DriftPolicy())
    field = lambda path: F.get_json_object("document", path)
    return documents.select(
        "window_id", "run_status", field("$.sample_size").alias("sample_size"), field("$.lineage.model_version").alias("model_version"),
        F.json_array_length(field("$.features")).alias("n_features"), field("$.features[0].feature").alias("first_feature"))


@query("drift_failure_classes", """
WITH w AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS window_id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01')
SELECT window_id, 'unknown' AS run_status, c AS error_class FROM w, (VALUES ('current_window_incompatible'), ('baseline_incompatible'), ('monitoring_failure')) t(c)
""")
def drift_failure_classes(spark, sf):
    """A column the profile doesn't know; a profile that doesn't fit; and a value that fails only when it is read."""
    profile = reference_profile(spark, sf, numeric=("l_quantity",), categorical=())
    fitting = windows(spark, sf).select("window_id", "l_quantity")
    broken = fitting.withColumn("l_quantity", F.when(F.col("l_quantity") > 40, F.raise_error(F.lit("unreadable"))).otherwise(F.col("l_quantity")))
    runs = [dr.checked_monitor(windows(spark, sf), profile), dr.checked_monitor(fitting, profile, profile_reasons=("checksum",)),
            dr.checked_monitor(broken, profile)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).drop("sample_size")


# --- a whole run ------------------------------------------------------------------------

@query("monitoring_run", f"""
WITH {FEATURES_SQL},
m_top AS (SELECT window_id, max({SEVERITY_SQL.format(s='status')}) AS level FROM final GROUP BY window_id),
m_lines AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'ref' ELSE strftime(l_shipdate, '%Y-%m') END AS window_id,
  (CAST(l_quantity AS DOUBLE) + 0.5) / 52 AS x FROM lineitem),
m_bins AS (SELECT window_id, CAST(ceil((CASE WHEN window_id = '1998-11' THEN x * x ELSE x END) * 10) AS INTEGER) AS bin FROM m_lines),
m_share AS (SELECT window_id, bin, count(*) / sum(count(*)) OVER (PARTITION BY window_id) AS s FROM m_bins GROUP BY window_id, bin),
m_sizes AS (SELECT window_id, count(*) AS n FROM m_bins WHERE window_id <> 'ref' GROUP BY window_id),
m_grid AS (SELECT window_id, n, unnest(range(1, 11)) AS bin FROM m_sizes),
m_psi AS (SELECT g.window_id, any_value(n) AS n, sum((coalesce(c.s, 0) - coalesce(r.s, 0)) * ln((coalesce(c.s, 0) + 1e-6) / (coalesce(r.s, 0) + 1e-6))) AS psi
  FROM m_grid g LEFT JOIN m_share c ON c.window_id = g.window_id AND c.bin = g.bin LEFT JOIN m_share r ON r.window_id = 'ref' AND r.bin = g.bin GROUP BY g.window_id),
m_levels AS (SELECT window_id, n, greatest(coalesce(level, -1), {SEVERITY_SQL.format(s='(' + ladder_sql('psi', 0.1, 0.2, 0.3) + ')')}) AS level FROM m_psi LEFT JOIN m_top USING (window_id))
SELECT window_id, n AS sample_size, CASE WHEN window_id = '1998-09' THEN 'unknown' WHEN n < 500 THEN 'insufficient_data' WHEN window_id = '1998-10' THEN 'unknown'
    ELSE CASE level WHEN 0 THEN 'stable' WHEN 1 THEN 'watch' WHEN 2 THEN 'warning' WHEN 3 THEN 'critical' ELSE 'unknown' END END AS run_status,
  CASE WHEN window_id = '1998-09' THEN 'monitoring_failure' WHEN n >= 500 AND window_id = '1998-10' THEN 'current_window_incompatible' END AS error_class,
  true AS reused
FROM m_levels
""")
def monitoring_run(spark, sf):
    """One month holds a value that cannot be read, the scores of one are no probabilities, those of another have moved."""
    profile = reference_profile(spark, sf)
    month, quantity = F.col("window_id"), F.col("l_quantity")

    def score(rows):
        x = (quantity.cast("double") + 0.5) / 52
        return rows.withColumn("probability", F.when(month == "1998-10", 1.5).when(month == "1998-11", x * x).otherwise(x))

    kept = mo.build_score_reference(
        score(reference(spark, sf).withColumn("window_id", F.lit("reference"))), "probability", threshold=0.5, low=0.2, high=0.7)
    # Read again and again while failing windows are told apart, and a small part of the lines.
    sound = freeze(windows(spark, sf).select("window_id", "l_orderkey", "l_linenumber", *NUMERIC, *CATEGORICAL), "current-windows")
    broken = sound.withColumn("l_quantity", F.when((month == "1998-09") & (quantity > 40), F.raise_error(F.lit("unreadable"))).otherwise(quantity))
    given = {
        "profile_id": pf.profile_identity(profile).first()["profile_id"], "identity": mo.window_identity(sound), "score": score,
        "reference": kept, "key": ("l_orderkey", "l_linenumber"), "policy": DriftPolicy(minimum_sample_size=500)}
    folder = f"{shared_folder(spark)}/tarnwatch/monitoring-{uuid.uuid4().hex}"
    mo.monitoring_run(folder, broken, profile, **given)
    again = mo.monitoring_run(folder, broken, profile, **given)
    return again.data.withColumn("reused", F.lit(again.reused))


# --- predictions -----------------------------------------------------------------------

@query("prediction_drift", f"""
WITH {SCORED_SQL},
b AS (SELECT s.*, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'ref' ELSE strftime(o_orderdate, '%Y') END AS window_id,
  CASE WHEN p <= 0.1 THEN 0 ELSE CAST(ceil(p * 10) AS INTEGER) - 1 END AS bin FROM scored s JOIN orders ON o_orderkey = id),
r AS (SELECT bin, count(*) / sum(count(*)) OVER () AS rs FROM b WHERE window_id = 'ref' GROUP BY bin),
c AS (SELECT window_id, bin, count(*) / sum(count(*)) OVER (PARTITION BY window_id) AS cs FROM b WHERE window_id <> 'ref' GROUP BY window_id, bin),
grid AS (SELECT w.window_id, u.bin FROM (SELECT DISTINCT window_id FROM c) w, (SELECT unnest(range(10)) AS bin) u),
x AS (SELECT g.window_id, coalesce(cs, 0) AS cs, coalesce(rs, 0) AS rs FROM grid g LEFT JOIN r USING (bin) LEFT JOIN c ON c.window_id = g.window_id AND c.bin = g.bin),
psi AS (SELECT window_id, sum((cs - rs) * ln((cs + 1e-6) / (rs + 1e-6))) AS psi FROM x GROUP BY window_id),
m AS (SELECT window_id, count(*) AS n, avg(p) AS mean, avg((p >= 0.5)::INT) AS positive_rate, count(*) FILTER (WHERE p >= 0.7) AS n_high,
  count(*) FILTER (WHERE p >= 0.5 AND p < 0.7) AS n_medium, count(*) FILTER (WHERE p >= 0.3 AND p < 0.5) AS n_low, count(*) FILTER (WHERE p < 0.3) AS n_safe FROM b WHERE window_id <> 'ref' GROUP BY window_id)
SELECT window_id, n, round(psi, 6) AS psi, round(mean, 6) AS mean, round(positive_rate, 6) AS positive_rate, n_safe, n_low, n_medium, n_high,
  {ladder_sql('psi', 0.1, 0.2, 0.3)} AS status FROM psi JOIN m USING (window_id)
""")
def prediction_drift(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    scored = scored_orders(spark, sf).join(orders, "id")
    border = F.lit("1998-01-01").cast("timestamp")
    now = scored.where(F.col("o_orderdate") >= border).withColumn("window_id", F.date_format("o_orderdate", "yyyy"))
    rows = dr.prediction_drift(
        scored.where(F.col("o_orderdate") < border), now, "probability", threshold=0.5, low=0.3, high=0.7)
    return rounded(rows.drop("n_invalid"), 6, "psi", "mean", "positive_rate")


@query("bounded_prediction_sample", """
SELECT o_orderkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7|' || o_orderkey)) AS rn FROM orders) WHERE rn <= 500
""")
def bounded_prediction_sample(spark, sf):
    """The scoring budget of a run: at most 500 seeded rows per window."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return dr.bounded_sample(orders, ["o_orderkey"], cap=500, seed=7, by=["o_orderpriority"])


@query("probability_audit", f"""
WITH {SCORED_SQL} SELECT segment, count(*) AS n, count(*) FILTER (WHERE p * 1.2 > 1 OR id % 50 = 0) AS n_invalid FROM scored GROUP BY segment
""")
def probability_audit_query(spark, sf):
    p = F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("probability") * 1.2)
    return probability_audit(scored_orders(spark, sf).withColumn("probability", p), "probability", ["segment"])


@query("decisions_and_bands", f"""
WITH {SCORED_SQL}
SELECT segment, CASE WHEN p >= 0.45 THEN 1 ELSE 0 END AS decision,
  CASE WHEN p >= 0.65 THEN 'HIGH' WHEN p >= 0.45 THEN 'MEDIUM' WHEN p >= 0.25 THEN 'LOW' ELSE 'SAFE' END AS risk_band, count(*) AS n
FROM scored GROUP BY ALL
""")
def decisions_and_bands(spark, sf):
    low, high = bands_around(0.45)
    rows = decided(scored_orders(spark, sf), "probability", threshold=0.45, low=low, high=high)
    return rows.groupBy("segment", "decision", "risk_band").agg(F.count(F.lit(1)).alias("n"))


@query("batch_summary", f"""
WITH {SCORED_SQL}
SELECT segment, count(*) AS n, count(*) FILTER (WHERE p >= 0.5) AS n_positive, round(count(*) FILTER (WHERE p >= 0.5) / count(*) * 100, 2) AS positive_rate_pct,
  round(avg(p), 4) AS mean_probability FROM scored GROUP BY segment
""")
def batch_summary_query(spark, sf):
    return batch_summary(scored_orders(spark, sf), "probability", 0.5, ["segment"])


@query("weighted_vote", f"""
WITH {SCORED_SQL} SELECT id, round(p * (5 / 9e0) + champion * (3 / 9e0) + y * (1 / 9e0), 9) AS vote FROM scored
""")
def weighted_vote_query(spark, sf):
    vote = weighted_vote({"probability": 5, "champion": 3, "label": 1})
    return rounded(scored_orders(spark, sf).select("id", vote.alias("vote")), 9, "vote")


@query("joined_vote", f"""
WITH {SCORED_SQL} SELECT id, round(p * (5 / 8e0) + champion * (3 / 8e0), 10) AS probability FROM scored WHERE id % 3 <> 0
""")
def joined_vote_query(spark, sf):
    scored = scored_orders(spark, sf)
    second = scored.where(F.col("id") % 3 != 0).select("id", F.col("champion").alias("probability"))
    return rounded(joined_vote([(scored.select("id", "probability"), 5), (second, 3)], ["id"]), 10, "probability")


# --- controlled drift ---------------------------------------------------------------------

@query("scenario_numeric_shift", """
SELECT event_type, round(sum(value + 25), 2) AS total, count(*) AS n FROM events GROUP BY event_type
""")
def scenario_numeric_shift(spark, sf):
    shifted = sc.shift_numeric(table(spark, sf, "events"), "value", 25.0)
    return rounded(shifted.groupBy("event_type").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")), 2, "total")


@query("scenario_category_replacement", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('11|' || o_orderkey)) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= round_even(n * 0.4e0, 0) THEN 'NEW' ELSE o_orderpriority END AS o_orderpriority FROM r
""")
def scenario_category_replacement(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sc.replace_category(orders, "o_orderpriority", value="NEW", fraction=0.4, seed=11, key=["o_orderkey"])


@query("scenario_missingness", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('12|' || o_orderkey)) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn > round_even(n * 0.2e0, 0) THEN o_orderpriority END AS o_orderpriority FROM r
""")
def scenario_missingness(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sc.blank_out(orders, "o_orderpriority", fraction=0.2, seed=12, key=["o_orderkey"], by=["o_orderstatus"])


@query("calibration_score", """
WITH d AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, max(value) AS top FROM events GROUP BY ALL),
o AS (SELECT event_type, CASE WHEN day(day) <= 15 THEN 'stable' ELSE 'material' END AS scenario, CASE WHEN top > 300 THEN 'critical' WHEN top > 220 THEN 'warning' ELSE 'stable' END AS status,
  CASE WHEN day(day) > 15 THEN day(day) % 3 END AS w FROM d),
s AS (SELECT event_type, count(*) FILTER (WHERE scenario = 'stable' AND status <> 'stable') / greatest(count(*) FILTER (WHERE scenario = 'stable'), 1) AS f,
  count(*) FILTER (WHERE scenario = 'material' AND status <> 'stable') / greatest(count(*) FILTER (WHERE scenario = 'material'), 1) AS s, CAST(coalesce(max(w), 3) AS BIGINT) AS m FROM o GROUP BY event_type)
SELECT event_type, round(f, 8) AS false_positive_rate, round(s, 8) AS sensitivity, m AS max_detection_windows, f <= 0.05 AND s >= 0.8 AND m <= 2 AS accepted FROM s
""")
def calibration_score(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("top"))
    late = F.dayofmonth("day") > 15
    outcomes = daily.select(
        "event_type", F.when(late, "material").otherwise("stable").alias("scenario"),
        F.when(F.col("top") > 300, "critical").when(F.col("top") > 220, "warning").otherwise("stable").alias("status"),
        F.when(late, F.dayofmonth("day") % 3).alias("detection_windows"))
    return sc.calibration_score(outcomes, by=["event_type"])


@query("scenario_detection", None)
def scenario_detection(spark, sf):
    """Statuses of untouched and of shifted windows against the same profile."""
    profile = reference_profile(spark, sf, numeric=("l_quantity",), categorical=("l_returnflag",))
    base = windows(spark, sf).select("window_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    moved = sc.shift_numeric(base, "l_quantity", 20.0)
    shifted = sc.replace_category(
        moved, "l_returnflag", value="X", fraction=0.3, seed=5, key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    rows = freeze(base.withColumn("scenario", F.lit("stable")).unionByName(shifted.withColumn("scenario", F.lit("material"))), "scenarios")
    found = dr.feature_evidence(rows, profile, by=["scenario", "window_id"])
    return found.groupBy("scenario", "feature", "status").agg(F.count(F.lit(1)).alias("windows"))
