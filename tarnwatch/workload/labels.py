"""Delayed-label reconciliation of orders (predictions) and lineitem (labels)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarnwatch.config import LabelPolicy
from tarnwatch.operators import compare as cp
from tarnwatch.operators import reconcile as rc
from tarnwatch.operators.performance import PerformanceRun
from tarnwatch.workload.base import (
    AS_OF,
    LABELS_SQL,
    PREDICTIONS_SQL,
    RECONCILED_SQL,
    iso,
    iso_sql,
    labels,
    predictions,
    query,
    rounded,
    table,
    text,
)

POLICY = LabelPolicy(maximum_months=3)


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def rows(spark, sf):
    return rc.reconciled(predictions(spark, sf), labels(spark, sf), as_of(), POLICY)


@query("unique_predictions", f"""
WITH {PREDICTIONS_SQL}
SELECT CAST(id AS VARCHAR) AS prediction_id, entity_key, {iso_sql('prediction_at')} AS prediction_at, round(probability, 9) AS probability
FROM pred_groups WHERE variants = 1
""")
def unique_predictions(spark, sf):
    out = rc.unique_predictions(predictions(spark, sf))
    return rounded(out.select("prediction_id", "entity_key", iso("prediction_at").alias("prediction_at"), "probability"), 9, "probability")


@query("prediction_duplicates", f"""
WITH {PREDICTIONS_SQL}
SELECT CAST(sum(CASE WHEN variants = 1 THEN copies - 1 ELSE 0 END) AS BIGINT) AS duplicates,
       CAST(sum(CASE WHEN variants > 1 THEN copies - 1 ELSE 0 END) AS BIGINT) AS conflicts FROM pred_groups
""")
def prediction_duplicates(spark, sf):
    groups = rc.collapsed(predictions(spark, sf), ["prediction_id"])
    return groups.agg(
        F.sum(F.when(~F.col("conflict"), F.col("copies") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(F.col("conflict"), F.col("copies") - 1).otherwise(0)).alias("conflicts"))


@query("latest_labels", f"""
WITH {LABELS_SQL}
SELECT CAST(id AS VARCHAR) AS prediction_id, CAST(revision AS INTEGER) AS label_revision, entity_key, churned AS churned_within_horizon,
  {iso_sql('received_at')} AS received_at FROM lab_latest
""")
def latest_labels(spark, sf):
    out = rc.latest_labels(labels(spark, sf), as_of())
    return out.select("prediction_id", "label_revision", "entity_key", "churned_within_horizon", iso("received_at").alias("received_at"))


@query("label_visibility", f"""
SELECT l_returnflag, count(*) FILTER (WHERE l_shipdate <= TIMESTAMP '{AS_OF}') AS visible, count(*) AS n FROM lineitem GROUP BY l_returnflag
""")
def label_visibility(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("received_at", F.col("l_shipdate"))
    return lines.groupBy("l_returnflag").agg(F.count_if(rc.is_visible(as_of())).alias("visible"), F.count(F.lit(1)).alias("n"))


@query("prediction_maturity", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (WHERE o_orderdate + INTERVAL 90 DAY + INTERVAL 24 HOUR <= TIMESTAMP '{AS_OF}') AS mature,
  count(*) FILTER (WHERE o_orderdate + INTERVAL 90 DAY + INTERVAL 24 HOUR > TIMESTAMP '{AS_OF}') AS immature FROM orders GROUP BY 1
""")
def prediction_maturity(spark, sf):
    due = rc.mature(F.col("o_orderdate"), as_of(), POLICY)
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count_if(due).alias("mature"), F.count_if(~due).alias("immature"))


COUNTS_SQL = f"""
{RECONCILED_SQL},
counts AS (SELECT
  (SELECT count(*) FROM due) AS mature_predictions, (SELECT count(*) FROM pairs) AS joined_labels,
  (SELECT count(*) FROM due) - (SELECT count(*) FROM pairs) AS unmatched_predictions,
  (SELECT count(*) FROM lab_latest) - (SELECT count(*) FROM pairs) AS unmatched_labels,
  (SELECT count(*) FROM usable) - (SELECT count(*) FROM due) AS immature_predictions,
  (SELECT CAST(sum(CASE WHEN variants = 1 THEN copies - 1 ELSE 0 END) AS BIGINT) FROM pred_groups) AS duplicate_predictions,
  (SELECT CAST(sum(CASE WHEN variants = 1 THEN copies - 1 ELSE 0 END) AS BIGINT) FROM lab_groups) AS duplicate_labels,
  (SELECT CAST(sum(CASE WHEN variants > 1 THEN copies - 1 ELSE 0 END) AS BIGINT) FROM pred_groups) AS conflicting_predictions,
  (SELECT CAST(sum(CASE WHEN variants > 1 THEN copies ELSE 0 END) AS BIGINT) FROM lab_groups) AS conflicting_labels)
"""


@query("reconciliation_counts", f"""
WITH {COUNTS_SQL}
SELECT *, round(joined_labels / mature_predictions, 6) AS coverage,
  CASE WHEN joined_labels = 0 THEN 'not_available' WHEN joined_labels < 500 OR joined_labels / mature_predictions < 0.8 THEN 'insufficient_data' ELSE 'stable' END AS status
FROM counts
""")
def reconciliation_counts(spark, sf):
    return rounded(rc.reconciliation_counts(rows(spark, sf), POLICY), 6, "coverage")


@query("selected_revisions", f"""
WITH {RECONCILED_SQL} SELECT CAST(id AS VARCHAR) AS prediction_id, CAST(revision AS INTEGER) AS label_revision, y AS label FROM pairs
""")
def selected_revisions(spark, sf):
    return rc.matched_pairs(rows(spark, sf)).select("prediction_id", "label_revision", "label")


@query("unmatched_predictions", f"""
WITH {RECONCILED_SQL} SELECT CAST(id AS VARCHAR) AS prediction_id, entity_key FROM due WHERE id NOT IN (SELECT id FROM pairs)
""")
def unmatched_predictions(spark, sf):
    return rc.unmatched_predictions(rows(spark, sf)).select("prediction_id", "entity_key")


@query("unmatched_labels", f"""
WITH {RECONCILED_SQL} SELECT CAST(id AS VARCHAR) AS prediction_id, CAST(revision AS INTEGER) AS label_revision, entity_key FROM lab_latest WHERE id NOT IN (SELECT id FROM pairs)
""")
def unmatched_labels(spark, sf):
    return rc.unmatched_labels(rows(spark, sf)).select("prediction_id", "label_revision", "entity_key")


@query("mixed_lineage", """
WITH t AS (SELECT o_orderpriority AS segment, CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 THEN 'm2' ELSE 'm1' END AS model_version,
  CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey % 3 ELSE 0 END AS threshold_version FROM orders)
SELECT segment, 'model_version' AS field FROM t GROUP BY segment HAVING count(DISTINCT model_version) > 1
UNION ALL SELECT segment, 'threshold_version' FROM t GROUP BY segment HAVING count(DISTINCT threshold_version) > 1
""")
def mixed_lineage(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("segment"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 2 == 0), "m2").otherwise("m1").alias("model_version"),
        F.when(F.col("o_orderpriority") == "5-LOW", text(F.col("o_orderkey") % 3)).otherwise("0").alias("threshold_version"))
    return rc.mixed_lineage(orders, ["model_version", "threshold_version"], ["segment"])


@query("monthly_cohorts", """
WITH m AS (SELECT o_orderpriority AS segment, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) * 12 + month(o_orderdate) AS k, count(*) AS n
  FROM (SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN TIMESTAMP '1995-01-15' WHEN '2-HIGH' THEN make_timestamp(1995, 1 + o_custkey % 2, 3, 0, 0, 0)
    WHEN '3-MEDIUM' THEN make_timestamp(1995, 1 + o_custkey % 4, 3, 0, 0, 0) WHEN '5-LOW' THEN make_timestamp(year(o_orderdate), 3, 3, 0, 0, 0) ELSE o_orderdate END AS o_orderdate FROM orders) GROUP BY ALL)
SELECT segment, CASE WHEN count(*) <= 1 THEN 'monthly' ELSE 'rolling' END AS kind, string_agg(month, ',' ORDER BY month) AS utc_months,
  CAST(sum(n) AS BIGINT) AS prediction_count, max(k) - min(k) + 1 = count(*) AND count(*) <= 3 AS acceptable FROM m GROUP BY segment
""")
def monthly_cohorts(spark, sf):
    """One month, two, four, all there are, and every March."""
    at, segment, k = F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_custkey").cast("int")
    day = lambda year, month: F.make_date(year, month, F.lit(3)).cast("timestamp")
    moved = (
        F.when(segment == "1-URGENT", day(F.lit(1995), F.lit(1))).when(segment == "2-HIGH", day(F.lit(1995), 1 + k % 2))
        .when(segment == "3-MEDIUM", day(F.lit(1995), 1 + k % 4)).when(segment == "5-LOW", day(F.year(at), F.lit(3))).otherwise(at.cast("timestamp")))
    orders = table(spark, sf, "orders").select(segment.alias("segment"), moved.alias("prediction_at"))
    return rc.cohort(orders, POLICY, ["segment"])


@query("month_gaps", """
WITH o AS (SELECT date_trunc('month', o_orderdate) AS d, month(o_orderdate) AS m FROM orders),
s AS (SELECT d - CASE WHEN m IN (4, 9) THEN INTERVAL 1 MONTH WHEN m = 10 THEN INTERVAL 2 MONTH ELSE INTERVAL 0 MONTH END AS d FROM o),
m AS (SELECT strftime(d, '%Y-%m') AS month, CAST(year(d) * 12 + month(d) AS INTEGER) AS k, count(*) AS n FROM s GROUP BY ALL)
SELECT k AS month_no, month, n, CAST(k - lag(k) OVER (ORDER BY k) AS INTEGER) AS gap FROM m
""")
def month_gaps(spark, sf):
    """What fell into April, September and October counts for the month before them."""
    at = F.date_trunc("MONTH", "o_orderdate")
    back = F.when(F.month(at).isin(4, 9), 1).when(F.month(at) == 10, 2).otherwise(0)
    return rc.month_gaps(table(spark, sf, "orders").select(F.add_months(at, -back).cast("timestamp").alias("prediction_at")))


@query("document_label_status", """
WITH j AS (SELECT d.lang, count(*) AS n, count(l.doc_id) AS matched FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang)
SELECT lang, n, matched, round(matched / n, 6) AS coverage, CASE WHEN matched = 0 THEN 'not_available' WHEN matched < 50 OR matched / n < 0.42 THEN 'insufficient_data' ELSE 'stable' END AS status FROM j
""")
def document_label_status(spark, sf):
    policy = LabelPolicy(minimum_labels=50, minimum_coverage=0.42)
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    known = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has"))
    counts = docs.join(known, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("matched"))
    out = counts.withColumn("coverage", F.col("matched") / F.col("n"))
    return rounded(out.withColumn("status", rc.evidence_status(F.col("matched"), F.col("coverage"), policy)), 6, "coverage")


@query("lineage_summary", f"""
WITH {RECONCILED_SQL}
SELECT 'model-1' AS model_version, repeat('a', 64) AS model_bundle_sha256, 'v1' AS schema_version, 't1' AS threshold_version, 'r1' AS risk_policy_version,
  0.5e0 AS decision_threshold, 'def-1' AS label_definition_versions FROM pairs LIMIT 1
""")
def lineage_summary(spark, sf):
    return rc.lineage_summary(rc.matched_pairs(rows(spark, sf)))


def cohort_name(at: Column) -> Column:
    """First quarters are fit to be one cohort; May and July have a gap, the other months are too many."""
    kind = F.when(F.month(at) <= 3, "quarter-").when(F.month(at).isin(5, 7), "gap-").otherwise("rest-")
    return F.concat(kind, F.year(at))


def cohort_sql(at: str) -> str:
    return f"CASE WHEN month({at}) <= 3 THEN 'quarter-' WHEN month({at}) IN (5, 7) THEN 'gap-' ELSE 'rest-' END || year({at})"


@query("performance_report", f"""
WITH {RECONCILED_SQL},
own AS (SELECT id, sum(CASE WHEN variants = 1 THEN copies - 1 ELSE 0 END) AS dup, sum(CASE WHEN variants > 1 THEN copies ELSE 0 END) AS con FROM lab_groups GROUP BY id),
ids AS (
  SELECT CASE WHEN p.variants = 1 THEN {cohort_sql('p.prediction_at')} END AS cohort, p.variants, p.copies, o.dup, o.con,
    l.id IS NOT NULL AS labelled, d.id IS NOT NULL AS due, x.id IS NOT NULL AS matched
  FROM pred_groups p FULL JOIN own o ON o.id = p.id LEFT JOIN lab_latest l ON l.id = o.id LEFT JOIN due d ON d.id = p.id LEFT JOIN pairs x ON x.id = p.id),
counts AS (
  SELECT cohort, count(*) FILTER (due) AS mature_predictions, count(*) FILTER (matched) AS joined_labels, count(*) FILTER (due AND NOT matched) AS unmatched_predictions,
    count(*) FILTER (labelled AND NOT matched) AS unmatched_labels, count(*) FILTER (variants = 1 AND NOT due) AS immature_predictions,
    CAST(coalesce(sum(copies - 1) FILTER (variants = 1), 0) AS BIGINT) AS duplicate_predictions, CAST(coalesce(sum(dup), 0) AS BIGINT) AS duplicate_labels,
    CAST(coalesce(sum(copies - 1) FILTER (variants > 1), 0) AS BIGINT) AS conflicting_predictions, CAST(coalesce(sum(con), 0) AS BIGINT) AS conflicting_labels
  FROM ids GROUP BY cohort),
months AS (SELECT DISTINCT {cohort_sql('prediction_at')} AS cohort, year(prediction_at) * 12 + month(prediction_at) AS k FROM due),
unfit AS (SELECT cohort FROM months GROUP BY cohort HAVING count(*) > 3 OR max(k) - min(k) + 1 <> count(*)),
scored AS (SELECT {cohort_sql('prediction_at')} AS cohort, probability AS s, y FROM pairs),
ranked AS (SELECT cohort, s, count(*) AS n, sum(y) AS pos FROM scored GROUP BY cohort, s),
cum AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(pos) OVER g AS tp, sum(n) OVER g AS tn FROM ranked
  WINDOW o AS (PARTITION BY cohort ORDER BY s DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY cohort)),
rank_m AS (SELECT cohort, sum(CASE WHEN tp > 0 THEN pos / tp * cp / cn ELSE 0 END) AS ap, CASE WHEN max(tp) > 0 AND max(tn - tp) > 0 THEN sum((n - pos) * (cp - pos / 2)) / max(tp * (tn - tp)) END AS auc FROM cum GROUP BY cohort),
thr AS (SELECT cohort, avg((s - y) * (s - y)) AS brier, count(*) FILTER (WHERE s >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (WHERE s < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE s < 0.5 AND y = 0) AS tn FROM scored GROUP BY cohort),
judged AS (
  SELECT c.*, CASE WHEN mature_predictions = 0 THEN 0e0 ELSE joined_labels / mature_predictions END AS cov, u.cohort IS NOT NULL AS bad,
    ap, auc, brier, tp, fp, fn, tn
  FROM counts c LEFT JOIN unfit u ON u.cohort = c.cohort LEFT JOIN rank_m r ON r.cohort = c.cohort LEFT JOIN thr t ON t.cohort = c.cohort),
final AS (SELECT *, CASE WHEN bad OR joined_labels = 0 THEN 'not_available' WHEN joined_labels < 100 OR cov < 0.5 THEN 'insufficient_data' ELSE 'stable' END AS status FROM judged)
SELECT 'replayed' AS data_origin, '{AS_OF}' AS as_of, cohort, mature_predictions, joined_labels, unmatched_predictions, unmatched_labels, immature_predictions,
  duplicate_predictions, duplicate_labels, conflicting_predictions, conflicting_labels, round(cov, 6) AS coverage, status, CASE WHEN bad THEN 'cohort' ELSE '' END AS reasons,
  CASE WHEN status = 'stable' THEN round(ap, 6) END AS average_precision, CASE WHEN status = 'stable' THEN round(auc, 6) END AS roc_auc,
  CASE WHEN status = 'stable' THEN round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) END AS precision,
  CASE WHEN status = 'stable' THEN round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) END AS recall,
  CASE WHEN status = 'stable' THEN round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) END AS f1,
  CASE WHEN status = 'stable' THEN round(brier, 6) END AS brier_score, CASE WHEN status = 'stable' THEN tn END AS tn, CASE WHEN status = 'stable' THEN fp END AS fp,
  CASE WHEN status = 'stable' THEN fn END AS fn, CASE WHEN status = 'stable' THEN tp END AS tp FROM final
""")
def performance_report(spark, sf):
    """Cohorts that are evaluated and cohorts that are refused, side by side."""
    run = PerformanceRun(
        predictions(spark, sf), labels(spark, sf), as_of=AS_OF, origin="replayed",
        policy=LabelPolicy(minimum_labels=100, minimum_coverage=0.5))
    return rounded(run.report({"cohort": cohort_name(F.col("prediction_at"))}), 6,
                   "coverage", "average_precision", "roc_auc", "precision", "recall", "f1", "brier_score")


@query("label_calibration", f"""
WITH {RECONCILED_SQL},
b AS (SELECT least(CAST(floor(probability * 5) AS INTEGER), 4) AS bin, probability, y FROM pairs),
g AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS bin)
SELECT g.bin, g.bin / 5e0 AS lower, (g.bin + 1) / 5e0 AS upper, count(b.bin) AS n, round(avg(probability), 6) AS mean_probability, round(avg(y), 6) AS observed_rate
FROM g LEFT JOIN b USING (bin) GROUP BY g.bin
""")
def label_calibration(spark, sf):
    run = PerformanceRun(predictions(spark, sf), labels(spark, sf), as_of=AS_OF, origin="replayed")
    return rounded(run.calibration(), 6, "mean_probability", "observed_rate")


@query("cohort_problems", f"""
WITH {RECONCILED_SQL},
m AS (SELECT DISTINCT strftime(prediction_at, '%Y-%m') AS month, year(prediction_at) * 12 + month(prediction_at) AS k FROM due)
SELECT 'cohort' AS problem, string_agg(month, ',' ORDER BY month) AS detail FROM m HAVING count(*) > 3 OR max(k) - min(k) + 1 <> count(*)
""")
def cohort_problems(spark, sf):
    """Six years of predictions are no rolling cohort; lineage and label definition are fine."""
    run = PerformanceRun(predictions(spark, sf), labels(spark, sf), as_of=AS_OF, origin="replayed")
    return run.problems()


@query("run_input_key")
def run_input_key(spark, sf):
    return rc.input_key(predictions(spark, sf), labels(spark, sf), POLICY, AS_OF, "replayed")


@query("current_predictions", """
WITH p AS (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'm1' ELSE 'm2' END AS model_version, CASE WHEN o_orderpriority < '3' THEN 90 ELSE 30 END AS horizon_days,
  o_orderkey, o_orderdate FROM orders)
SELECT o_custkey, model_version, CAST(horizon_days AS INTEGER) AS horizon_days, max(o_orderkey) FILTER (WHERE o_orderdate = d) AS prediction_id, count(*) - 1 AS superseded
FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey, model_version, horizon_days) AS d FROM p) GROUP BY o_custkey, model_version, horizon_days
""")
def current_predictions(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "m1").otherwise("m2").alias("model_version"),
        F.when(F.col("o_orderpriority") < "3", 90).otherwise(30).alias("horizon_days"),
        F.col("o_orderkey").alias("prediction_id"), F.col("o_orderdate").alias("prediction_at"))
    unit = ["o_custkey", "model_version", "horizon_days"]
    return rc.current_predictions(orders, unit).select(*unit, "prediction_id", "superseded")


# --- comparing results --------------------------------------------------------------


@query("tolerant_difference", """
WITH e AS (SELECT CASE WHEN l_suppkey % 7 = 0 THEN -l_suppkey ELSE l_suppkey END AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey),
a AS (SELECT CASE WHEN l_suppkey % 11 = 0 THEN -1000000 - l_suppkey ELSE l_suppkey END AS k, count(*) + (l_suppkey % 5 = 0)::INT AS n,
  sum(l_quantity) + CASE WHEN l_suppkey % 3 = 0 THEN 0.00005 ELSE 0 END AS q FROM lineitem GROUP BY l_suppkey)
SELECT a.k, 'n' AS field, 'value' AS problem FROM a JOIN e USING (k) WHERE a.n <> e.n
UNION ALL SELECT a.k, 'q', 'value' FROM a JOIN e USING (k) WHERE abs(a.q - e.q) > 1e-4
UNION ALL SELECT k, '*', 'missing' FROM e WHERE k NOT IN (SELECT k FROM a)
UNION ALL SELECT k, '*', 'unexpected' FROM a WHERE k NOT IN (SELECT k FROM e)
""")
def tolerant_difference(spark, sf):
    k = F.col("l_suppkey")
    lines = table(spark, sf, "lineitem")
    totals = lines.groupBy(k.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    s = F.col("s")
    expected = totals.select(F.when(s % 7 == 0, -s).otherwise(s).alias("k"), "n", "q")
    actual = totals.select(F.when(s % 11 == 0, -1000000 - s).otherwise(s).alias("k"), (F.col("n") + (s % 5 == 0).cast("int")).alias("n"),
                           (F.col("q") + F.when(s % 3 == 0, 0.00005).otherwise(0.0)).alias("q"))
    return cp.differences(actual, expected, ["k"], tolerance=1e-4).select("k", "field", "problem")


@query("key_sets", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN -c_custkey ELSE c_custkey END AS k FROM customer) b ON a.k = b.k
""")
def key_sets(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    key = F.col("c_custkey")
    right = table(spark, sf, "customer").select(F.when(key % 4 == 0, -key).otherwise(key).alias("k"))
    return cp.key_sets(left, right, ["k"])
