"""Alerts from daily event evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.config import AlertPolicy, DriftPolicy
from tarnwatch.operators import alerts as al
from tarnwatch.operators import drift as dr
from tarnwatch.operators.contract import rule_counts
from tarnwatch.workload.base import EVIDENCE_SQL, evidence, iso, iso_sql, query, table, text, windows
from tarnwatch.workload.drifts import PLAIN_CATEGORY_SQL
from tarnwatch.workload.profiles import reference_profile

POLICY = AlertPolicy(minimum_sample_size=10)


@query("qualified_evidence", f"""
WITH {EVIDENCE_SQL} SELECT source_result_id, domain, source_status, signal, window_id, {iso_sql('window_end')} AS window_end, sample_size FROM qual
""")
def qualified_evidence(spark, sf):
    return al.qualifying(evidence(spark, sf)).select(
        "source_result_id", "domain", "source_status", "signal", "window_id", iso("window_end").alias("window_end"), "sample_size")


@query("evidence_families", f"""
WITH {EVIDENCE_SQL} SELECT domain, signal, count(*) AS n FROM qual GROUP BY domain, signal
""")
def evidence_families(spark, sf):
    rows = al.with_family(al.qualifying(evidence(spark, sf)))
    return rows.groupBy("family", "domain", "signal").agg(F.count(F.lit(1)).alias("n")).drop("family")


@query("evidence_row_validity", f"""
WITH {EVIDENCE_SQL},
m AS (SELECT list_sort(list_filter([CASE WHEN sample_size % 2 = 0 THEN 'data_origin:domain' END, CASE WHEN sample_size % 3 = 0 THEN 'label_coverage:range' END,
  CASE WHEN sample_size % 5 = 0 THEN 'signal:not_empty' END], lambda x: x IS NOT NULL)) AS f FROM evid)
SELECT array_to_string(f, ',') AS failed, count(*) AS n FROM m GROUP BY ALL
""")
def evidence_row_validity(spark, sf):
    n = F.col("sample_size")
    rows = evidence(spark, sf).withColumns({
        "data_origin": F.when(n % 2 == 0, "guess").otherwise(F.col("data_origin")),
        "label_coverage": F.when(n % 3 == 0, 1.5).otherwise(F.col("label_coverage")),
        "signal": F.when(n % 5 == 0, "").otherwise(F.col("signal"))})
    return rule_counts(rows, al.EVIDENCE_RULES)


@query("tail_runs", f"""
WITH {EVIDENCE_SQL} SELECT signal, run_length, {iso_sql('run_start')} AS run_start, {iso_sql('run_end')} AS run_end FROM tails
""")
def tail_runs(spark, sf):
    runs = al.tail_runs(al.qualifying(evidence(spark, sf)), ["signal"], "window_end", 2)
    return runs.select("signal", "run_length", iso("run_start").alias("run_start"), iso("run_end").alias("run_end"))


@query("tail_runs_of_events", """
WITH q AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS brk FROM events),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM q),
t AS (SELECT *, max(isl) OVER (PARTITION BY user_id) AS last FROM i)
SELECT user_id, count(*) AS run_length, CAST(epoch_us(min(ts)) AS BIGINT) AS run_start FROM t WHERE isl = last GROUP BY user_id
""")
def tail_runs_of_events(spark, sf):
    runs = al.tail_runs(table(spark, sf, "events"), ["user_id"], "ts", 1)
    return runs.select("user_id", "run_length", F.unix_micros("run_start").alias("run_start"))


@query("latest_evidence", f"""
WITH {EVIDENCE_SQL} SELECT signal, source_result_id, source_status, window_id FROM newest
""")
def latest_evidence(spark, sf):
    return al.latest_evidence(al.qualifying(evidence(spark, sf)), ["signal"]).select("signal", "source_result_id", "source_status", "window_id")


@query("open_alerts", f"""
WITH {EVIDENCE_SQL}
SELECT domain, CASE WHEN immediate THEN 'critical' ELSE 'warning' END AS severity, 'open' AS state, signal, domain || ':' || source_status AS reason,
  source_result_id, window_id, sample_size, run_length AS persistence_count FROM alerts WHERE immediate OR run_length >= 2
""")
def open_alerts(spark, sf):
    return al.open_alerts(evidence(spark, sf), POLICY).select(
        "domain", "severity", "state", "signal", "reason", "source_result_id", "window_id", "sample_size", "persistence_count")


@query("retraining_recommendations", f"""
WITH {EVIDENCE_SQL.replace("CASE WHEN top > 300", "CASE WHEN event_type = 'purchase' OR top > 300")}
SELECT source_result_id, 'candidate' AS status, sample_size, label_coverage, false AS promotion_approved FROM alerts
WHERE domain = 'performance' AND immediate AND sample_size >= 1 AND coalesce(label_coverage, 0) >= 0.8
""")
def retraining_recommendations(spark, sf):
    """Performance evidence is critical on all days; data quality and operations stay as they are and recommend nothing."""
    policy = AlertPolicy(minimum_sample_size=1)
    rows = evidence(spark, sf)
    rows = rows.withColumn("source_status", F.when(F.col("domain") == "performance", "critical").otherwise(F.col("source_status")))
    return al.recommendations(al.open_alerts(rows, policy), policy).select(
        "source_result_id", "status", "sample_size", "label_coverage", "promotion_approved")


@query("evaluation_key")
def evaluation_key(spark, sf):
    return al.evidence_key(evidence(spark, sf), POLICY)


def actions(spark, sf):
    """Events as a log of actions on alerts: one alert per user, some actions incomplete."""
    k = F.col("event_id") % 7
    return table(spark, sf, "events").select(
        text("user_id").alias("alert_id"), F.col("event_id").alias("action_id"), F.col("ts").alias("at"),
        F.when(F.col("event_type") == "click", "acknowledge").when(F.col("event_type") == "purchase", "resolve")
        .when(F.col("event_type") == "error", "suppress").otherwise("reopen").alias("action"),
        F.when(k == 0, "").otherwise("actor").alias("actor_id"), F.lit("because").alias("reason"))


ACTIONS_SQL = """
acts AS (SELECT user_id AS alert_id, event_id, ts, CASE event_type WHEN 'click' THEN 'acknowledge' WHEN 'purchase' THEN 'resolve' WHEN 'error' THEN 'suppress' ELSE 'reopen' END AS action,
  event_id % 7 <> 0 AS ok FROM events),
a AS (SELECT alert_id, count(*) AS total, min((ts, event_id)) FILTER (WHERE ok AND action = 'acknowledge') AS ack, min((ts, event_id)) FILTER (WHERE ok AND action = 'suppress') AS sup FROM acts GROUP BY alert_id),
r AS (SELECT a.alert_id, min((ts, event_id)) AS res FROM acts JOIN a USING (alert_id) WHERE ok AND action = 'resolve' AND (ts, event_id) > a.ack GROUP BY a.alert_id),
f AS (SELECT a.*, r.res, sup IS NOT NULL AND (ack IS NULL OR sup < ack) AS direct FROM a LEFT JOIN r USING (alert_id)),
st AS (SELECT *, CASE WHEN direct THEN 'suppressed' WHEN ack IS NULL THEN 'open' WHEN sup IS NULL AND res IS NULL THEN 'acknowledged'
  WHEN sup IS NULL OR res < sup THEN 'resolved' ELSE 'suppressed' END AS state FROM f),
ac AS (SELECT *, CASE WHEN direct THEN 1 WHEN state = 'open' THEN 0 WHEN state = 'acknowledged' THEN 1 ELSE 2 END AS accepted FROM st)
"""


@query("alert_lifecycle", f"""
WITH {ACTIONS_SQL} SELECT CAST(alert_id AS VARCHAR) AS alert_id, state, CAST(accepted AS BIGINT) AS accepted, total - accepted AS rejected FROM ac
""")
def alert_lifecycle(spark, sf):
    return al.lifecycle(actions(spark, sf)).drop("changed_at")


@query("alert_action_history", f"""
WITH {ACTIONS_SQL} SELECT state, count(*) AS alerts, CAST(sum(accepted) AS BIGINT) AS actions FROM ac WHERE accepted > 0 GROUP BY state
""")
def alert_action_history(spark, sf):
    log = actions(spark, sf)
    taken = al.action_history(log).groupBy("alert_id").agg(F.count(F.lit(1)).alias("taken"))
    return al.lifecycle(log).join(taken, "alert_id").groupBy("state").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("taken").alias("actions"))


@query("clean_families", f"""
WITH {EVIDENCE_SQL},
w AS (SELECT signal, window_id, max(window_end) AS window_end, bool_and(source_status = 'stable') AS clean FROM evid GROUP BY ALL),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY signal ORDER BY window_end DESC, window_id DESC) <= 2)
SELECT signal, count(*) = 2 AND bool_and(clean) AND max(window_end) - min(window_end) <= INTERVAL 1 DAY AS clean FROM l GROUP BY signal
""")
def clean_families(spark, sf):
    """Every result comes twice, so a window must not count for two."""
    rows = evidence(spark, sf)
    rows = rows.unionByName(rows.withColumn("source_result_id", F.concat("source_result_id", F.lit("-again"))))
    clean = al.clean_tail(rows, 2).withColumn("clean", F.lit(True))
    families = al.with_family(rows).select("family", "signal").distinct()
    return families.join(clean, "family", "left").select("signal", F.coalesce("clean", F.lit(False)).alias("clean"))


@query("repeat_suppression", """
WITH RECURSIVE base AS (
  SELECT user_id % 7 AS family, ts, event_id, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS severity FROM events
  UNION ALL SELECT -1, TIMESTAMP '2024-02-01' + INTERVAL 12 HOUR * event_id, event_id, CASE WHEN event_id = 5 THEN 1 ELSE 0 END FROM events WHERE event_id < 20),
e AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ts, event_id) AS n FROM base),
d(family, n, ts, severity) AS (
  SELECT family, n, ts, severity FROM e WHERE n = 1
  UNION ALL SELECT x.family, x.n, x.ts, x.severity FROM (
    SELECT e.family, e.n, e.ts, e.severity, row_number() OVER (PARTITION BY e.family ORDER BY e.n) AS k
    FROM d JOIN e ON e.family = d.family AND e.n > d.n AND (e.ts >= d.ts + INTERVAL 24 HOUR OR e.severity > d.severity)) x WHERE k = 1)
SELECT e.family, e.event_id, d.n IS NOT NULL AS delivered FROM e LEFT JOIN d ON d.family = e.family AND d.n = e.n
""")
def repeat_suppression(spark, sf):
    """Families of users with three severities; and one family that emits every 12 hours for ten days and gets worse once."""
    events = table(spark, sf, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    base = events.select((F.col("user_id") % 7).alias("family"), "ts", "event_id",
                         F.when(kind == "error", 2).when(kind == "purchase", 1).otherwise(0).alias("severity"))
    steady = events.where("event_id < 20").select(
        F.lit(-1).cast("long").alias("family"), F.timestamp_micros(F.unix_micros(F.lit("2024-02-01").cast("timestamp")) + n * 43_200_000_000).cast(
            events.schema["ts"].dataType).alias("ts"), "event_id", F.when(n == 5, 1).otherwise(0).alias("severity"))
    rows = base.withColumn("family", F.col("family").cast("long")).unionByName(steady)
    return al.delivery_decisions(rows, ["family"], "ts", "event_id", F.col("severity")).select("family", "event_id", "delivered")


@query("lifted_statuses", f"""
WITH {PLAIN_CATEGORY_SQL},
t AS (SELECT window_id, CASE WHEN jsd >= 0.02 THEN 'critical' WHEN jsd >= 0.015 THEN 'warning' WHEN jsd >= 0.002 THEN 'watch' ELSE 'stable' END AS distribution_status,
  smallest >= 5 AND exp(-chi / 2) < 0.3 AS lifts FROM cat_drift WHERE feature = 'l_returnflag')
SELECT window_id, distribution_status, CASE WHEN distribution_status = 'watch' AND lifts THEN 'warning' ELSE distribution_status END AS lifted FROM t
""")
def lifted_statuses(spark, sf):
    """With narrow limits and one feature, so that p-values need no adjustment."""
    policy = DriftPolicy(jensen_shannon=(0.002, 0.015, 0.02))
    rows = dr.feature_evidence(windows(spark, sf), reference_profile(spark, sf, numeric=(), categorical=("l_returnflag",)), policy)
    return rows.select("window_id", "distribution_status", al.lifted_status(rows, alpha=0.3).alias("lifted"))
