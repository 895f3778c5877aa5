"""Structured Streaming runs over the driver files, each until all available data is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.operators import profile as pf
from tarnwatch.streaming import drift as sd
from tarnwatch.streaming import labels as sl
from tarnwatch.streaming import lifecycle as sy
from tarnwatch.streaming import telemetry as stt
from tarnwatch.workload.alerts import actions
from tarnwatch.workload.base import iso, labels, predictions, query, rounded, table
from tarnwatch.workload.stores import LATE_SQL, ROLLUP_SQL, rollup_columns, scratch


def stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def stream_of(spark, df):
    """A written batch as a stream source."""
    path = scratch(spark, "source")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def collected(spark, df, mode="append"):
    path = scratch(spark, "stream")
    stt.run_available(df, path, scratch(spark, "stream-checkpoint"), mode)
    return spark.read.schema(df.schema).parquet(path)


@query("streaming_hourly_rollup", f"""
WITH r AS ({ROLLUP_SQL}) SELECT * FROM r
WHERE CAST(window_start AS TIMESTAMP) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 24 HOUR FROM events)
""")
def streaming_hourly_rollup(spark, sf):
    df = stt.hourly_rollup(stream(spark, sf, "events"), "ts", "value", F.col("event_type") == "error")
    return rollup_columns(collected(spark, df))


@query("streaming_daily_windows", """
WITH d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS day, event_type, n FROM d WHERE d + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 24 HOUR FROM events)
""")
def streaming_daily_windows(spark, sf):
    df = stt.daily_windows(stream(spark, sf, "events"), "ts", by=("event_type",))
    return collected(spark, df).withColumn("day", iso("day"))


@query("streaming_late_counts", f"""
WITH {LATE_SQL},
x AS (SELECT CAST(date_trunc('day', arrived) AS TIMESTAMP) AS a, arrived - (CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY) > INTERVAL 24 HOUR AS is_late FROM arr)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS arrival_day, count(*) AS n, count(*) FILTER (WHERE is_late) AS late FROM x
WHERE a + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(arrived)) - INTERVAL 1 HOUR FROM arr) GROUP BY a
""")
def streaming_late_counts(spark, sf):
    events = stream(spark, sf, "events")
    k = F.col("user_id") % 10
    delay = F.when(k == 0, F.expr("INTERVAL 30 HOURS")).when(k == 1, F.expr("INTERVAL 50 HOURS")).otherwise(F.expr("INTERVAL 1 HOURS"))
    df = stt.late_counts(events.withColumn("arrived", F.col("ts") + delay), "ts", "arrived")
    return collected(spark, df).withColumn("arrival_day", iso("arrival_day"))


@query("streaming_redelivery_removal", """
SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type
""")
def streaming_redelivery_removal(spark, sf):
    events = stream(spark, sf, "events")
    twice = events.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("user_id") % 3 == 0, 2).otherwise(1))).alias("copy"))
    df = sl.without_redeliveries(twice, ["event_id"], "ts").select("event_id", "event_type")
    return collected(spark, df).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("streaming_label_join", """
WITH p AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS made FROM orders),
l AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS revision, l_shipdate AS received_at, CASE WHEN l_orderkey % 17 = 0 THEN -1 ELSE o_custkey END AS entity FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT p.id, made, received_at FROM p LEFT JOIN l ON l.id = p.id AND l.entity = p.o_custkey AND received_at >= made AND received_at <= made + INTERVAL 91 DAY),
w AS (SELECT least((SELECT max(made) FROM p), (SELECT max(received_at) FROM l)) - INTERVAL 24 HOUR AS mark)
SELECT strftime(made, '%Y') AS year, count(received_at) AS matches, count(DISTINCT id) FILTER (received_at IS NOT NULL) AS predictions,
  count(*) FILTER (received_at IS NULL) AS unmatched FROM m, w WHERE received_at IS NOT NULL OR made + INTERVAL 91 DAY < mark GROUP BY 1
""")
def streaming_label_join(spark, sf):
    """Stream-stream join with the default delay: matches at once, unmatched predictions when the watermark has passed their
    horizon and their state is dropped."""
    p = stream_of(spark, predictions(spark, sf).dropDuplicates(["prediction_id"]))
    once = labels(spark, sf).dropDuplicates(["prediction_id", "label_revision", "received_at"])
    found = collected(spark, sl.matched_stream(p, stream_of(spark, once)))
    known = F.col("received_at").isNotNull()
    return found.groupBy(F.date_format("prediction_at", "yyyy").alias("year")).agg(
        F.count_if(known).alias("matches"), F.countDistinct(F.when(known, F.col("prediction_id"))).alias("predictions"),
        F.count_if(~known).alias("unmatched"))


def _event_profile(spark, sf):
    first = table(spark, sf, "events").where(F.dayofmonth("ts") <= 10)
    return pf.build_profile(first, numeric=("value",), categorical=("event_type",))


PSI_SQL = """
WITH ref AS (SELECT value + 0e0 AS value FROM events WHERE day(ts) <= 10),
e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(value, [0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0, 1e0]), lambda x: round(x, 8)))) AS edges FROM ref),
b AS (SELECT CAST(u.i AS INTEGER) AS i, edges[u.i + 1] AS lo, edges[u.i + 2] AS hi FROM e, LATERAL (SELECT unnest(range(0, len(edges) - 1)) AS i) u),
r AS (SELECT b.i, lo, hi, count(ref.value) AS r FROM b LEFT JOIN ref ON (ref.value > lo AND ref.value <= hi) OR (b.i = 0 AND ref.value = lo) GROUP BY ALL),
d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, value + 0e0 AS value FROM events),
n AS (SELECT d, count(*) AS n FROM d GROUP BY d),
c AS (SELECT d.d, r.i, count(*) AS c FROM d JOIN r ON (d.value > lo AND d.value <= hi) OR (r.i = 0 AND d.value = lo) GROUP BY ALL),
g AS (SELECT n.d, n.n, r.i, r.r, coalesce(c.c, 0) AS c FROM n CROSS JOIN r LEFT JOIN c ON c.d = n.d AND c.i = r.i),
s AS (SELECT d, n, r / sum(r) OVER w AS rs, c / greatest(sum(c) OVER w, 1) AS cs FROM g WINDOW w AS (PARTITION BY d))
SELECT strftime(d, '%Y-%m-%dT%H:%M:%S') AS window_id, n, CASE WHEN n >= 30 THEN round(sum((cs - rs) * ln((cs + 1e-6) / (rs + 1e-6))), 6) END AS psi FROM s
WHERE d + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 24 HOUR FROM events) GROUP BY d, n
"""


@query("streaming_numeric_drift", PSI_SQL)
def streaming_numeric_drift(spark, sf):
    path = scratch(spark, "drift")
    sd.monitor_stream(stream(spark, sf, "events"), _event_profile(spark, sf), "ts", path=path, checkpoint=scratch(spark, "drift-checkpoint"))
    return rounded(spark.read.option("recursiveFileLookup", True).parquet(path).select("window_id", "n", "psi"), 6, "psi")


@query("streaming_categorical_drift", """
WITH r AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS p FROM events WHERE day(ts) <= 10 GROUP BY event_type),
c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, event_type, count(*) AS c FROM events GROUP BY ALL),
g AS (SELECT n.d, n.n, r.event_type, r.p, coalesce(c.c, 0) / n.n AS q FROM (SELECT d, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY d) n CROSS JOIN r LEFT JOIN c ON c.d = n.d AND c.event_type = r.event_type),
j AS (SELECT d, n, sqrt(greatest(0, sum(p * ln(p / ((p + q) / 2)) + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS jsd FROM g GROUP BY d, n)
SELECT strftime(d, '%Y-%m-%dT%H:%M:%S') AS window_id, 'event_type' AS feature, n, round(jsd, 6) AS jensen_shannon,
  CASE WHEN jsd >= 0.2 THEN 'critical' WHEN jsd >= 0.1 THEN 'warning' WHEN jsd >= 0.05 THEN 'watch' ELSE 'stable' END AS status FROM j
WHERE d + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 24 HOUR FROM events)
""")
def streaming_categorical_drift(spark, sf):
    path = scratch(spark, "drift")
    sd.monitor_stream(
        stream(spark, sf, "events"), _event_profile(spark, sf), "ts", path=path, checkpoint=scratch(spark, "drift-checkpoint"), kind="categorical")
    return rounded(spark.read.option("recursiveFileLookup", True).parquet(path).select("window_id", "feature", "n", "jensen_shannon", "status"), 6, "jensen_shannon")


LIFECYCLE_SQL = """
WITH RECURSIVE acts AS (
  SELECT user_id AS alert_id, ts, event_id, event_id % 7 <> 0 AS ok, CASE event_type WHEN 'click' THEN 'acknowledge' WHEN 'purchase' THEN 'resolve' WHEN 'error' THEN 'suppress' ELSE 'reopen' END AS action,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
run AS (
  SELECT DISTINCT alert_id, CAST(0 AS BIGINT) AS k, 'open' AS state, 0 AS accepted FROM acts
  UNION ALL
  SELECT r.alert_id, a.k, CASE WHEN NOT a.ok THEN r.state WHEN r.state = 'open' AND a.action = 'acknowledge' THEN 'acknowledged' WHEN r.state IN ('open', 'acknowledged') AND a.action = 'suppress' THEN 'suppressed'
    WHEN r.state = 'acknowledged' AND a.action = 'resolve' THEN 'resolved' ELSE r.state END,
    CASE WHEN a.ok AND ((r.state = 'open' AND a.action IN ('acknowledge', 'suppress')) OR (r.state = 'acknowledged' AND a.action IN ('resolve', 'suppress'))) THEN 1 ELSE 0 END
  FROM run r JOIN acts a ON a.alert_id = r.alert_id AND a.k = r.k + 1)
SELECT CAST(alert_id AS VARCHAR) AS alert_id, state, count(*) AS n, CAST(sum(accepted) AS BIGINT) AS accepted FROM run WHERE k > 0 GROUP BY ALL
"""


@query("streaming_alert_lifecycle", LIFECYCLE_SQL)
def streaming_alert_lifecycle(spark, sf):
    """State after every action, counted per alert and state."""
    log = actions(spark, sf).withColumn("action_id", F.lpad(F.col("action_id").cast("string"), 20, "0"))
    home = scratch(spark, "lifecycle")
    sy.run_lifecycle(stream_of(spark, log), home, scratch(spark, "lifecycle-checkpoint"))
    return sy.history(spark, home).groupBy("alert_id", "state").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("accepted")).alias("accepted"))
