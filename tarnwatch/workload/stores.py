"""Metric records, dashboard reads, public export, telemetry, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwatch.config import ExportPolicy, StorePolicy
from tarnwatch.operators import export as ex
from tarnwatch.operators import store as st
from tarnwatch.operators import telemetry as te
from tarnwatch.session import shared_folder
from tarnwatch.sources import files, manifest, results
from tarnwatch.workload.base import RECORDS_SQL, iso, iso_sql, query, records, rounded, table

NOW = "2024-01-31 06:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/tarnwatch/{name}-{uuid.uuid4().hex}"


# --- store ---------------------------------------------------------------------------

def batch_of_records(spark, sf):
    """Records with exact repeats, conflicting copies and invalid rows."""
    base = records(spark, sf)
    n = F.col("sample_size")
    hour = F.hour("window_start")
    again = base.where(hour % 3 == 0)
    other = base.where(hour % 5 == 0).withColumns({
        "status": F.lit("critical"), "computed_at": F.col("computed_at") + F.expr("INTERVAL 1 HOUR")})
    broken = base.where(n % 4 == 0).withColumns({
        "result_id": F.concat(F.lit("bad-"), "result_id"), "distribution": F.lit('{"customer_id": 1}')})
    # A spoiled copy of the same result, computed an hour before the good one: it must not take that with it.
    spoiled = base.where(hour % 7 == 0).withColumns({
        "sample_size": F.lit(-1).cast("long"), "computed_at": F.col("computed_at") - F.expr("INTERVAL 1 HOUR")})
    return base.unionByName(again).unionByName(other).unionByName(broken).unionByName(spoiled)


BATCH_SQL = f"""
{RECORDS_SQL},
outcomes AS (
  SELECT result_id, CASE WHEN hour(window_start) % 3 = 0 THEN 2 ELSE 1 END AS copies, 'fresh' AS kind, window_start FROM recs
  UNION ALL SELECT result_id, 1, 'other', window_start FROM recs WHERE hour(window_start) % 5 = 0
  UNION ALL SELECT 'bad-' || result_id, 1, 'invalid', window_start FROM recs WHERE sample_size % 4 = 0
  UNION ALL SELECT result_id, 1, 'invalid', window_start FROM recs WHERE hour(window_start) % 7 = 0)
"""


@query("ingest_outcomes", f"""
WITH {BATCH_SQL}
SELECT result_id, CAST(copies AS BIGINT) AS copies, CASE kind WHEN 'invalid' THEN 'invalid' WHEN 'other' THEN 'conflict'
  ELSE CASE WHEN day(window_start) <= 10 THEN 'reused' ELSE 'ingested' END END AS outcome FROM outcomes
""")
def ingest_outcomes(spark, sf):
    """The store already holds the first ten days when the batch arrives."""
    stored = records(spark, sf).where(F.dayofmonth("window_start") <= 10).withColumn("idempotency_key", st.idempotency_key())
    return st.ingest_plan(batch_of_records(spark, sf), stored).select("result_id", "copies", "outcome")


@query("stored_results", f"""
WITH {RECORDS_SQL} SELECT result_type, strftime(window_end, '%Y-%m') AS window_month, count(*) AS n, CAST(sum(sample_size) AS BIGINT) AS sample_size FROM recs GROUP BY ALL
""")
def stored_results(spark, sf):
    """Two ingests of overlapping batches leave every record once, partitioned by type and month."""
    store = st.MetricsTable(spark, scratch(spark, "store"))
    store.ingest(records(spark, sf).where(F.dayofmonth("window_start") <= 20))
    store.ingest(batch_of_records(spark, sf))
    return store.read().groupBy("result_type", "window_month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sample_size").alias("sample_size"))


@query("store_dimensions", f"""
WITH {RECORDS_SQL}
SELECT 'model_version' AS dimension, model_version AS value, {iso_sql('min(computed_at)')} AS created_at, NULL AS serves FROM recs GROUP BY model_version
UNION ALL SELECT 'deployment_id', deployment_id, {iso_sql('min(computed_at)')}, arg_min(model_version, (computed_at, result_id)) FROM recs WHERE deployment_id IS NOT NULL GROUP BY deployment_id
""")
def store_dimensions(spark, sf):
    rows = records(spark, sf)
    parts = [
        st.first_seen(rows, c).select(
            F.lit(c).alias("dimension"), F.col(c).alias("value"), iso("created_at").alias("created_at"),
            (F.col("model_version") if c == "deployment_id" else F.lit(None).cast("string")).alias("serves"))
        for c in ("model_version", "deployment_id")]
    return parts[0].unionByName(parts[1])


@query("retention", f"""
WITH {RECORDS_SQL}
SELECT result_type, count(*) FILTER (WHERE window_end < TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS expired, count(*) FILTER (WHERE window_end >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS kept
FROM recs GROUP BY result_type
""")
def retention(spark, sf):
    policy, rows = StorePolicy(retention_days=14), records(spark, sf)
    old = st.expired(rows, now(), policy).select("result_type", F.lit(1).alias("expired"), F.lit(0).alias("kept"))
    new = st.retained(rows, now(), policy).select("result_type", F.lit(0).alias("expired"), F.lit(1).alias("kept"))
    return old.unionByName(new).groupBy("result_type").agg(F.sum("expired").alias("expired"), F.sum("kept").alias("kept"))


@query("retention_of_stored_results", f"""
WITH {RECORDS_SQL} SELECT result_type, count(*) AS n FROM recs WHERE window_end >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY result_type
""")
def retention_of_stored_results(spark, sf):
    store = st.MetricsTable(spark, scratch(spark, "store"))
    store.ingest(records(spark, sf))
    store.apply_retention(NOW, StorePolicy(retention_days=14))
    return store.read().groupBy("result_type").agg(F.count(F.lit(1)).alias("n"))


@query("newest_results", f"""
WITH {RECORDS_SQL} SELECT result_id, status, {iso_sql('window_end')} AS window_end FROM recs ORDER BY recs.window_end DESC, result_id LIMIT 50
""")
def newest_results(spark, sf):
    return st.newest(records(spark, sf), 50).select("result_id", "status", iso("window_end").alias("window_end"))


@query("dashboard_state", f"""
WITH {RECORDS_SQL}, l AS (SELECT * FROM recs ORDER BY window_end DESC, result_id LIMIT 1)
SELECT status AS state, CASE WHEN TIMESTAMP '{NOW}' - window_end <= INTERVAL 24 HOUR THEN 'fresh' WHEN TIMESTAMP '{NOW}' - window_end <= INTERVAL 48 HOUR THEN 'late' ELSE 'stale' END AS freshness,
  {iso_sql('window_end')} AS window_end, CAST(floor(epoch(TIMESTAMP '{NOW}') - epoch(window_end)) AS BIGINT) AS age_seconds FROM l
""")
def dashboard_state(spark, sf):
    return st.latest_state(records(spark, sf), now()).withColumn("window_end", iso("window_end"))


@query("freshness_ladder", f"""
WITH {RECORDS_SQL}, l AS (SELECT model_version, max(window_end) AS w FROM recs GROUP BY model_version)
SELECT model_version, CASE WHEN TIMESTAMP '{NOW}' - w <= INTERVAL 24 HOUR THEN 'fresh' WHEN TIMESTAMP '{NOW}' - w <= INTERVAL 48 HOUR THEN 'late' ELSE 'stale' END AS freshness FROM l
""")
def freshness_ladder(spark, sf):
    latest = records(spark, sf).groupBy("model_version").agg(F.max("window_end").alias("w"))
    return latest.select("model_version", st.freshness(F.col("w"), now(), StorePolicy()).alias("freshness"))


# --- export ----------------------------------------------------------------------------

@query("export_sources", f"""
WITH {RECORDS_SQL} SELECT result_type, count(*) AS n FROM recs WHERE result_type <> 'recommendation' GROUP BY result_type
""")
def export_sources(spark, sf):
    kind = F.when(F.col("result_type") == "recommendation", "public_snapshot").otherwise(F.col("result_type"))
    return st.exportable(records(spark, sf).withColumn("result_type", kind)).groupBy("result_type").agg(F.count(F.lit(1)).alias("n"))


@query("export_source_validation", f"""
WITH {RECORDS_SQL},
m AS (SELECT list_sort(list_filter([CASE WHEN sample_size % 2 = 0 THEN 'data_origin:domain' END, CASE WHEN sample_size % 3 = 0 THEN 'model_version:present' END], lambda x: x IS NOT NULL)) AS f FROM recs)
SELECT array_to_string(f, ',') AS failed, count(*) AS n FROM m WHERE len(f) > 0 GROUP BY ALL
""")
def export_source_validation(spark, sf):
    n = F.col("sample_size")
    rows = records(spark, sf).withColumns({
        "data_origin": F.when(n % 2 == 0, "guess").otherwise(F.col("data_origin")),
        "model_version": F.when(n % 3 != 0, F.col("model_version"))})
    _, bad = ex.split_sources(rows)
    return bad.groupBy(F.array_join(F.array_sort("failed_rules"), ",").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query("small_group_suppression", f"""
WITH {RECORDS_SQL}
SELECT result_id, CASE WHEN sample_size < 4 THEN 'suppressed' ELSE status END AS evidence_state, CASE WHEN sample_size < 4 THEN 'minimum_group_size' END AS suppression_reason,
  CASE WHEN sample_size >= 4 THEN sample_size END AS shown_sample_size, CASE WHEN sample_size >= 4 THEN {iso_sql('window_end')} END AS observed_end FROM recs
""")
def small_group_suppression(spark, sf):
    rows = ex.public_rows(records(spark, sf), ExportPolicy(minimum_group_size=4))
    return rows.select("result_id", "evidence_state", "suppression_reason", "shown_sample_size", iso("observed_end").alias("observed_end"))


@query("newest_per_section", f"""
WITH {RECORDS_SQL},
s AS (SELECT result_id, CASE result_type WHEN 'telemetry' THEN 'service' WHEN 'alert' THEN 'alerts' WHEN 'recommendation' THEN 'recommendations' ELSE result_type END AS section,
  row_number() OVER (PARTITION BY result_type ORDER BY window_end DESC, result_id) AS rn FROM recs)
SELECT section, CAST(rn AS INTEGER) AS rn, result_id FROM s WHERE rn <= 100
""")
def newest_per_section(spark, sf):
    return ex.newest_per_section(ex.public_rows(records(spark, sf))).select("section", "rn", "result_id")


@query("model_history", f"""
WITH {RECORDS_SQL}
SELECT model_version, data_origin, {iso_sql('window_end')} AS latest_observed_window_end FROM recs
QUALIFY row_number() OVER (PARTITION BY model_version ORDER BY window_end DESC, result_id) = 1
""")
def model_history(spark, sf):
    return ex.model_history(records(spark, sf)).select(
        "model_version", "data_origin", iso("latest_observed_window_end").alias("latest_observed_window_end"))


def _snapshot(spark, sf):
    return ex.snapshot(records(spark, sf), "2024-02-01T00:00:00Z", ExportPolicy(minimum_group_size=4))


@query("public_snapshot")
def public_snapshot(spark, sf):
    return _snapshot(spark, sf)


@query("public_resources", f"""
WITH {RECORDS_SQL}, l AS (SELECT * FROM recs ORDER BY window_end DESC, result_id LIMIT 1)
SELECT 'models/current' AS resource, '{{"model_version":"' || model_version || '","data_origin":"' || data_origin || '","observed_window_end":"' || strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS data FROM l
UNION ALL SELECT 'methodology', '{{"candidate_mode":true,"minimum_group_size":4,"data_origin_required":true}}'
UNION ALL SELECT 'overview', '{{"evidence_state":"' || status || '","data_origins":["replayed","synthetic"],"latest_observed_window_end":"' || strftime(window_end, '%Y-%m-%dT%H:%M:%SZ') || '","candidate_mode":true}}' FROM l
""")
def public_resources(spark, sf):
    doc = _snapshot(spark, sf)
    named = F.array(*[F.struct(F.lit(n).alias("resource"), F.get_json_object("payload", ex.RESOURCES[n]).alias("data")) for n in (
        "overview", "models/current", "methodology")])
    return doc.select(F.inline(named))


@query("snapshot_after_failure", f"""
WITH {RECORDS_SQL}
SELECT '2024-02-01T00:00:00Z' AS generated_at, 'stale' AS freshness, 'export_failed' AS reason, '2024-02-02T00:00:00Z' AS last_failure_at FROM recs LIMIT 1
""")
def snapshot_after_failure(spark, sf):
    """A later export of broken rows leaves the last snapshot up, marked stale."""
    log = ex.SnapshotLog(spark, scratch(spark, "snapshots"))
    log.export(records(spark, sf), "2024-02-01T00:00:00Z")
    broken = records(spark, sf).withColumn("data_origin", F.lit("guess"))
    return log.export(broken, "2024-02-02T00:00:00Z").select("generated_at", "freshness", "reason", "last_failure_at")


# --- telemetry ---------------------------------------------------------------------------

@query("telemetry_value_counts", """
SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT 'weekday', CAST(isodow(ts) AS VARCHAR), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'value_bin', CASE WHEN value < 35 THEN '0-34.99' WHEN value < 70 THEN '35-69.99' WHEN value < 100 THEN '70-99.99' ELSE '100+' END, count(*) FROM events GROUP BY 2
""")
def telemetry_value_counts(spark, sf):
    from tarnwatch.functions.expressions import left_closed_labels
    from tarnwatch.presets import CHARGE_REPORT_LABELS, CHARGE_REPORT_UPPERS

    return te.value_counts(table(spark, sf, "events"), {
        "event_type": F.col("event_type"), "weekday": F.weekday("ts") + 1,
        "value_bin": left_closed_labels(F.col("value"), CHARGE_REPORT_UPPERS, CHARGE_REPORT_LABELS)})


@query("latency_histogram", """
WITH b AS (SELECT unnest([10, 25, 50, 100, 250, 500, 1000]) AS le)
SELECT event_type, CAST(le AS VARCHAR) AS le, count(*) FILTER (WHERE value <= le) AS n, round(sum(value), 3) AS latency_sum, count(*) AS latency_count FROM events, b GROUP BY event_type, le
UNION ALL SELECT event_type, '+Inf', count(*), round(sum(value), 3), count(*) FROM events GROUP BY event_type
""")
def latency_histogram(spark, sf):
    return rounded(te.latency_histogram(table(spark, sf, "events"), "value", ["event_type"]), 3, "latency_sum")


ROLLUP_SQL = """
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
  round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate, count(*) FILTER (WHERE value <= 100) AS le_100, count(*) AS le_inf, round(sum(value), 3) AS latency_sum
FROM (SELECT *, date_trunc('hour', ts) AS h FROM events) GROUP BY h
"""


def rollup_columns(df):
    out = df.select(iso("window_start").alias("window_start"), "requests", "errors", "error_rate", "le_100", "le_inf", "latency_sum")
    return rounded(rounded(out, 6, "error_rate"), 3, "latency_sum")


@query("hourly_rollup", ROLLUP_SQL)
def hourly_rollup(spark, sf):
    return rollup_columns(te.rollup(table(spark, sf, "events"), "ts", "value", F.col("event_type") == "error"))


@query("hourly_latency_p95", """
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, round(quantile_cont(value, 0.95e0), 6) + 0e0 AS latency_p95_ms
FROM (SELECT date_trunc('hour', ts) AS h, value + 0e0 AS value FROM events) GROUP BY h
""")
def hourly_latency_p95(spark, sf):
    out = te.latency_p95(table(spark, sf, "events"), "ts", "value")
    return rounded(out.select(iso("window_start").alias("window_start"), "latency_p95_ms"), 6, "latency_p95_ms")


LATE_SQL = """
arr AS (SELECT *, ts + CASE WHEN user_id % 10 = 0 THEN INTERVAL 30 HOUR WHEN user_id % 10 = 1 THEN INTERVAL 50 HOUR ELSE INTERVAL 1 HOUR END AS arrived FROM events)
"""


def arrivals(spark, sf):
    k = F.col("user_id") % 10
    delay = F.when(k == 0, F.expr("INTERVAL 30 HOURS")).when(k == 1, F.expr("INTERVAL 50 HOURS")).otherwise(F.expr("INTERVAL 1 HOURS"))
    return table(spark, sf, "events").withColumn("arrived", F.col("ts") + delay)


@query("day_windows_and_late_rows", f"""
WITH {LATE_SQL}
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS day, count(*) FILTER (WHERE arrived - (d + INTERVAL 1 DAY) <= INTERVAL 24 HOUR) AS on_time,
  count(*) FILTER (WHERE arrived - (d + INTERVAL 1 DAY) > INTERVAL 24 HOUR) AS late FROM (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM arr) GROUP BY d
""")
def day_windows_and_late_rows(spark, sf):
    return te.day_windows(arrivals(spark, sf), "ts", "arrived").withColumn("day", iso("day"))


# --- sources and sinks -----------------------------------------------------------------------

@query("csv_round_trip", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS p_name, p_size, p_retailprice FROM part
""")
def csv_round_trip(spark, sf):
    """Written and scanned again; blanks come back as blanks."""
    parts = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("p_name"), "p_size", "p_retailprice")
    path = scratch(spark, "csv")
    files.write_csv(parts, path)
    return files.read_csv(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double", ["p_name"])


@query("json_lines_round_trip", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS prediction_at, o_totalprice FROM orders
""")
def json_lines_round_trip(spark, sf):
    """ISO-8601 text with Z becomes an instant again."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("prediction_at"), "o_totalprice")
    path = scratch(spark, "json")
    orders.write.json(path)
    return files.read_json_lines(spark, path, "o_orderkey long, prediction_at timestamp, o_totalprice double").withColumn(
        "prediction_at", iso("prediction_at"))


@query("records_document_round_trip", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0
""")
def records_document_round_trip(spark, sf):
    """One document with a records array per customer; rows without a required field are left out."""
    orders = table(spark, sf, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    docs = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("records"))
    path = scratch(spark, "documents")
    docs.select("records").write.json(path)
    return files.read_records_document(
        spark, path, "o_orderkey long, o_orderpriority string", ["o_orderkey", "o_orderpriority"], one_per_file=False)


@query("write_once_result", """
SELECT event_type, count(*) AS n, true AS reused FROM events GROUP BY event_type
""")
def write_once_result(spark, sf):
    folder = scratch(spark, "results")
    compute = lambda: table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    results.write_once(spark, folder, {"table": "events", "version": 1}, compute)
    again = results.write_once(spark, folder, {"version": 1, "table": "events"}, compute)
    return again.data.withColumn("reused", F.lit(again.reused))


@query("dataset_manifest")
def dataset_manifest(spark, sf):
    return manifest.build_manifest(
        table(spark, sf, "lineitem"), schema_version="lineitem/v1", source_name="lineitem", code_revision="r1")


@query("dataset_manifest_counts", """
SELECT 'lineitem' AS source_name, count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem
""")
def dataset_manifest_counts(spark, sf):
    lines = table(spark, sf, "lineitem")
    stored = manifest.build_manifest(lines, schema_version="lineitem/v1", source_name="lineitem", code_revision="r1")
    shuffled = lines.hint("rebalance", "l_partkey")     # as many parts as the rows need
    verified = manifest.load_verified(shuffled, stored, schema_version="lineitem/v1", source_name="lineitem")
    return manifest.content_checksum(verified.data).select(F.lit("lineitem").alias("source_name"), "row_count", "column_count")


@query("file_checksums")
def file_checksums(spark, sf):
    return manifest.file_checksums(spark, f"{sf}/orders.parquet")


@query("distinct_sets", """
SELECT event_type, string_agg(DISTINCT strftime(ts, '%Y-%m'), ',' ORDER BY strftime(ts, '%Y-%m')) AS months, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type
""")
def distinct_sets(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.array_join(F.array_sort(F.collect_set(F.date_format("ts", "yyyy-MM"))), ",").alias("months"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"))
