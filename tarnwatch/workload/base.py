"""Registry of named queries and the table mappings they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnwatch.sources.files import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


# --- lineitem as reference population and current windows ---------------------

BORDER = "1998-07-01"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]


def reference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(F.col("l_shipdate") < F.lit(BORDER).cast("timestamp"))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    current = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit(BORDER).cast("timestamp"))
    return current.withColumn("window_id", F.date_format("l_shipdate", "yyyy-MM"))


def long_sql(columns: list[str], source: str, ids: str = "") -> str:
    """UNION ALL of (ids, feature, value)."""
    prefix = f"{ids}, " if ids else ""
    return " UNION ALL ".join(f"SELECT {prefix}'{c}' AS feature, {c} + 0e0 AS value FROM {source}" for c in columns)


DECILE_LIST = "[0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0, 1e0]"

# Frozen bins of the reference: ref_cells, edges, bins, ref_bins(feature, idx, lo, hi, n).
PROFILE_SQL = f"""
refl AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{BORDER}'),
curl AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS window_id FROM lineitem WHERE l_shipdate >= TIMESTAMP '{BORDER}'),
ref_cells AS ({long_sql(NUMERIC, 'refl')}),
cur_cells AS ({long_sql(NUMERIC, 'curl', 'window_id')}),
edge_lists AS (
  SELECT feature, list_sort(list_distinct(list_transform(quantile_cont(value, {DECILE_LIST}), lambda x: round(x, 8)))) AS edges,
         min(value) AS lowest, max(value) AS highest
  FROM ref_cells GROUP BY feature),
bins AS (
  SELECT feature, CAST(u.idx AS INTEGER) AS idx, edges[u.idx + 1] AS lo, edges[u.idx + 2] AS hi, lowest, highest,
         edges[1] AS first_edge, edges[len(edges)] AS last_edge
  FROM edge_lists, LATERAL (SELECT unnest(range(0, len(edges) - 1)) AS idx) u),
ref_bins AS (
  SELECT b.feature, b.idx, b.lo, b.hi, first_edge, last_edge, count(c.value) AS n
  FROM bins b LEFT JOIN ref_cells c
    ON c.feature = b.feature AND ((c.value > b.lo AND c.value <= b.hi) OR (b.idx = 0 AND c.value = b.lo))
  GROUP BY ALL),
cur_counts AS (
  SELECT c.window_id, b.feature, b.idx, count(*) AS n
  FROM cur_cells c JOIN bins b
    ON c.feature = b.feature AND ((c.value > b.lo AND c.value <= b.hi) OR (b.idx = 0 AND c.value = b.lo))
  GROUP BY ALL),
cur_bins AS (
  SELECT w.window_id, b.feature, b.idx, b.lo, b.hi, b.first_edge, b.last_edge, b.n AS r, coalesce(c.n, 0) AS c
  FROM (SELECT DISTINCT window_id FROM curl) w CROSS JOIN ref_bins b
  LEFT JOIN cur_counts c ON c.window_id = w.window_id AND c.feature = b.feature AND c.idx = b.idx),
shares AS (
  SELECT *, r / greatest(sum(r) OVER g, 1) AS rs, c / greatest(sum(c) OVER g, 1) AS cs, (lo + hi) / 2 AS mid
  FROM cur_bins WINDOW g AS (PARTITION BY window_id, feature)),
steps AS (
  SELECT *, sum(rs) OVER o AS rc, sum(cs) OVER o AS cc, lead(mid) OVER (PARTITION BY window_id, feature ORDER BY idx) - mid AS step
  FROM shares WINDOW o AS (PARTITION BY window_id, feature ORDER BY idx ROWS UNBOUNDED PRECEDING))
"""

# --- orders as predictions, lineitem as delayed labels --------------------------

AS_OF = "2001-01-01 00:00:00"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as predictions, with redelivered copies and some copies that disagree."""
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    base = orders.select(
        text(key).alias("prediction_id"), F.concat(F.lit("c"), text("o_custkey")).alias("entity_key"),
        F.lit("k1").alias("key_id"), F.col("o_orderdate").alias("prediction_at"),
        (F.col("o_totalprice") / 500000).alias("probability"), F.lit(0.5).alias("decision_threshold"),
        F.lit("model-1").alias("model_version"), F.lit("a" * 64).alias("model_bundle_sha256"), F.lit("v1").alias("schema_version"),
        F.lit("t1").alias("threshold_version"), F.lit("r1").alias("risk_policy_version"))
    number = F.col("prediction_id").cast("long")
    again = base.where(number % 10 == 0)
    differing = base.where(number % 97 == 0).withColumn("probability", F.col("probability") / 2)
    return base.unionByName(again).unionByName(differing)


PREDICTIONS_SQL = """
pred_base AS (
  SELECT o_orderkey AS id, 'c' || o_custkey AS entity_key, o_orderdate AS prediction_at, o_totalprice / 500000 AS probability
  FROM orders),
pred AS (
  SELECT * FROM pred_base
  UNION ALL SELECT * FROM pred_base WHERE id % 10 = 0
  UNION ALL SELECT id, entity_key, prediction_at, probability / 2 FROM pred_base WHERE id % 97 = 0),
pred_groups AS (
  SELECT id, count(*) AS copies, count(DISTINCT (entity_key, prediction_at, probability)) AS variants,
         min(entity_key) AS entity_key, min(prediction_at) AS prediction_at, min(probability) AS probability
  FROM pred GROUP BY id)
"""


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as revisions of a label; some carry a foreign entity, some come twice."""
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    key = F.col("l_orderkey")
    base = lines.select(
        text(key).alias("prediction_id"),
        F.when(key % 17 == 0, "other").otherwise(F.concat(F.lit("c"), text("o_custkey"))).alias("entity_key"),
        F.lit("k1").alias("key_id"), (F.col("l_returnflag") == "R").alias("churned_within_horizon"),
        F.col("l_shipdate").alias("outcome_at"), F.col("l_shipdate").alias("received_at"),
        F.col("l_linenumber").cast("int").alias("label_revision"), F.lit("def-1").alias("label_definition_version"))
    return base.unionByName(base.where(F.col("prediction_id").cast("long") % 10 == 0))


LABELS_SQL = f"""
lab_base AS (
  SELECT l_orderkey AS id, CASE WHEN l_orderkey % 17 = 0 THEN 'other' ELSE 'c' || o_custkey END AS entity_key,
         l_returnflag = 'R' AS churned, l_shipdate AS received_at, l_linenumber AS revision
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
lab AS (SELECT * FROM lab_base UNION ALL SELECT * FROM lab_base WHERE id % 10 = 0),
lab_groups AS (
  SELECT id, revision, count(*) AS copies, count(DISTINCT (entity_key, churned, received_at)) AS variants,
         min(entity_key) AS entity_key, bool_or(churned) AS churned, min(received_at) AS received_at
  FROM lab WHERE received_at <= TIMESTAMP '{AS_OF}' GROUP BY id, revision),
lab_latest AS (
  SELECT * FROM lab_groups WHERE variants = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC) = 1)
"""

RECONCILED_SQL = f"""
{PREDICTIONS_SQL}, {LABELS_SQL},
usable AS (SELECT * FROM pred_groups WHERE variants = 1),
due AS (SELECT * FROM usable WHERE prediction_at + INTERVAL 90 DAY + INTERVAL 24 HOUR <= TIMESTAMP '{AS_OF}'),
pairs AS (
  SELECT d.id, d.prediction_at, d.probability, l.churned, CAST(l.churned AS INTEGER) AS y, l.revision
  FROM due d JOIN lab_latest l ON l.id = d.id AND l.entity_key = d.entity_key)
"""


# --- scored orders -------------------------------------------------------------

def scored_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A score with a label and two groups to compare."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("segment"),
        (F.col("o_totalprice") / 500000).alias("probability"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.pmod(F.col("o_custkey") * 37, F.lit(1000)) / 1000).alias("champion"))


SCORED_SQL = """
scored AS (
  SELECT o_orderkey AS id, o_orderpriority AS segment, o_totalprice / 500000 AS p,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, (o_custkey * 37 % 1000) / 1000 AS champion
  FROM orders)
"""


# --- daily evidence and metric records from events --------------------------------

def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One evidence row per event type and day; gaps come from the days that qualify nowhere."""
    day = F.date_trunc("DAY", "ts")
    daily = table(spark, sf, "events").groupBy("event_type", day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    domain = (
        F.when(F.col("event_type") == "error", "operational").when(F.col("event_type") == "purchase", "performance")
        .when(F.col("event_type") == "click", "data_quality").otherwise("drift"))
    status = (
        F.when(F.col("top") > 300, "critical").when(F.col("top") > 220, "warning")
        .when((F.col("event_type") == "error") & (F.col("top") < 180), "unknown").otherwise("stable"))
    return daily.select(
        F.concat_ws("-", "event_type", F.date_format("day", "yyyyMMdd")).alias("source_result_id"),
        domain.alias("domain"), status.alias("source_status"), F.col("event_type").alias("signal"),
        F.date_format("day", "yyyy-MM-dd").alias("window_id"), (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("window_end"),
        F.col("n").alias("sample_size"), F.when(F.col("event_type") == "purchase", 0.9).alias("label_coverage"),
        F.lit("model-1").alias("model_version"), F.lit(None).cast("string").alias("baseline_id"),
        F.lit("c1").alias("config_version"), F.lit("replayed").alias("data_origin"))


EVIDENCE_SQL = """
daily AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, max(value) AS top FROM events GROUP BY ALL),
evid AS (
  SELECT event_type || '-' || strftime(day, '%Y%m%d') AS source_result_id,
         CASE event_type WHEN 'error' THEN 'operational' WHEN 'purchase' THEN 'performance' WHEN 'click' THEN 'data_quality' ELSE 'drift' END AS domain,
         CASE WHEN top > 300 THEN 'critical' WHEN top > 220 THEN 'warning' WHEN event_type = 'error' AND top < 180 THEN 'unknown' ELSE 'stable' END AS source_status,
         event_type AS signal, strftime(day, '%Y-%m-%d') AS window_id, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS window_end,
         n AS sample_size, CASE WHEN event_type = 'purchase' THEN 0.9e0 END AS label_coverage
  FROM daily),
qual AS (SELECT * FROM evid WHERE source_status IN ('warning', 'critical', 'unknown')),
gaps AS (
  SELECT *, CASE WHEN window_end - lag(window_end) OVER (PARTITION BY signal ORDER BY window_end, source_result_id) > INTERVAL 2 DAY THEN 1 ELSE 0 END AS brk
  FROM qual),
islands AS (SELECT *, sum(brk) OVER (PARTITION BY signal ORDER BY window_end, source_result_id ROWS UNBOUNDED PRECEDING) AS isl FROM gaps),
tails AS (
  SELECT signal, count(*) AS run_length, min(window_end) AS run_start, max(window_end) AS run_end
  FROM islands i WHERE isl = (SELECT max(isl) FROM islands j WHERE j.signal = i.signal) GROUP BY signal),
newest AS (SELECT * FROM qual QUALIFY row_number() OVER (PARTITION BY signal ORDER BY window_end DESC, source_result_id DESC) = 1),
alerts AS (
  SELECT n.*, t.run_length,
         (domain = 'operational' AND source_status = 'unknown') OR (domain = 'data_quality' AND source_status = 'critical')
           OR (domain = 'performance' AND source_status = 'critical') AS immediate
  FROM newest n JOIN tails t USING (signal))
"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly aggregates of events as metric records of five result types."""
    hour = F.date_trunc("HOUR", "ts")
    hourly = table(spark, sf, "events").groupBy("event_type", hour.alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("requests"), F.max("value").alias("top"))
    kind = (
        F.when(F.col("event_type") == "error", "alert").when(F.col("event_type") == "purchase", "performance")
        .when(F.col("event_type") == "click", "telemetry").when(F.col("event_type") == "view", "monitoring")
        .otherwise("recommendation"))
    return hourly.select(
        F.concat_ws("-", "event_type", F.date_format("h", "yyyyMMddHH")).alias("result_id"), kind.alias("result_type"),
        F.when(F.col("top") > 100, "warning").otherwise("stable").alias("status"),
        F.when(F.col("event_type") == "signup", "synthetic").otherwise("replayed").alias("data_origin"),
        F.col("h").alias("window_start"), (F.col("h") + F.expr("INTERVAL 1 HOUR")).alias("window_end"),
        (F.col("h") + F.expr("INTERVAL 2 HOURS")).alias("computed_at"), F.col("n").alias("sample_size"),
        F.lit(None).cast("double").alias("label_coverage"), F.lit("m1").alias("method_version"), F.lit("c1").alias("config_version"),
        F.concat(F.lit("model-"), F.dayofmonth("h") % 4).alias("model_version"), F.lit("b1").alias("baseline_id"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("dep-"), F.col("event_type"))).alias("deployment_id"),
        F.create_map(F.lit("request_count"), F.col("requests"), F.lit("f1"), F.col("top") / 1000, F.lit("internal_note"), F.lit(1.0)).alias("summary"),
        F.lit("{}").alias("distribution"))


RECORDS_SQL = """
hourly AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n, max(value) AS top FROM events GROUP BY ALL),
recs AS (
  SELECT event_type || '-' || strftime(h, '%Y%m%d%H') AS result_id,
         CASE event_type WHEN 'error' THEN 'alert' WHEN 'purchase' THEN 'performance' WHEN 'click' THEN 'telemetry' WHEN 'view' THEN 'monitoring' ELSE 'recommendation' END AS result_type,
         CASE WHEN top > 100 THEN 'warning' ELSE 'stable' END AS status,
         CASE WHEN event_type = 'signup' THEN 'synthetic' ELSE 'replayed' END AS data_origin,
         h AS window_start, h + INTERVAL 1 HOUR AS window_end, h + INTERVAL 2 HOUR AS computed_at, n AS sample_size,
         'model-' || (day(h) % 4) AS model_version, CASE WHEN event_type <> 'view' THEN 'dep-' || event_type END AS deployment_id,
         CAST(n AS DOUBLE) AS request_count, top / 1000 AS f1
  FROM hourly)
"""


def iso(column: str | Column) -> Column:
    """Timestamps leave a query as text, so that no engine's time zone can touch them."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def iso_sql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"
