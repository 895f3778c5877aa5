"""Contracts, privacy guards and feature engineering on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions.expressions import (
    keyed_pseudonym,
    left_closed_labels,
    number_from_text,
    right_closed_labels,
    trace_id,
)
from tarnwatch.operators import contract as ct
from tarnwatch.operators import features as fe
from tarnwatch.operators.store import record_problems
from tarnwatch.workload.base import RECORDS_SQL, query, records, rounded, table, text



def size_text():
    k = F.col("p_partkey") % 6
    return (
        F.when(k == 0, " ").when(k == 1, F.concat(text("p_size"), F.lit(".50"))).when(k == 2, "n/a")
        .when(k == 3, F.concat(F.lit(" "), text("p_size"))).when(k == 4, "1.5d").otherwise(text("p_size")))


SIZE_TEXT_SQL = """CASE p_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN p_size || '.50' WHEN 2 THEN 'n/a'
  WHEN 3 THEN ' ' || p_size WHEN 4 THEN '1.5d' ELSE CAST(p_size AS VARCHAR) END"""
SIZE_NUMBER_SQL = """CASE p_partkey % 6 WHEN 1 THEN p_size + 0.5e0 WHEN 3 THEN p_size + 0e0 WHEN 5 THEN p_size + 0e0 END"""

LINEITEM_CONTRACT = ct.Contract(
    version="lineitem/v1",
    rules=(
        ct.one_of("l_returnflag", ("A", "N")),
        ct.one_of("l_linestatus", ("O", "F")),
        ct.between("l_quantity", 2, 49),
        ct.between("l_discount", 0, 0.09),
        ct.between("l_tax", 0),
        ct.implies("open_lines", "l_returnflag = 'N'", "l_linestatus = 'O'"),
        ct.implies("late_lines", "l_shipdate >= TIMESTAMP '2001-01-01'", "l_returnflag = 'N'"),
    ),
    unique=(("l_orderkey", "l_linenumber"),),
)


@query("contract_violation_report", """
SELECT 'l_returnflag' AS "column", 'domain' AS "check", count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS n_fail FROM lineitem
UNION ALL SELECT 'l_linestatus', 'domain', count(*) FILTER (WHERE l_linestatus NOT IN ('O', 'F')) FROM lineitem
UNION ALL SELECT 'l_quantity', 'range', count(*) FILTER (WHERE NOT (l_quantity BETWEEN 2 AND 49)) FROM lineitem
UNION ALL SELECT 'l_discount', 'range', count(*) FILTER (WHERE NOT (l_discount >= 0 AND l_discount <= 0.09e0)) FROM lineitem
UNION ALL SELECT 'l_tax', 'range', count(*) FILTER (WHERE NOT (l_tax >= 0)) FROM lineitem
UNION ALL SELECT 'row', 'open_lines', count(*) FILTER (WHERE l_returnflag = 'N' AND l_linestatus <> 'O') FROM lineitem
UNION ALL SELECT 'row', 'late_lines', count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_returnflag <> 'N') FROM lineitem
UNION ALL SELECT 'l_orderkey,l_linenumber', 'unique', coalesce(CAST(sum(n) AS BIGINT), 0)
  FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1
""")
def contract_violation_report(spark, sf):
    return ct.violation_report(table(spark, sf, "lineitem"), LINEITEM_CONTRACT, only_failed=False)


@query("contract_coercion_failures", f"""
SELECT 'size_text' AS "column", 'type' AS "check", count(*) FILTER (WHERE ({SIZE_NUMBER_SQL}) IS NULL AND p_partkey % 6 <> 4) AS n_fail FROM part
UNION ALL SELECT 'p_type', 'type', count(*) FROM part
""")
def contract_coercion_failures(spark, sf):
    parts = table(spark, sf, "part").withColumn("size_text", size_text())
    return ct.violation_report(parts, ct.Contract("part/v1", types={"size_text": "double", "p_type": "int"}))


@query("contract_report_on_text", """
WITH t AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS total,
  CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_custkey % 4 AS VARCHAR) END AS flag FROM orders),
n AS (SELECT total, flag, try_cast(total AS DOUBLE) AS v, try_cast(flag AS INTEGER) AS f FROM t)
SELECT 'total' AS "column", 'type' AS "check", count(*) FILTER (total IS NOT NULL AND v IS NULL) AS n_fail FROM n
UNION ALL SELECT 'flag', 'type', count(*) FILTER (flag IS NOT NULL AND f IS NULL) FROM n
UNION ALL SELECT 'total', 'range', count(*) FILTER (NOT coalesce(v BETWEEN 1000 AND 300000, false)) FROM n
UNION ALL SELECT 'flag', 'domain', count(*) FILTER (NOT coalesce(f IN (0, 1, 2), false)) FROM n
""")
def contract_report_on_text(spark, sf):
    """Numbers that arrive as text, some of them no numbers: types, domain and range of one column in one aggregate."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(
        F.when(k % 11 == 0, "abc").when(k % 13 == 0, F.lit(None).cast("string")).otherwise(text("o_totalprice")).alias("total"),
        F.when(k % 7 == 0, "x").otherwise(text(F.col("o_custkey") % 4)).alias("flag"))
    return ct.violation_report(orders, ct.Contract(
        "orders/v1", types={"total": "double", "flag": "int"}, rules=(ct.between("total", 1000, 300000), ct.one_of("flag", (0, 1, 2)))), only_failed=False)


@query("contract_decimal_text", f"""
WITH t AS (SELECT {SIZE_TEXT_SQL} AS s FROM part)
SELECT 'size_text' AS "column", 'decimal_text' AS "check",
       count(*) FILTER (WHERE NOT (trim(s) = '' OR regexp_full_match(trim(s), '[0-9]+(\\.[0-9]+)?'))) AS n_fail FROM t
""")
def contract_decimal_text(spark, sf):
    parts = table(spark, sf, "part").withColumn("size_text", size_text())
    return ct.violation_report(parts, ct.Contract("part/v1", rules=(ct.blank_or_decimal_text("size_text"),)))


@query("contract_key_uniqueness", """
SELECT count(*) AS n_keys, coalesce(CAST(sum(n) AS BIGINT), 0) AS n_fail
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1
""")
def contract_key_uniqueness(spark, sf):
    return ct.uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


ROW_RULES = (
    ct.text_length("c_name", 1, 128),
    ct.one_of("c_mktsegment", ("BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD")),
    ct.between("c_acctbal", 0, 9000),
    ct.implies("segment_balance", "c_mktsegment = 'BUILDING'", "c_acctbal > 1000"),
)


@query("row_contract_quarantine", """
WITH marked AS (
  SELECT list_sort(list_filter([
    CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD') THEN 'c_mktsegment:domain' END,
    CASE WHEN NOT (c_acctbal BETWEEN 0 AND 9000) THEN 'c_acctbal:range' END,
    CASE WHEN c_mktsegment = 'BUILDING' AND NOT (c_acctbal > 1000) THEN 'row:segment_balance' END], lambda x: x IS NOT NULL)) AS f
  FROM customer)
SELECT array_to_string(f, ',') AS failed, count(*) AS n FROM marked GROUP BY ALL
""")
def row_contract_quarantine(spark, sf):
    return ct.rule_counts(table(spark, sf, "customer"), ROW_RULES)


@query("event_row_validity", """
WITH e AS (SELECT o_orderkey, o_totalprice / 400000 AS p, o_orderkey % 7 AS revision, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS entity,
                  CASE WHEN o_orderkey % 11 = 0 THEN 'xyz' ELSE repeat('ab', 32) END AS digest FROM orders),
marked AS (
  SELECT list_sort(list_filter([
    CASE WHEN length(entity) = 0 THEN 'entity_key:not_empty' END, CASE WHEN p > 1 THEN 'probability:range' END,
    CASE WHEN revision < 1 THEN 'label_revision:range' END, CASE WHEN digest = 'xyz' THEN 'digest:sha256' END], lambda x: x IS NOT NULL)) AS f
  FROM e)
SELECT array_to_string(f, ',') AS failed, count(*) AS n FROM marked GROUP BY ALL
""")
def event_row_validity(spark, sf):
    rows = table(spark, sf, "orders").select(
        text("o_orderkey").alias("prediction_id"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise(text("o_custkey")).alias("entity_key"),
        (F.col("o_totalprice") / 400000).alias("probability"), (F.col("o_orderkey") % 7).alias("label_revision"),
        F.when(F.col("o_orderkey") % 11 == 0, "xyz").otherwise(F.repeat(F.lit("ab"), 32)).alias("digest"))
    rules = (
        ct.not_empty("prediction_id"), ct.not_empty("entity_key"), ct.between("probability", 0, 1),
        ct.between("label_revision", 1), ct.sha256_hex("digest"))
    return ct.rule_counts(rows, rules)


@query("record_row_validity", f"""
WITH {RECORDS_SQL},
broken AS (SELECT *, sample_size % 3 = 0 AS swapped, sample_size % 4 = 0 AS odd, sample_size % 5 = 0 AS leaky FROM recs),
marked AS (
  SELECT list_sort(list_filter([CASE WHEN swapped THEN 'window:order' END, CASE WHEN odd THEN 'status:domain' END,
    CASE WHEN leaky THEN 'distribution:privacy' END], lambda x: x IS NOT NULL)) AS f FROM broken)
SELECT array_to_string(f, ',') AS failed, count(*) AS n FROM marked GROUP BY ALL
""")
def record_row_validity(spark, sf):
    n = F.col("sample_size")
    rows = records(spark, sf).withColumns({
        "window_end": F.when(n % 3 == 0, F.col("window_start")).otherwise(F.col("window_end")),
        "status": F.when(n % 4 == 0, "odd").otherwise(F.col("status")),
        "distribution": F.when(n % 5 == 0, '{"a": [{"My_Customer_Id" : 1}]}').otherwise('{"a": "customer"}')})
    marked = rows.withColumn("failed", F.array_join(F.array_sort(record_problems()), ","))
    return marked.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


@query("privacy_guard", """
WITH j AS (
  SELECT event_type, CASE WHEN user_id % 3 = 0 THEN '{"outer": {"my_' || event_type || '_Token" : 1}}'
                          WHEN user_id % 3 = 1 THEN '{"note": "' || event_type || ' token"}' ELSE props END AS t FROM events)
SELECT event_type, count(*) FILTER (WHERE regexp_matches(lower(t), '"[^"]*(customer|entity_key|prediction_id|payload|secret|token|stack_trace)[^"]*"\\s*:')) AS n_leaks
FROM j GROUP BY event_type
""")
def privacy_guard(spark, sf):
    e, k = F.col("event_type"), F.col("user_id") % 3
    doc = (
        F.when(k == 0, F.concat(F.lit('{"outer": {"my_'), e, F.lit('_Token" : 1}}')))
        .when(k == 1, F.concat(F.lit('{"note": "'), e, F.lit(' token"}'))).otherwise(F.col("props")))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(ct.leaks_identifier(doc)).alias("n_leaks"))


@query("allowed_metrics", f"""
WITH {RECORDS_SQL},
pairs AS (
  SELECT result_type, 'request_count' AS metric, request_count AS v FROM recs WHERE result_type = 'telemetry'
  UNION ALL SELECT result_type, 'f1', f1 FROM recs WHERE result_type = 'performance')
SELECT result_type, metric, count(*) AS n, round(sum(v), 4) AS total FROM pairs GROUP BY ALL
""")
def allowed_metrics(spark, sf):
    from tarnwatch.config import ExportPolicy

    kept = records(spark, sf).select(
        "result_type", F.explode(ct.allowed_only(F.col("summary"), F.col("result_type"), ExportPolicy().allowed_metrics)).alias("metric", "v"))
    return kept.groupBy("result_type", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("identifier_exclusion", "SELECT c_nationkey, c_mktsegment, c_acctbal + 0e0 AS c_acctbal FROM customer")
def identifier_exclusion(spark, sf):
    kept = ct.select_without(table(spark, sf, "customer"), ["c_custkey", "c_name"])
    return kept.withColumn("c_acctbal", F.col("c_acctbal") + F.lit(0.0))


# --- features --------------------------------------------------------------------

@query("feature_total_and_ratio", f"""
WITH t AS (SELECT p_partkey, p_retailprice AS monthly, p_size, p_retailprice * p_size AS est, {SIZE_NUMBER_SQL} AS num FROM part),
u AS (SELECT *, coalesce(num, est) AS total FROM t)
SELECT p_partkey, round(total - est, 6) AS residual, round(monthly / (total + 1e-6), 6) AS ratio FROM u
""")
def feature_total_and_ratio(spark, sf):
    parts = table(spark, sf, "part").withColumn("size_text", size_text())
    estimate = F.col("p_retailprice") * F.col("p_size")
    total = fe.number_or_estimate(F.col("size_text"), estimate)
    out = parts.select(
        "p_partkey", fe.residual(total, estimate).alias("residual"), fe.ratio(F.col("p_retailprice"), total).alias("ratio"))
    return rounded(out, 6, "residual", "ratio")


@query("feature_right_closed_bins", """
SELECT p_size * 2 - 2 AS v, CASE WHEN p_size * 2 - 2 > 72 OR p_size * 2 - 2 < 0 THEN 'nan' WHEN p_size * 2 - 2 <= 2 THEN 'G1_0_2'
  WHEN p_size * 2 - 2 <= 18 THEN 'G2_2_18' WHEN p_size * 2 - 2 <= 44 THEN 'G3_18_44' ELSE 'G4_44_72' END AS label, count(*) AS n
FROM part GROUP BY ALL
""")
def feature_right_closed_bins(spark, sf):
    from tarnwatch.presets import TENURE_EDGES, TENURE_LABELS

    v = F.col("p_size") * 2 - 2
    return table(spark, sf, "part").groupBy(
        v.alias("v"), right_closed_labels(v, TENURE_EDGES, TENURE_LABELS).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("feature_left_closed_bins", """
SELECT CASE WHEN p_size < 12 THEN '0-11' WHEN p_size < 24 THEN '12-23' WHEN p_size < 48 THEN '24-47' ELSE '48-72' END AS size_bin,
       CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1050 THEN 'mid' ELSE 'high' END AS price_bin, count(*) AS n
FROM part GROUP BY ALL
""")
def feature_left_closed_bins(spark, sf):
    from tarnwatch.presets import TENURE_REPORT_LABELS, TENURE_REPORT_UPPERS

    return table(spark, sf, "part").groupBy(
        left_closed_labels(F.col("p_size"), TENURE_REPORT_UPPERS, TENURE_REPORT_LABELS).alias("size_bin"),
        left_closed_labels(F.col("p_retailprice"), (950, 1050), ("low", "mid", "high")).alias("price_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _service_flags(spark, sf):
    parts = table(spark, sf, "part")
    yes = lambda m: F.when(F.col("p_partkey") % m == 0, "Yes").when(F.col("p_partkey") % m == 1, "No").otherwise("No service")
    return parts.withColumns({"s2": yes(2), "s3": yes(3), "s5": yes(5), "s7": yes(7)})


FLAGS_SQL = ", ".join(
    f"CASE p_partkey % {m} WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'No service' END AS s{m}" for m in (2, 3, 5, 7))


@query("feature_membership_and_count", f"""
WITH t AS (SELECT *, {FLAGS_SQL} FROM part),
u AS (SELECT CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 1 ELSE 0 END AS is_member,
  (s2 = 'Yes')::INT + (s3 = 'Yes')::INT + (s5 = 'Yes')::INT + (s7 = 'Yes')::INT AS service_count FROM t)
SELECT is_member, service_count, CASE WHEN service_count > 0 THEN 1 ELSE 0 END AS has_any, count(*) AS n FROM u GROUP BY ALL
""")
def feature_membership_and_count(spark, sf):
    counted = fe.count_equal(["s2", "s3", "s5", "s7"], "Yes")
    return _service_flags(spark, sf).groupBy(
        fe.is_member(F.col("p_type"), ("PROMO", "LARGE")).alias("is_member"), counted.alias("service_count"),
        (counted > 0).cast("int").alias("has_any")).agg(F.count(F.lit(1)).alias("n"))


@query("feature_value_map", f"""
WITH t AS (SELECT CASE WHEN p_partkey % 6 = 2 THEN 'n/a' WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 0 THEN 'Yes' ELSE 'No service' END AS s,
  p_partkey % 6 AS k, p_partkey % 3 AS j, p_size FROM part)
SELECT s, CASE WHEN k = 2 THEN NULL WHEN j = 1 THEN p_size + 0e0 WHEN j = 0 THEN 1e0 ELSE -1e0 END AS mapped, count(*) AS n FROM t GROUP BY ALL
""")
def feature_value_map(spark, sf):
    k, j = F.col("p_partkey") % 6, F.col("p_partkey") % 3
    s = F.when(k == 2, "n/a").when(j == 1, text("p_size")).when(j == 0, "Yes").otherwise("No service")
    mapped = fe.mapped_number(F.col("s"), {"Yes": 1, "No": 0, "No service": -1})
    return table(spark, sf, "part").withColumn("s", s).groupBy("s", mapped.alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query("feature_one_hot", """
SELECT p_partkey, (p_type = 'LARGE')::DOUBLE AS p_type_LARGE, (p_type = 'MEDIUM')::DOUBLE AS p_type_MEDIUM,
       (p_type = 'PROMO')::DOUBLE AS p_type_PROMO, (p_type = 'SMALL')::DOUBLE AS p_type_SMALL, (p_type = 'STANDARD')::DOUBLE AS p_type_STANDARD
FROM part
""")
def feature_one_hot(spark, sf):
    parts = table(spark, sf, "part")
    categories = fe.fit_categories(parts, ["p_type"])
    return parts.select("p_partkey", *[c.alias(n) for n, c in fe.one_hot("p_type", categories["p_type"]).items()])


@query("feature_z_score", """
WITH f AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp, stddev_pop(p_retailprice) AS sp FROM part)
SELECT p_partkey, round((p_size - ms) / ss, 6) + 0e0 AS p_size, round((p_retailprice - mp) / sp, 6) + 0e0 AS p_retailprice FROM part, f
""")
def feature_z_score(spark, sf):
    parts = table(spark, sf, "part")
    fitted = fe.fit_scaler(parts, ["p_size", "p_retailprice"])
    out = parts.select("p_partkey", *[fe.scaled(c, *fitted[c]).alias(c) for c in fitted])
    return rounded(out, 6, "p_size", "p_retailprice")


@query("feature_pipeline", f"""
WITH t AS (
  SELECT p_partkey, p_size, p_retailprice, p_type, {SIZE_NUMBER_SQL} AS num, {FLAGS_SQL} FROM part),
d AS (
  SELECT *, coalesce(num, p_retailprice * p_size) AS total, p_retailprice * p_size AS est,
    (s2 = 'Yes')::INT + (s3 = 'Yes')::INT AS service_count FROM t),
f AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM t)
SELECT p_partkey, round((p_size - m) / s, 6) + 0e0 AS p_size, p_retailprice, s2, s3,
  CASE s5 WHEN 'Yes' THEN 1e0 WHEN 'No' THEN 0e0 END AS s5,
  round(total - est, 6) AS tc_residual, round(p_retailprice / (total + 1e-6), 6) AS monthly_to_total_ratio,
  CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS is_promo, service_count, CASE WHEN service_count > 0 THEN 1 ELSE 0 END AS has_any_addon,
  (p_size > 10 AND p_size <= 30)::DOUBLE AS size_group_mid, (p_size > 30)::DOUBLE AS size_group_top
FROM d, f
""")
def feature_pipeline(spark, sf):
    recipe = fe.FeatureRecipe(
        text_total="size_text", rate="p_retailprice", duration="p_size", duration_edges=(0, 10, 30, 50),
        duration_labels=("low", "mid", "top"), duration_group="size_group", membership={"is_promo": ("p_type", ("PROMO",))},
        counted=("s2", "s3"), drop=("size_text", "p_name", "p_brand", "p_type", "s7"),
        maps={"s5": {"Yes": 1, "No": 0}}, encode=("size_group",), scale=("p_size",))
    parts = _service_flags(spark, sf).withColumn("size_text", size_text())
    out = fe.fit_features(parts, recipe).transform(parts)
    return rounded(out, 6, "p_size", "tc_residual", "monthly_to_total_ratio")


SECRET = b"pseudonym-key"
_INNER = bytes(b ^ 0x36 for b in SECRET.ljust(64, b"\0")).hex()
_OUTER = bytes(b ^ 0x5C for b in SECRET.ljust(64, b"\0")).hex()


@query("keyed_pseudonyms", f"""
SELECT c_custkey, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('user-' || c_custkey)))) AS entity_key, 'k1' AS key_id
FROM customer
""")
def keyed_pseudonyms(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", keyed_pseudonym(F.concat(F.lit("user-"), text("c_custkey")), SECRET).alias("entity_key"), F.lit("k1").alias("key_id"))


@query("trace_ids", """
WITH h AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events),
t AS (SELECT event_id, h, CASE event_id % 4 WHEN 0 THEN upper('00-' || h || '-' || substr(h, 1, 16) || '-01')
  WHEN 1 THEN '00-' || h || '-' || substr(h, 1, 15) || '-01' WHEN 2 THEN NULL ELSE '00-' || h || '-' || substr(h, 1, 16) || '-01' END AS tp FROM h)
SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN h END AS trace_id FROM t
""")
def trace_ids(spark, sf):
    h = F.md5(text("event_id"))
    good = F.concat(F.lit("00-"), h, F.lit("-"), F.substring(h, 1, 16), F.lit("-01"))
    short = F.concat(F.lit("00-"), h, F.lit("-"), F.substring(h, 1, 15), F.lit("-01"))
    k = F.col("event_id") % 4
    parent = F.when(k == 0, F.upper(good)).when(k == 1, short).when(k == 3, good)
    return table(spark, sf, "events").select("event_id", trace_id(parent).alias("trace_id"))


@query("renamed_columns", "SELECT c_custkey AS customerID, c_mktsegment AS Segment, c_nationkey AS Nation FROM customer")
def renamed_columns(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return fe.renamed(base, {"c_custkey": "customerID", "c_mktsegment": "Segment", "c_nationkey": "Nation"})


@query("numeric_text_parsing", f"""
WITH t AS (SELECT {SIZE_TEXT_SQL} AS s, {SIZE_NUMBER_SQL} AS v FROM part)
SELECT s, v, count(*) AS n FROM t GROUP BY ALL
""")
def numeric_text_parsing(spark, sf):
    parts = table(spark, sf, "part").withColumn("s", size_text())
    return parts.groupBy("s", number_from_text(F.col("s")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
