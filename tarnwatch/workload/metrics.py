"""Model-quality metrics, gates and splits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tarnwatch.config import GatePolicy
from tarnwatch.operators import bootstrap as bs
from tarnwatch.operators import gates as gt
from tarnwatch.operators import metrics as mt
from tarnwatch.operators import training as tr
from tarnwatch.operators.split import only, stratified_split
from tarnwatch.plans.freeze import freeze
from tarnwatch.plans.ordering import quantiles
from tarnwatch.session import SPENT_SHUFFLES, large_join, settings
from tarnwatch.workload.base import SCORED_SQL, query, rounded, scored_orders, table

RANKED_SQL = f"""
{SCORED_SQL},
blocks AS (SELECT segment, p AS s, count(*) AS n, sum(y) AS pos FROM scored GROUP BY segment, p),
cum AS (
  SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(pos) OVER g AS tp, sum(n) OVER g AS tn FROM blocks
  WINDOW o AS (PARTITION BY segment ORDER BY s DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY segment)),
ranking AS (
  SELECT segment, CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS n_positive, sum(pos / tp * cp / cn) AS ap,
    sum((n - pos) * (cp - pos / 2)) / max(tp * (tn - tp)) AS auc FROM cum GROUP BY segment)
"""


@query("ranking_metrics", f"""
WITH {RANKED_SQL} SELECT segment, n, n_positive, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, 0 AS bad_scores FROM ranking
""")
def ranking_metrics(spark, sf):
    return rounded(mt.ranking_metrics(scored_orders(spark, sf), "label", "probability", ["segment"]), 6, "average_precision", "roc_auc")


@query("ranking_metrics_with_ties", """
WITH scored AS (SELECT p_size % 10 / 10e0 AS s, (p_partkey % 3 = 0)::INT AS y FROM part),
blocks AS (SELECT s, count(*) AS n, sum(y) AS pos FROM scored GROUP BY s),
cum AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(pos) OVER () AS tp, sum(n) OVER () AS tn FROM blocks WINDOW o AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS n_positive, round(sum(pos / tp * cp / cn), 6) AS average_precision,
  round(sum((n - pos) * (cp - pos / 2)) / max(tp * (tn - tp)), 6) AS roc_auc, 0 AS bad_scores FROM cum
""")
def ranking_metrics_with_ties(spark, sf):
    parts = table(spark, sf, "part").select((F.col("p_size") % 10 / 10).alias("s"), (F.col("p_partkey") % 3 == 0).cast("int").alias("y"))
    return rounded(mt.ranking_metrics(parts, "y", "s"), 6, "average_precision", "roc_auc")


def holed_scores(spark, sf):
    """A group without a name, and a group in which some scores are null and some no number."""
    k = F.col("id")
    rows = scored_orders(spark, sf).withColumn("segment", F.when(F.col("segment") != "3-MEDIUM", F.col("segment")))
    hole = F.when(k % 50 == 0, F.lit(None).cast("double")).when(k % 50 == 1, F.lit(float("nan"))).otherwise(F.col("probability"))
    return rows.withColumn("probability", F.when(F.col("segment") == "5-LOW", hole).otherwise(F.col("probability")))


HOLED_SQL = f"""
{SCORED_SQL},
holed AS (SELECT id, nullif(segment, '3-MEDIUM') AS segment, CASE WHEN segment = '5-LOW' AND id % 50 IN (0, 1) THEN NULL ELSE p END AS p, y FROM scored),
h_blocks AS (SELECT segment, p AS s, count(*) AS n, sum(y) AS pos FROM holed WHERE p IS NOT NULL GROUP BY segment, p),
h_cum AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(pos) OVER g AS tp, sum(n) OVER g AS tn FROM h_blocks
  WINDOW o AS (PARTITION BY segment ORDER BY s DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY segment)),
h_rank AS (SELECT segment, CAST(max(tn) AS BIGINT) AS n, CAST(max(tp) AS BIGINT) AS n_positive, sum(pos / tp * cp / cn) AS ap,
  sum((n - pos) * (cp - pos / 2)) / max(tp * (tn - tp)) AS auc FROM h_cum GROUP BY segment),
h_bad AS (SELECT segment, count(*) FILTER (p IS NULL) AS bad FROM holed GROUP BY segment)
"""


@query("ranking_metrics_of_holed_scores", f"""
WITH {HOLED_SQL}
SELECT b.segment, n, n_positive, CASE WHEN bad = 0 THEN round(ap, 6) END AS average_precision, CASE WHEN bad = 0 THEN round(auc, 6) END AS roc_auc, bad AS bad_scores
FROM h_bad b LEFT JOIN h_rank r ON r.segment IS NOT DISTINCT FROM b.segment
""")
def ranking_metrics_of_holed_scores(spark, sf):
    return rounded(mt.ranking_metrics(holed_scores(spark, sf), "label", "probability", ["segment"]), 6, "average_precision", "roc_auc")


@query("curve_of_holed_scores", f"""
WITH {HOLED_SQL} SELECT segment, round(s, 8) AS threshold, round(cp / cn, 6) AS precision, round(cp / tp, 6) AS recall
FROM h_cum WHERE segment IS DISTINCT FROM '5-LOW'
""")
def curve_of_holed_scores(spark, sf):
    curve = mt.precision_recall_curve(holed_scores(spark, sf), "label", "probability", ["segment"])
    return rounded(rounded(curve, 6, "precision", "recall"), 8, "threshold")


@query("calibration_of_unnamed_groups", f"""
WITH {SCORED_SQL}, t AS (SELECT nullif(segment, '3-MEDIUM') AS segment, id, p, y FROM scored),
b AS (SELECT *, ntile(10) OVER (PARTITION BY segment ORDER BY p, md5(CAST(id AS VARCHAR))) AS bin FROM t),
e AS (SELECT segment, bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY ALL),
q AS (SELECT segment, quantile_cont(p, 0.9) AS p90 FROM t GROUP BY segment),
x AS (SELECT segment, sum(n * gap) / sum(n) AS ece FROM e GROUP BY segment)
SELECT x.segment, round(ece, 6) AS expected_calibration_error, round(p90, 6) AS p90 FROM x JOIN q ON q.segment IS NOT DISTINCT FROM x.segment
""")
def calibration_of_unnamed_groups(spark, sf):
    rows = scored_orders(spark, sf).withColumn("segment", F.when(F.col("segment") != "3-MEDIUM", F.col("segment")))
    ece = mt.expected_calibration_error(rows, "label", "probability", "id", 10, ["segment"])
    tops = quantiles(rows, {"p": F.col("probability")}, [0.9], by=["segment"]).select("segment", F.col("value").alias("p90"))
    return rounded(mt.join_groups(ece, tops, ["segment"]), 6, "expected_calibration_error", "p90")


@query("threshold_metrics", f"""
WITH {SCORED_SQL},
c AS (SELECT segment, count(*) FILTER (WHERE p < 0.45 AND y = 0) AS tn, count(*) FILTER (WHERE p >= 0.45 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.45 AND y = 1) AS fn,
  count(*) FILTER (WHERE p >= 0.45 AND y = 1) AS tp, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY segment)
SELECT segment, tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(brier, 6) AS brier_score FROM c
""")
def threshold_metrics(spark, sf):
    out = mt.threshold_metrics(scored_orders(spark, sf), "label", "probability", 0.45, ["segment"])
    return rounded(out, 6, "precision", "recall", "f1", "brier_score")


@query("calibration_table", f"""
WITH {SCORED_SQL},
b AS (SELECT segment, least(CAST(floor(p * 0.7 * 5) AS INTEGER), 4) AS bin, p * 0.7 AS p, y FROM scored),
g AS (SELECT segment, CAST(u.bin AS INTEGER) AS bin FROM (SELECT DISTINCT segment FROM scored), (SELECT unnest(range(5)) AS bin) u)
SELECT g.segment, g.bin, g.bin / 5e0 AS lower, (g.bin + 1) / 5e0 AS upper, count(b.p) AS n, round(avg(b.p), 6) AS mean_probability, round(avg(b.y), 6) AS observed_rate
FROM g LEFT JOIN b ON b.segment = g.segment AND b.bin = g.bin GROUP BY g.segment, g.bin
""")
def calibration_table(spark, sf):
    """Scores stay below 0.7, so the last bin is empty and must still be there."""
    scored = scored_orders(spark, sf).withColumn("probability", F.col("probability") * 0.7)
    out = mt.calibration_table(scored, "label", "probability", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), ["segment"])
    return rounded(out, 6, "mean_probability", "observed_rate")


@query("equal_frequency_bins", f"""
WITH {SCORED_SQL}, b AS (SELECT *, ntile(10) OVER (PARTITION BY segment ORDER BY p, md5(CAST(id AS VARCHAR))) - 1 AS bin FROM scored)
SELECT segment, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS observed_rate FROM b GROUP BY segment, bin
""")
def equal_frequency_bins(spark, sf):
    out = mt.equal_frequency_bins(scored_orders(spark, sf), "label", "probability", "id", 10, ["segment"])
    return rounded(out, 6, "mean_probability", "observed_rate")


@query("equal_frequency_bins_with_ties", """
WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0.25e0 ELSE p_size % 10 / 10e0 END AS s, (p_partkey % 7 < 3)::INT AS y FROM part),
b AS (SELECT *, ntile(7) OVER (ORDER BY s, md5(CAST(id AS VARCHAR))) - 1 AS bin FROM t)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS mean_probability, round(avg(y), 6) AS observed_rate FROM b GROUP BY bin
""")
def equal_frequency_bins_with_ties(spark, sf):
    k = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        k.alias("id"), F.when(k % 3 == 0, 0.25).otherwise(F.col("p_size") % 10 / 10).alias("s"), (k % 7 < 3).cast("int").alias("y"))
    return rounded(mt.equal_frequency_bins(parts, "y", "s", "id", 7), 6, "mean_probability", "observed_rate")


@query("expected_calibration_error", f"""
WITH {SCORED_SQL}, b AS (SELECT *, ntile(10) OVER (PARTITION BY segment ORDER BY p, md5(CAST(id AS VARCHAR))) AS bin FROM scored),
e AS (SELECT segment, bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY ALL)
SELECT segment, round(sum(n * gap) / sum(n), 6) AS expected_calibration_error FROM e GROUP BY segment
""")
def expected_calibration_error(spark, sf):
    out = mt.expected_calibration_error(scored_orders(spark, sf), "label", "probability", "id", 10, ["segment"])
    return rounded(out, 6, "expected_calibration_error")


@query("precision_recall_curve", f"""
WITH {RANKED_SQL} SELECT segment, round(s, 8) AS threshold, round(cp / cn, 6) AS precision, round(cp / tp, 6) AS recall FROM cum
""")
def precision_recall_curve(spark, sf):
    curve = mt.precision_recall_curve(scored_orders(spark, sf), "label", "probability", ["segment"])
    return rounded(rounded(curve, 6, "precision", "recall"), 8, "threshold")


@query("best_f1_threshold", f"""
WITH {RANKED_SQL}, f AS (SELECT segment, s, 2 * (cp / cn) * (cp / tp) / greatest(cp / cn + cp / tp, 1e-12) AS f1 FROM cum)
SELECT segment, round(s, 8) AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY segment ORDER BY round(f1, 12) DESC, s) = 1
""")
def best_f1_threshold(spark, sf):
    best = mt.best_f1_threshold(scored_orders(spark, sf), "label", "probability", ["segment"])
    return rounded(rounded(best, 6, "f1"), 8, "threshold").select("segment", "threshold", "f1")


LIMITS = GatePolicy(
    absolute={"average_precision": 0.3, "recall": 0.5, "precision": 0.33, "f1": 0.4, "roc_auc": 0.5, "brier_score": 0.30, "expected_calibration_error": 0.28},
    regression={"average_precision": 0.01, "recall": 0.02, "precision": 0.01, "f1": 0.015, "roc_auc": 0.01, "brier_score": 0.01, "expected_calibration_error": 0.01})


def _metrics_sql(score: str, name: str) -> str:
    return f"""
    {name}_blocks AS (SELECT segment, {score} AS s, count(*) AS n, sum(y) AS pos FROM scored GROUP BY segment, {score}),
    {name}_cum AS (SELECT *, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(pos) OVER g AS tp, sum(n) OVER g AS tn FROM {name}_blocks
      WINDOW o AS (PARTITION BY segment ORDER BY s DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY segment)),
    {name}_rank AS (SELECT segment, sum(pos / tp * cp / cn) AS average_precision, sum((n - pos) * (cp - pos / 2)) / max(tp * (tn - tp)) AS roc_auc FROM {name}_cum GROUP BY segment),
    {name}_c AS (SELECT segment, count(*) FILTER (WHERE {score} >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE {score} < 0.5 AND y = 1) AS fn,
      count(*) FILTER (WHERE {score} >= 0.5 AND y = 1) AS tp, avg(({score} - y) * ({score} - y)) AS brier_score, count(*) AS n_rows FROM scored GROUP BY segment),
    {name}_b AS (SELECT *, ntile(10) OVER (PARTITION BY segment ORDER BY {score}, md5(CAST(id AS VARCHAR))) AS bin FROM scored),
    {name}_e AS (SELECT segment, sum(n * gap) / sum(n) AS expected_calibration_error FROM
      (SELECT segment, bin, count(*) AS n, abs(avg({score}) - avg(y)) AS gap FROM {name}_b GROUP BY ALL) GROUP BY segment),
    {name}_m AS (SELECT segment, n_rows, average_precision, tp / (tp + fn) AS recall, tp / (tp + fp) AS precision, 2 * tp / (2 * tp + fp + fn) AS f1,
      roc_auc, brier_score, expected_calibration_error FROM {name}_rank JOIN {name}_c USING (segment) JOIN {name}_e USING (segment))"""


def _absolute_sql(m: str) -> str:
    parts = [
        f"CASE WHEN {m}.{k} {'>' if k in LIMITS.lower_is_better else '<'} {v}e0 THEN 'absolute.{k}' END" for k, v in LIMITS.absolute.items()]
    return ", ".join(parts)


def _regression_sql(a: str, b: str) -> str:
    return ", ".join(
        f"CASE WHEN {f'{a}.{k} - {b}.{k}' if k in LIMITS.lower_is_better else f'{b}.{k} - {a}.{k}'} > {v}e0 THEN 'regression.{k}' END"
        for k, v in LIMITS.regression.items())


_NAMES = list(LIMITS.absolute)


@query("absolute_gates", f"""
WITH {SCORED_SQL}, {_metrics_sql('p', 'a')},
f AS (SELECT a.*, list_filter([{_absolute_sql('a')}], lambda x: x IS NOT NULL) AS failures FROM a_m a)
SELECT segment, n_rows, CASE WHEN len(failures) > 0 THEN 'failed' ELSE 'not_comparable' END AS status, array_to_string(failures, ',') AS failures,
  {', '.join(f'round({k}, 6) AS {k}' for k in _NAMES)} FROM f
""")
def absolute_gates(spark, sf):
    out = gt.evaluate(scored_orders(spark, sf), "label", "probability", 0.5, "id", LIMITS, ["segment"])
    return rounded(out.withColumn("failures", F.array_join("failures", ",")), 6, *_NAMES)


@query("champion_gates", f"""
WITH {SCORED_SQL}, {_metrics_sql('p', 'a')}, {_metrics_sql('champion', 'b')},
f AS (SELECT a.*, list_filter([{_absolute_sql('a')}, {_regression_sql('a', 'b')}], lambda x: x IS NOT NULL) AS failures,
  b.average_precision AS champion_average_precision, b.expected_calibration_error AS champion_expected_calibration_error FROM a_m a JOIN b_m b USING (segment))
SELECT segment, CASE WHEN len(failures) > 0 THEN 'failed' ELSE 'passed' END AS status, array_to_string(failures, ',') AS failures,
  round(champion_average_precision, 6) AS champion_average_precision, round(champion_expected_calibration_error, 6) AS champion_expected_calibration_error FROM f
""")
def champion_gates(spark, sf):
    out = gt.evaluate(
        scored_orders(spark, sf), "label", "probability", 0.5, "id", LIMITS, ["segment"], champion_score="champion", champion_threshold=0.5)
    out = out.withColumn("failures", F.array_join("failures", ",")).select(
        "segment", "status", "failures", "champion_average_precision", "champion_expected_calibration_error")
    return rounded(out, 6, "champion_average_precision", "champion_expected_calibration_error")


@query("gate_input_verdicts", f"""
WITH {SCORED_SQL}
SELECT segment, CASE segment WHEN '1-URGENT' THEN 'probability_validity' WHEN '2-HIGH' THEN 'target_class_coverage' WHEN '3-MEDIUM' THEN 'evaluation_input' END AS verdict, count(*) AS n_rows
FROM scored GROUP BY segment
""")
def gate_input_verdicts(spark, sf):
    segment = F.col("segment")
    rows = scored_orders(spark, sf).withColumns({
        "probability": F.when(segment == "1-URGENT", F.lit(float("nan"))).otherwise(F.col("probability")),
        "label": F.when(segment == "2-HIGH", 1).when(segment == "3-MEDIUM", 5).otherwise(F.col("label"))})
    return gt.input_verdict(rows, "label", "probability", 0.5, ["segment"]).select("segment", "verdict", "n_rows")


@query("latency_gates", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.95e0) AS p95 FROM events GROUP BY event_type)
SELECT event_type, g.gate, round(p95, 6) AS p95, g.lim AS "limit", p95 > g.lim AS failed
FROM q, (VALUES ('latency.single_p95_ms', 100e0), ('latency.batch_100_p95_ms', 500e0)) g(gate, lim)
""")
def latency_gates(spark, sf):
    return rounded(gt.latency_failures(table(spark, sf, "events"), "value", GatePolicy().latency, ["event_type"]), 6, "p95")


@query("gates_with_latency", f"""
WITH {SCORED_SQL}, {_metrics_sql('p', 'a')},
f AS (SELECT a.*, list_filter([{_absolute_sql('a')}], lambda x: x IS NOT NULL) AS failures FROM a_m a),
q AS (SELECT CASE WHEN event_type = 'error' THEN '1-URGENT' WHEN event_type = 'click' THEN '2-HIGH' ELSE '5-LOW' END AS segment, quantile_cont(value / 4, 0.95e0) AS p95 FROM events GROUP BY 1),
j AS (SELECT f.segment, list_concat(failures, CASE WHEN p95 IS NULL THEN ['latency.batch_100_p95_ms', 'latency.single_p95_ms']
  ELSE list_filter([CASE WHEN p95 > 500 THEN 'latency.batch_100_p95_ms' END, CASE WHEN p95 > 30 THEN 'latency.single_p95_ms' END], lambda x: x IS NOT NULL) END) AS failures
  FROM f LEFT JOIN q USING (segment))
SELECT segment, CASE WHEN len(failures) > 0 THEN 'failed' ELSE 'not_comparable' END AS status, array_to_string(failures, ',') AS failures FROM j
""")
def gates_with_latency(spark, sf):
    """Segments that are fast enough, too slow, and not measured at all."""
    policy = replace(LIMITS, latency={"single_p95_ms": 30.0, "batch_100_p95_ms": 500.0})
    kind = F.col("event_type")
    times = table(spark, sf, "events").select(
        F.when(kind == "error", "1-URGENT").when(kind == "click", "2-HIGH").otherwise("5-LOW").alias("segment"), (F.col("value") / 4).alias("ms"))
    verdicts = gt.evaluate(scored_orders(spark, sf), "label", "probability", 0.5, "id", policy, ["segment"])
    out = gt.with_latency(verdicts, times, "ms", policy, ["segment"])
    return out.select("segment", "status", F.array_join("failures", ",").alias("failures"))


# --- splits and models -----------------------------------------------------------------

SPLIT_SQL = """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey)) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
s AS (SELECT *, CASE WHEN rn <= round(n * 0.7e0) THEN 'train' WHEN rn <= round(n * 0.85e0) THEN 'validation' ELSE 'test' END AS split FROM r)
"""


def _split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return stratified_split(orders, key=["o_orderkey"], stratum=["o_orderstatus"], seed=42)


@query("stratified_split", SPLIT_SQL + "SELECT o_orderkey, o_orderstatus, split FROM s")
def stratified_split_query(spark, sf):
    return _split(spark, sf)


@query("stratified_split_sizes", SPLIT_SQL + "SELECT o_orderstatus, split, count(*) AS n FROM s GROUP BY ALL")
def stratified_split_sizes(spark, sf):
    return _split(spark, sf).groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"))


@query("reconstructed_training_part", SPLIT_SQL + "SELECT o_orderkey, o_orderstatus FROM s WHERE split = 'train'")
def reconstructed_training_part(spark, sf):
    return only(_split(spark, sf), "train")


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lines_of_parts(spark, sf, lines):
    """What the model table is made of, with 16 bytes for the id of a line."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    line = F.unhex(F.md5(F.concat_ws("-", *LINE_KEY))).alias("line")
    return lines.join(parts, "l_partkey").select("l_partkey", line, "l_quantity", "l_discount", "p_size", "p_retailprice")


def _modelled(rows):
    line_id = F.lower(F.hex("line"))
    signal = F.col("l_quantity") / 25 + F.col("p_size") / 50 - 1.5
    noise = F.pmod(F.xxhash64(line_id), F.lit(1000)) / 500 - 1
    return rows.select(
        line_id.alias("line_id"), (signal + noise > 0).cast("int").alias("label"), (F.col("l_quantity") / 50).alias("quantity"),
        (F.col("p_size") / 50).alias("size"), (F.col("p_retailprice") / 1000).alias("price"), F.col("l_discount").alias("discount"))


def model_table(spark, sf):
    """Lines with features of the line and of its part; the label depends on both plus noise by key."""
    return _modelled(_lines_of_parts(spark, sf, table(spark, sf, "lineitem")))


def distinct_model_table(spark, sf):
    """`model_table` with one row for each line_id.

    An id of five values names its part, so such lines are made distinct where the join has brought them together, without another
    shuffle. Ids leave out nulls: lines with one may share an id with lines of another part that have one, never with whole ones.
    """
    lines = table(spark, sf, "lineitem")
    holed = F.lit(False)
    for c in LINE_KEY:
        holed = holed | F.col(c).isNull()
    whole = _lines_of_parts(spark, sf, lines.where(~holed)).dropDuplicates(["l_partkey", "line"])
    return _modelled(whole.unionByName(_lines_of_parts(spark, sf, lines.where(holed)).dropDuplicates(["line"])))


FEATURES = ["quantity", "size", "price", "discount"]


def _train(spark, sf, family, **params):
    data = model_table(spark, sf).dropDuplicates(["line_id"])
    return data, tr.train(data, key=["line_id"], label="label", features=FEATURES, family=family, **params)


@query("logistic_training_run")
def logistic_training_run(spark, sf):
    _, model = _train(spark, sf, "logistic_regression", max_iter=100)
    return tr.run_record(model, spark, run_name="lineitem-logistic", family="logistic_regression", seed=42, code_revision="r1")


@query("boosted_trees_training_run")
def boosted_trees_training_run(spark, sf):
    _, model = _train(spark, sf, "boosted_trees", maxIter=5, maxDepth=3)
    return tr.run_record(model, spark, run_name="lineitem-trees", family="boosted_trees", seed=42, code_revision="r1")


@query("candidate_evaluation")
def candidate_evaluation(spark, sf):
    with settings(spark, SPENT_SHUFFLES | large_join(spark)):
        data = freeze(distinct_model_table(spark, sf), "model-table", compression="zstd")
    parts = tr.training_parts(data, key=["line_id"], label="label", keep=["label", *FEATURES])
    both = {"key": ["line_id"], "label": "label", "parts": parts}
    candidate = tr.train(data, features=FEATURES, max_iter=50, **both)
    champion = tr.train(data, features=["quantity"], max_iter=20, **both)
    out = tr.evaluate_candidate(data, key=["line_id"], label="label", candidate=candidate, champion=champion)
    return out.withColumn("failures", F.array_join("failures", ","))


@query("model_scores")
def model_scores(spark, sf):
    """Scores of a vector model on embeddings, per label."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.classification import LogisticRegression

    vectors = table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), (F.col("label") % 2).alias("label"))
    model = LogisticRegression(labelCol="label", regParam=0.01, standardization=False, maxIter=50).fit(vectors)
    from tarnwatch.operators.scoring import score_with_model

    return score_with_model(model, vectors, keep=["vec_id", "label"])


# --- follow-up measures --------------------------------------------------------------------

@query("two_sample_distances", """
WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS x, (l_shipdate < TIMESTAMP '1998-07-01')::INT AS ref FROM lineitem),
b AS (SELECT g, x, sum(ref) AS r, count(*) - sum(ref) AS c FROM v GROUP BY g, x),
c AS (SELECT *, sum(r) OVER o / sum(r) OVER a AS rf, sum(c) OVER o / sum(c) OVER a AS cf, lead(x) OVER (PARTITION BY g ORDER BY x) - x AS step FROM b
  WINDOW o AS (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY g))
SELECT g AS l_returnflag, round(max(abs(rf - cf)), 6) AS ks, round(sum(abs(rf - cf) * step), 3) AS wasserstein FROM c GROUP BY g
""")
def two_sample_distances(spark, sf):
    ref = F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp")
    out = mt.two_sample_distances(table(spark, sf, "lineitem"), "l_extendedprice", ref, ["l_returnflag"])
    return rounded(rounded(out, 6, "ks"), 3, "wasserstein")


@query("regression_deltas", f"""
WITH {SCORED_SQL}, {_metrics_sql('p', 'a')}, {_metrics_sql('champion', 'b')}
{" UNION ALL ".join(f"""SELECT a.segment, '{m}' AS metric, round(a.{m}, 6) AS candidate, round(b.{m}, 6) AS champion, round(a.{m} - b.{m}, 6) AS delta,
  {'a' if m in LIMITS.lower_is_better else 'b'}.{m} - {'b' if m in LIMITS.lower_is_better else 'a'}.{m} > {v}e0 AS failed FROM a_m a JOIN b_m b USING (segment)""" for m, v in LIMITS.regression.items())}
""")
def regression_deltas(spark, sf):
    """What the gates judge, measured on the rows; the intervals beside them are in `bootstrap_deltas`."""
    out = bs.regression_evidence(scored_orders(spark, sf), "label", "probability", "champion", "id", 0.5, 0.5, LIMITS, ["segment"], replicates=1)
    return rounded(out.select("segment", "metric", "candidate", "champion", "delta", "failed"), 6, "candidate", "champion", "delta")


@query("bootstrap_deltas")
def bootstrap_deltas(spark, sf):
    """Intervals of all seven differences over 2,000 stratified resamples. Random draws have no SQL: tests hold them to NumPy."""
    return bs.regression_evidence(scored_orders(spark, sf), "label", "probability", "champion", "id", 0.5, 0.5, LIMITS, ["segment"])
