from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwatch import AlertPolicy, ExportPolicy, GatePolicy, StorePolicy
from tarnwatch.config import PolicyError
from tarnwatch.operators import alerts as al
from tarnwatch.operators import compare as cp
from tarnwatch.operators import export as ex
from tarnwatch.operators import gates as gt
from tarnwatch.operators import store as st
from tarnwatch.operators import telemetry as te
from tarnwatch.sources import files, manifest, results
from tarnwatch.sources.files import EVIDENCE_SCHEMA
from tarnwatch.streaming import lifecycle as lc

START = datetime(2024, 3, 11)
POLICY = AlertPolicy(minimum_sample_size=60, minimum_coverage=0.7)
SIGNALS = {"drift": "basket_size", "data_quality": "basket_size", "operational": "queue", "performance": "ranking"}


def ev(result, domain="drift", status="warning", at=START, n=900, coverage=0.95):
    """A row of evidence on the shop's ranking model."""
    row = dict.fromkeys(c.split()[0] for c in EVIDENCE_SCHEMA.split(", "))
    row |= {"source_result_id": result, "domain": domain, "source_status": status, "signal": SIGNALS[domain], "window_id": f"{at:%Y-%m-%d}",
            "window_end": at, "sample_size": n, "label_coverage": coverage, "model_version": "shop-7", "config_version": "cfg-2", "data_origin": "replayed"}
    return tuple(row.values())


def evidence(spark, *rows):
    return spark.createDataFrame(list(rows), EVIDENCE_SCHEMA)


def days(n, **kw):
    return [ev(f"r{i}", at=START + timedelta(days=i), **kw) for i in range(n)]


def test_persistence(spark):
    assert al.open_alerts(evidence(spark, ev("r1")), POLICY).count() == 0
    rows = al.open_alerts(evidence(spark, *days(3)), POLICY).collect()
    assert [(r["severity"], r["persistence_count"], r["state"]) for r in rows] == [("warning", 3, "open")]


def test_operational_unknown_is_critical_at_once(spark):
    row = al.open_alerts(evidence(spark, ev("j", "operational", "unknown")), POLICY).first()
    assert (row["domain"], row["severity"], row["persistence_count"]) == ("operational", "critical", 1)


def test_recommendation_needs_evidence(spark):
    def made(**kw):
        alerts = al.open_alerts(evidence(spark, ev("p", "performance", "critical", **kw), ev("d", "drift", "critical")), POLICY)
        return al.recommendations(alerts, POLICY).collect()

    assert len(made(n=60, coverage=0.75)) == 1 and not made(n=60, coverage=0.75)[0]["promotion_approved"]
    assert made(n=59, coverage=0.75) == [] and made(n=60, coverage=None) == []


@pytest.mark.parametrize("seconds,length", [(0, 2), (1, 1)])
def test_gap_border(spark, seconds, length):
    rows = evidence(spark, ev("a"), ev("b", at=START + timedelta(days=2, seconds=seconds)))
    assert al.tail_runs(rows, ["signal"], "window_end", 2).first()["run_length"] == length


def test_same_window_counts_twice_and_gaps_cut(spark):
    rows = evidence(spark, ev("a"), ev("b"), ev("c", at=START + timedelta(days=9)), ev("d", at=START + timedelta(days=9)), ev("e", at=START + timedelta(days=10)))
    assert al.tail_runs(rows, ["signal"], "window_end", 2).first()["run_length"] == 3


def test_tail_runs_equal_brute_force_with_a_hot_key(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    keys = np.where(rng.random(3000) < 0.4, "hot", rng.integers(0, 30, 3000).astype(str))
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 200 * 86400, 3000), unit="s")
    pdf = pd.DataFrame({"k": keys, "at": at})
    got = {r["k"]: r["run_length"] for r in al.tail_runs(spark.createDataFrame(pdf), ["k"], "at", 2).collect()}
    for key, group in pdf.groupby("k"):
        times = sorted(group["at"], reverse=True)
        n = 1
        for a, b in zip(times, times[1:]):
            if a - b > pd.Timedelta(days=2):
                break
            n += 1
        assert got[key] == n


def log(spark, *rows):
    return spark.createDataFrame(
        [(a, i, START + timedelta(hours=i), act, actor, why) for a, i, act, actor, why in rows],
        "alert_id string, action_id int, at timestamp, action string, actor_id string, reason string")


def test_delivery_again_after_a_day_and_on_higher_severity(spark):
    rows = [("a", START + timedelta(hours=12 * k), k, 0) for k in range(20)]
    rows += [("b", START, 0, 0), ("b", START + timedelta(hours=1), 1, 2), ("b", START + timedelta(hours=2), 2, 1),
             ("b", START + timedelta(hours=25), 3, 0), ("b", START + timedelta(hours=24, minutes=59), 4, 2), (None, START, 0, 0), (None, START, 1, 0)]
    df = spark.createDataFrame(rows, "k string, at timestamp, id int, severity int")
    got = al.delivery_decisions(df, ["k"], "at", "id", F.col("severity"))
    assert got.count() == len(rows)
    delivered = sorted((r["k"] or "", r["id"]) for r in got.where("delivered").collect())
    assert delivered == [("", 0)] + [("a", k) for k in range(0, 20, 2)] + [("b", 0), ("b", 1), ("b", 3)]
    assert al.delivery_decisions(df.limit(0), ["k"], "at", "id").count() == 0


def test_suppression_has_no_frame_that_is_taken_anew_for_every_row(spark, monkeypatch):
    """A frame from a row to the end of its partition is the square of a slot's emissions."""
    plans = []

    def kept(df, label="table"):
        plans.append(df._jdf.queryExecution().toString())
        return df

    monkeypatch.setattr(al, "freeze", kept)
    rows = [("a", START + timedelta(minutes=k), k, int(k == 40)) for k in range(50)]
    got = al.delivery_decisions(spark.createDataFrame(rows, "k string, at timestamp, id int, severity int"), ["k"], "at", "id", F.col("severity"))
    assert [r["id"] for r in got.where("delivered").orderBy("id").collect()] == [0, 40]
    assert any("windowframe" in plan.lower() for plan in plans) and not any("unboundedfollowing" in plan.lower() for plan in plans)


def test_settled_batches_follow_each_other(spark):
    def log(*rows):
        return spark.createDataFrame([(a, i, START + timedelta(hours=h), act, "me", "why") for a, i, h, act in rows],
                                     "alert_id string, action_id string, at timestamp, action string, actor_id string, reason string")

    none = spark.createDataFrame([], "alert_id string, state string")
    first = lc.settle(log(("x", "1", 1, "resolve"), ("x", "2", 2, "acknowledge"), ("x", "3", 3, "acknowledge"), ("y", "4", 1, "suppress"), ("y", "5", 2, "resolve")), none)
    assert [(r["action_id"], r["accepted"], r["state"]) for r in first.orderBy("action_id").collect()] == [
        ("1", False, "open"), ("2", True, "acknowledged"), ("3", False, "acknowledged"), ("4", True, "suppressed"), ("5", False, "suppressed")]
    states = spark.createDataFrame([("x", "acknowledged"), ("y", "suppressed")], "alert_id string, state string")
    second = lc.settle(log(("x", "6", 5, "acknowledge"), ("x", "7", 6, "resolve"), ("x", "8", 7, "suppress"), ("y", "9", 5, "resolve")), states)
    assert [(r["accepted"], r["state"]) for r in second.orderBy("action_id").collect()] == [
        (False, "acknowledged"), (True, "resolved"), (False, "resolved"), (False, "suppressed")]


def test_lifecycle(spark):
    rows = log(
        spark, ("a", 1, "acknowledge", "x", "r"), ("a", 2, "resolve", "x", "r"), ("b", 1, "resolve", "x", "r"),
        ("c", 1, "suppress", "x", "r"), ("c", 2, "acknowledge", "x", "r"), ("d", 1, "acknowledge", "", "r"),
        ("e", 1, "resolve", "x", "r"), ("e", 2, "acknowledge", "x", "r"), ("e", 3, "acknowledge", "x", "r"),
        ("f", 1, "acknowledge", "x", "r"), ("f", 2, "suppress", "x", "r"), ("f", 3, "resolve", "x", "r"))
    got = {r["alert_id"]: (r["state"], r["accepted"], r["rejected"]) for r in al.lifecycle(rows).collect()}
    assert got == {
        "a": ("resolved", 2, 0), "b": ("open", 0, 1), "c": ("suppressed", 1, 1), "d": ("open", 0, 1),
        "e": ("acknowledged", 1, 2), "f": ("suppressed", 2, 1)}
    assert al.action_history(rows).where("alert_id = 'a'").count() == 2


def test_evidence_key(spark):
    a = evidence(spark, *days(2))
    assert al.evidence_key(a, POLICY).first()[0] == al.evidence_key(a.orderBy(F.desc("source_result_id")), POLICY).first()[0]
    assert al.evidence_key(a, POLICY).first()[0] != al.evidence_key(a, AlertPolicy()).first()[0]


# --- store and export -----------------------------------------------------------

NOW = datetime(2026, 8, 3, 12)


def rec(i="r1", kind="monitoring", status="stable", end=NOW, n=500, summary=None, distribution="{}", model="m", computed=None):
    return (i, kind, status, "replayed", end - timedelta(days=1), end, computed or end, n, None, "v", "c", model, "b", "dep", summary or {"drifted_feature_count": 0.0, "note": 1.0}, distribution)


def recs(spark, *rows):
    return spark.createDataFrame(list(rows), st.RECORD_SCHEMA)


def test_ingest_is_idempotent_and_private(spark, tmp_path):
    store = st.MetricsTable(spark, str(tmp_path))
    outcome = lambda df: sorted((r["result_id"], r["outcome"]) for r in store.ingest(df).collect())
    assert outcome(recs(spark, rec())) == [("r1", "ingested")]
    assert outcome(recs(spark, rec(n=7, computed=NOW + timedelta(hours=1)))) == [("r1", "reused")]
    assert outcome(recs(spark, rec(status="critical"))) == [("r1", "conflict")]
    assert outcome(recs(spark, rec("x", summary={"customer_id": 1.0}), rec("y", distribution='{"raw_payload": {"x": 1}}'))) == [
        ("x", "invalid"), ("y", "invalid")]
    assert outcome(recs(spark, rec("z", status="warning", computed=NOW + timedelta(hours=1)), rec("z"), rec("z"))) == [
        ("z", "conflict"), ("z", "ingested")]
    spoiled = rec("q", n=-1, computed=NOW)
    assert outcome(recs(spark, spoiled, rec("q", computed=NOW + timedelta(hours=1)))) == [("q", "ingested"), ("q", "invalid")]
    assert store.read().where("result_id = 'q'").first()["sample_size"] == 500
    assert store.dimension("deployment_id").first()["model_version"] == "m"
    store = st.MetricsTable(spark, str(tmp_path / "other"))
    assert outcome(recs(spark, rec(), rec("z"))) == [("r1", "ingested"), ("z", "ingested")]
    assert store.count() == 2 and store.count("monitoring") == 2 and store.count("alert") == 0


def test_retention_keeps_dimensions(spark, tmp_path):
    store = st.MetricsTable(spark, str(tmp_path))
    store.ingest(recs(spark, rec("old", end=NOW - timedelta(days=400), model="m0"), rec("new"), rec("edge", end=NOW - timedelta(days=365)),
                      rec("gone", end=NOW - timedelta(days=365, seconds=1))))
    assert store.apply_retention(str(NOW), StorePolicy(retention_days=365)) == 2
    assert sorted(r["result_id"] for r in store.read().collect()) == ["edge", "new"]
    assert store.dimension("model_version").count() == 2
    assert store.apply_retention(str(NOW), StorePolicy(retention_days=365)) == 0


def test_two_writers_at_once_leave_every_record_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    store = st.MetricsTable(spark, str(tmp_path))
    store.ingest(recs(spark, rec("before")))
    batches = [recs(spark, *[rec(f"r{k}", model=f"m{k % 3}") for k in range(lo, lo + 12)]) for lo in (0, 0, 6, 0)]
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda df: [tuple(r) for r in store.ingest(df).select("result_id", "outcome").collect()], batches))
    counted = [(i, o) for part in found for i, o in part]
    assert sorted(i for i, o in counted if o == "ingested") == sorted(f"r{k}" for k in range(18))
    assert sum(o == "reused" for _, o in counted) == 48 - 18
    assert sorted(r["result_id"] for r in store.read().collect()) == sorted(["before", *(f"r{k}" for k in range(18))])
    assert sorted(r["model_version"] for r in store.dimension("model_version").collect()) == ["m", "m0", "m1", "m2"]
    assert [c.number for c in store.commits()] == list(range(len(store.commits())))


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = st.MetricsTable(spark, str(tmp_path))
    store.ingest(recs(spark, rec("a")))
    for broken in ("publish", "write"):
        with monkeypatch.context() as patch:
            if broken == "publish":
                patch.setattr(st, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            else:
                patch.setattr(st.MetricsTable, "_write_batch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                store.ingest(recs(spark, rec("b", model="mb")))
        assert [r["result_id"] for r in store.read().collect()] == ["a"] and store.dimension("model_version").count() == 1
    assert len(store.sweep(0)) == 3                     # results and dimensions that were written, but not published
    assert [r["outcome"] for r in store.ingest(recs(spark, rec("b", model="mb"))).collect()] == ["ingested"]
    assert store.sweep(0) == [] and store.count() == 2 and store.dimension("model_version").count() == 2


def test_retention_is_one_step_and_leaves_later_batches_alone(spark, tmp_path):
    store = st.MetricsTable(spark, str(tmp_path))
    old = NOW - timedelta(days=400)
    store.ingest(recs(spark, rec("old", end=old), rec("new")))
    held = store.commits()
    assert store.apply_retention(str(NOW), StorePolicy(retention_days=365)) == 1
    assert sorted(r["result_id"] for r in store.read(held).collect()) == ["new", "old"]       # a reader of before
    store.ingest(recs(spark, rec("late", end=old)))
    assert sorted(r["result_id"] for r in store.read().collect()) == ["late", "new"]
    assert store.sweep() == [] and len(store.sweep(0)) == 1
    assert sorted(r["result_id"] for r in store.read().collect()) == ["late", "new"]
    assert store.apply_retention(str(NOW), StorePolicy(retention_days=365)) == 1
    assert [r["result_id"] for r in store.read().collect()] == ["new"]


def test_a_name_is_published_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from tarnwatch.sources.publish import published, publish
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: publish(spark, f"{tmp_path}/marks/one", str(k)), range(24)))
    assert sum(won) == 1 and published(spark, f"{tmp_path}/marks") == [("one", str(won.index(True)))]


def test_dashboard_states(spark):
    state = lambda hours, *rows: tuple(st.latest_state(recs(spark, *rows), F.lit(NOW + timedelta(hours=hours))).first()[:2])
    row = rec(status="not_available", n=0)
    assert state(49, row) == ("not_available", "stale") and state(24, row)[1] == "fresh" and state(48, row)[1] == "late"
    assert state(0) == ("not_available", "not_available")


def test_snapshot_shows_only_what_is_allowed(spark, tmp_path):
    log_ = ex.SnapshotLog(spark, str(tmp_path))
    current = log_.export(recs(spark, rec()), "2026-08-03T12:00:00Z").first()
    assert '"metrics":{"drifted_feature_count":0.0}' in current["payload"] and "note" not in current["payload"] and "dep" not in current["payload"]
    assert current["freshness"] == "fresh"
    stale = log_.export(recs(spark, rec(kind="odd")), "2026-08-03T12:01:00Z").first()
    assert (stale["snapshot_id"], stale["freshness"], stale["reason"]) == (current["snapshot_id"], "stale", "export_failed")
    assert ex.resource(log_.published(), "methodology").first()["data"].startswith('{"candidate_mode":true')


def test_first_failure_has_nothing_to_keep(spark, tmp_path):
    with pytest.raises(PolicyError):
        ex.SnapshotLog(spark, str(tmp_path)).export(recs(spark, rec(kind="odd")), "2026-08-03T12:01:00Z")


def test_suppression_and_bound(spark):
    import json

    doc = json.loads(ex.snapshot(recs(spark, rec(n=99)), "t").first()["payload"])
    assert doc["monitoring"]["history"] == [{
        "result_type": "monitoring", "evidence_state": "suppressed", "data_origin": "replayed", "suppression_reason": "minimum_group_size"}]
    doc = json.loads(ex.snapshot(recs(spark, *[rec(f"m{i:03d}") for i in range(101)]), "t").first()["payload"])
    assert len(doc["monitoring"]["history"]) == 100 and len(doc["models"]["history"]) == 1
    doc = json.loads(ex.snapshot(recs(spark), "t").first()["payload"])
    assert doc["overview"]["evidence_state"] == "not_available" and doc["models"] == {"current": None, "history": []}


# --- gates --------------------------------------------------------------------------

def gate(spark, y, s, champion=None, **kw):
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate(zip(y, s, champion or s))]
    df = spark.createDataFrame(rows, "id int, y int, s double, c double")
    extra = {"champion_score": "c", "champion_threshold": 0.5} if champion else {}
    return gt.evaluate(df, "y", "s", 0.5, "id", GatePolicy(), **extra, **kw).first()


def test_gates(spark):
    y = [0, 0, 1, 1, 0, 1, 0, 1]
    assert gate(spark, y, [float(v) for v in y])["status"] == "not_comparable"
    weak = gate(spark, y, [0.51, 0.52, 0.50, 0.49, 0.48, 0.51, 0.52, 0.50])
    assert weak["status"] == "failed" and "absolute.average_precision" in weak["failures"]
    assert gate(spark, [0, 1], [0.2, float("nan")])["failures"] == ["probability_validity"]
    assert gate(spark, [1, 1], [0.2, 0.3])["failures"] == ["target_class_coverage"]
    assert gate(spark, [], [])["failures"] == ["evaluation_input"]


def test_regression_against_a_champion(spark):
    y = [0, 0, 1, 1, 0, 1, 0, 1, 0, 1]
    champion = [0.01, 0.02, 0.99, 0.98, 0.03, 0.97, 0.04, 0.96, 0.05, 0.95]
    row = gate(spark, y, [0.15, 0.20, 0.85, 0.70, 0.25, 0.75, 0.30, 0.80, 0.35, 0.65], champion)
    assert row["status"] == "failed" and any(f.startswith("regression.") for f in row["failures"])
    assert gate(spark, y, champion, champion)["status"] == "passed"


# --- the rest -------------------------------------------------------------------------

def test_latency_buckets(spark):
    got = {r["le"]: r["n"] for r in te.latency_histogram(spark.createDataFrame([(12.5,)], "ms double"), "ms").collect()}
    assert (got["10"], got["25"], got["+Inf"]) == (0, 1, 1)


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (4, None, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.00005, "x"), (3, 2.0, "y"), (4, None, "w")], "k int, v double, s string")
    got = sorted((r["k"], r["field"], r["problem"]) for r in cp.differences(a, b, ["k"]).collect())
    assert got == [(2, "*", "unexpected"), (3, "*", "missing"), (4, "s", "value")]
    assert cp.differences(a, a, ["k"]).count() == 0
    assert {(r["field"], r["problem"]) for r in cp.differences(a.drop("v").withColumn("n", F.lit(1)), a, ["k"]).collect()} == {
        ("v", "missing_field"), ("n", "unexpected_field")}


def test_write_once_recovers_from_a_half_written_result(spark, tmp_path):
    inputs = {"a": 1}
    half = tmp_path / f"key={results.result_key(inputs)}"
    half.mkdir()
    (half / "part-0.parquet").write_text("broken")
    first = results.write_once(spark, str(tmp_path), inputs, lambda: spark.range(3))
    second = results.write_once(spark, str(tmp_path), inputs, lambda: spark.range(99))
    assert (first.reused, second.reused, second.data.count()) == (False, True, 3)


def test_manifest_refuses_changed_data(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    m = manifest.build_manifest(df, schema_version="v", source_name="s", code_revision="r")
    assert manifest.load_verified(df.repartition(5), m, schema_version="v", source_name="s").row_count == 100
    with pytest.raises(PolicyError, match="checksum"):
        manifest.load_verified(df.withColumn("x", F.col("id") * 3), m, schema_version="v", source_name="s")
    with pytest.raises(PolicyError, match="row_count"):
        manifest.load_verified(df.union(df), m, schema_version="v", source_name="s")
    with pytest.raises(PolicyError):
        manifest.build_manifest(df, schema_version="v", source_name="s", code_revision=" ")


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,total\n1,\n2,3.5\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "id string, total string", ["total"]).orderBy("id").collect()
    assert [r["total"] for r in rows] == ["", "3.5"]
    (tmp_path / "d.json").write_text('{"records": [{"a": 1, "b": "x"}, {"a": 2}]}')
    assert files.read_records_document(spark, str(tmp_path / "d.json"), "a int, b string", ["a", "b"]).count() == 1
    (tmp_path / "l.json").write_text('{"at": "2026-08-01START2:00:00+02:00"}\n{"at": "2026-08-01START0:00:00Z"}\n')
    assert files.read_json_lines(spark, str(tmp_path / "l.json"), "at timestamp").distinct().count() == 1
