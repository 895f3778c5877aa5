import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarnwatch import DriftPolicy
from tarnwatch.config import PolicyError
from tarnwatch.operators import drift as dr
from tarnwatch.operators import monitoring as mo
from tarnwatch.operators import profile as pf
from tarnwatch.plans.freeze import freeze

POLICY = DriftPolicy(minimum_sample_size=10)
LADDER = {"threshold": 0.5, "low": 0.2, "high": 0.7}


def rows_of(spark, names, n=40):
    rows = [(f"{name}-{i}", name, float(i), "ab"[i % 2]) for name in names for i in range(n)]
    return spark.createDataFrame(rows, "id string, window_id string, x double, kind string")


def score(df):
    return df.withColumn("probability", (F.col("x") + 0.5) / 41)


@pytest.fixture(scope="module")
def frozen(spark):
    profile = pf.build_profile(rows_of(spark, ["r"]).drop("id", "window_id"), lineage={"model_version": "m1"})
    return profile, pf.profile_identity(profile).first()["profile_id"]


@pytest.fixture(scope="module")
def scores(spark):
    return mo.build_score_reference(score(rows_of(spark, ["r"])), "probability", **LADDER)


def run(folder, windows, frozen, **more):
    profile, identity = frozen
    given = {"profile_id": identity, "identity": "w1", "policy": POLICY, **more}
    return mo.monitoring_run(str(folder), windows, profile, **given)


def outcome(result):
    return {r["window_id"]: (r["sample_size"], r["run_status"], r["error_class"]) for r in result.data.collect()}


def test_references_of_parts_add_up_and_survive_storage(spark, scores, tmp_path):
    whole = score(rows_of(spark, ["r"]))
    parts = [mo.build_score_reference(whole.where(c), "probability", **LADDER) for c in ("x < 13", "x >= 13")]
    added = parts[0] + parts[1]
    assert (added.counts, added.n, added.n_positive) == (scores.counts, scores.n, scores.n_positive)
    assert added.total == pytest.approx(scores.total)
    kept = mo.save_score_reference(spark, scores, str(tmp_path))
    assert mo.load_score_reference(kept.data) == scores
    assert mo.save_score_reference(spark, scores, str(tmp_path)).reused
    with pytest.raises(PolicyError):
        scores + mo.build_score_reference(whole, "probability", threshold=0.6, low=0.2, high=0.7)
    for bad in (whole.withColumn("probability", F.lit(1.5)), whole.limit(0)):
        with pytest.raises(PolicyError):
            mo.build_score_reference(bad, "probability", **LADDER)


def test_kept_reference_measures_like_raw_scores(spark, scores):
    now = score(rows_of(spark, ["a", "b"])).withColumn("probability", F.when(F.col("window_id") == "b", F.col("probability") / 2).otherwise(F.col("probability")))
    kept = mo.score_drift(now, "probability", scores, policy=POLICY).orderBy("window_id").collect()
    raw = dr.prediction_drift(score(rows_of(spark, ["r"])), now, "probability", policy=POLICY, **LADDER).orderBy("window_id").collect()
    assert kept == raw and kept[0]["psi"] == 0 and kept[1]["status"] == "critical"


def test_a_window_fails_by_itself_and_the_result_is_stored_once(spark, frozen, scores, tmp_path):
    names = ["good", "unreadable", "unscored", "improbable", "moved", None, *[f"w{k}" for k in range(9)]]
    window, x = F.col("window_id"), F.col("x")
    windows = rows_of(spark, names).withColumn(
        "x", F.when((window == "unreadable") & (x == 7), F.raise_error(F.lit("no"))).otherwise(x))
    small = rows_of(spark, ["small"], 3)

    @F.udf("double")
    def fails(name, p):
        if name == "unscored" and p > 0.9:
            raise ValueError("a model that fails")
        return {"improbable": 1.5, "moved": p / 3}.get(name, p)

    model = lambda df: score(df).withColumn("probability", fails("window_id", "probability"))
    result = run(tmp_path, windows.unionByName(small), frozen, score=model, reference=scores)
    stable = (40, "stable", None)
    assert not result.reused and outcome(result) == {
        "good": stable, None: stable, **{f"w{k}": stable for k in range(9)}, "moved": (40, "critical", None),
        "unreadable": (40, "unknown", "monitoring_failure"), "unscored": (40, "unknown", "monitoring_failure"),
        "improbable": (40, "unknown", "current_window_incompatible"), "small": (3, "insufficient_data", None)}
    again = run(tmp_path, windows.unionByName(small), frozen, score=model, reference=scores)
    assert again.reused and outcome(again) == outcome(result)
    other = run(tmp_path, rows_of(spark, ["good"]), frozen, identity="w2")
    assert not other.reused and outcome(other) == {"good": stable}


def test_prerequisites(spark, frozen, scores, tmp_path):
    windows = rows_of(spark, ["a", "b"])
    failed = lambda reason: {w: (40, "unknown", reason) for w in "ab"}
    assert outcome(run(tmp_path, windows, frozen, lineage={"model_version": "m2"})) == failed("baseline_incompatible")
    assert outcome(run(tmp_path, windows, frozen, profile_id="0" * 64)) == failed("baseline_incompatible")
    assert outcome(run(tmp_path, windows.withColumn("more", F.lit(1)), frozen, identity="w3")) == failed("current_window_incompatible")
    assert outcome(run(tmp_path, windows.limit(0), frozen, identity="w4")) == {}
    for wrong in ({"score": score}, {"reference": scores}, {"score": score, "reference": scores, "most_scored": 5}):
        with pytest.raises(PolicyError):
            run(tmp_path, windows, frozen, **wrong)


def test_what_is_no_evidence_is_raised_and_stores_nothing(spark, frozen, tmp_path):
    lost = str(tmp_path / "windows")
    rows_of(spark, ["a"]).write.parquet(lost)
    windows = spark.read.parquet(lost)
    for file in (tmp_path / "windows").glob("*.parquet"):
        file.write_bytes(b"")
    with pytest.raises((PySparkException, Py4JJavaError)):
        run(tmp_path / "results", windows, frozen)
    assert not list((tmp_path / "results").rglob("marker/*"))


def test_causes_are_found_behind_a_failed_write(spark):
    with pytest.raises(PySparkException) as caught:
        freeze(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("x")))
    assert mo.caused_by_values(caught.value)


def test_samples_are_bounded_and_of_each_window(spark, frozen, scores, tmp_path):
    seen = []
    model = lambda df: seen.append(df.groupBy("window_id").count().collect()) or score(df)
    result = run(tmp_path, rows_of(spark, ["a", "b"], 60), frozen, score=model, reference=scores, most_scored=20)
    assert {tuple(r) for r in seen[0]} == {("a", 20), ("b", 20)} and result.data.count() == 2


def test_identity_of_windows_ignores_order(spark):
    df = rows_of(spark, ["a", None])
    assert mo.window_identity(df) == mo.window_identity(df.repartition(5).select("x", "kind", "id", "window_id"))
    assert mo.window_identity(df) != mo.window_identity(df.withColumn("x", F.col("x") + 1))
    assert mo.window_identity(df.limit(0)) == mo.window_identity(df.limit(0))
