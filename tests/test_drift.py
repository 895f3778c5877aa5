import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwatch import DriftPolicy
from tarnwatch.functions.special import chi_square_p
from tarnwatch.operators import drift as dr
from tarnwatch.operators import profile as pf
from tarnwatch.operators import scenario as sc

POLICY = DriftPolicy(minimum_sample_size=10)


@pytest.fixture(scope="module")
def reference(spark):
    pdf = pd.DataFrame({
        "id": [f"ref-{i}" for i in range(40)], "Churn": "No", "tenure": range(1, 41),
        "MonthlyCharges": [20.0 + i for i in range(40)], "Contract": ["Month-to-month", "One year"] * 20})
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def profile(reference):
    return pf.build_profile(reference, exclude=("id", "Churn"), lineage={"model_version": "m1", "schema_version": "v1"})


def window(df, name="w"):
    return df.withColumn("window_id", F.lit(name))


def score(df):
    return df.withColumn("p", F.when(F.col("tenure") < 12, 0.9).otherwise(0.2))


def test_identical_window_is_stable(reference, profile):
    run = dr.monitor(
        window(score(reference)), profile, policy=POLICY, reference_scores=score(reference), probability="p",
        threshold=0.55, low=0.2, high=0.7)
    assert run.runs.first()["run_status"] == "stable"
    rows = {r["feature"]: r for r in run.features.collect()}
    assert rows["tenure"]["psi"] == 0 and rows["Contract"]["jensen_shannon"] == pytest.approx(0, abs=1e-9)
    prediction = run.predictions.first()
    assert prediction["psi"] == 0 and prediction["n_low"] == 29 and prediction["n_high"] == 11


def test_shift_is_found(reference, profile):
    moved = sc.shift_numeric(reference, "tenure", 200).withColumn("Contract", F.lit("Two year"))
    rows = {r["feature"]: r for r in dr.feature_evidence(window(moved), profile, POLICY).collect()}
    assert rows["tenure"]["psi"] > 0.2 and rows["tenure"]["wasserstein"] is None and rows["tenure"]["n_outside"] == 40
    assert rows["tenure"]["out_of_range_rate"] == 1.0
    assert rows["Contract"]["jensen_shannon"] == pytest.approx(np.sqrt(np.log(2)), abs=1e-9)
    assert rows["Contract"]["status"] == "critical"


def test_nulls_and_new_categories_hurt_quality(reference, profile):
    number = F.substring("id", 5, 3).cast("int")
    bad = reference.withColumns({
        "MonthlyCharges": F.when(number >= 10, F.col("MonthlyCharges")),
        "Contract": F.when(number < 10, "New").otherwise(F.col("Contract"))})
    rows = {r["feature"]: r for r in dr.feature_evidence(window(bad), profile, POLICY).collect()}
    assert rows["MonthlyCharges"]["missing_rate"] == 0.25 and rows["MonthlyCharges"]["quality_status"] == "critical"
    assert rows["Contract"]["unknown_rate"] == 0.25 and rows["Contract"]["quality_status"] == "critical"


def test_small_window_is_insufficient(reference, profile):
    run = dr.monitor(window(reference.limit(2)), profile, policy=POLICY)
    assert run.runs.first()["run_status"] == "insufficient_data" and run.features.count() == 0


def test_incompatible_profile_and_window_fail_closed(reference, profile):
    reasons = pf.check_profile(profile, "0" * 64, lineage={"model_version": "m1"}, features=profile.features)
    assert reasons == ["checksum"]
    row = dr.checked_monitor(window(reference), profile, policy=POLICY, profile_reasons=reasons).first()
    assert (row["run_status"], row["error_class"]) == ("unknown", "baseline_incompatible")
    extra = window(reference).withColumn("unexpected", F.lit(1))
    row = dr.checked_monitor(extra, profile, policy=POLICY).first()
    assert (row["run_status"], row["error_class"]) == ("unknown", "current_window_incompatible")
    row = dr.checked_monitor(window(reference), profile, policy=POLICY).first()
    assert (row["run_status"], row["error_class"]) == ("stable", None)


def test_profile_survives_storage(spark, profile, reference, tmp_path):
    home = pf.save_profile(profile, str(tmp_path))
    loaded, identity = pf.load_profile(spark, home)
    assert pf.check_profile(loaded, identity, lineage=profile.lineage, features=profile.features) == []
    assert dr.feature_evidence(window(reference), loaded, POLICY).where("status <> 'stable'").count() == 0
    with pytest.raises(Exception):
        pf.save_profile(profile, str(tmp_path))


def test_constant_feature_gets_one_bin(spark):
    profile = pf.build_profile(spark.createDataFrame([(3.0,)] * 50, "x double"))
    assert profile.edges()["x"] == [3.0, 4.0] and profile.numeric[0]["counts"] == [50] and profile.numeric[0]["std"] == 0


def test_measures_equal_numpy(spark):
    rng = np.random.default_rng(0)
    ref, cur = rng.gamma(2, size=3000), rng.gamma(2.6, size=2000)
    profile = pf.build_profile(spark.createDataFrame(pd.DataFrame({"x": ref})))
    row = dr.feature_evidence(window(spark.createDataFrame(pd.DataFrame({"x": cur}))), profile).first()
    edges = sorted({round(float(np.quantile(ref, i / 10)), 8) for i in range(11)})
    count = lambda v: pd.cut(pd.Series(v), edges, include_lowest=True).value_counts(sort=False).to_numpy(float)
    r, c = count(ref), count(cur)
    rs, cs = r / r.sum(), c / c.sum()
    assert list(r) == profile.numeric[0]["counts"]
    assert row["psi"] == pytest.approx(np.sum((cs - rs) * np.log((cs + 1e-6) / (rs + 1e-6))), abs=1e-12)
    mids = (np.array(edges[1:]) + np.array(edges[:-1])) / 2
    assert row["wasserstein"] == pytest.approx(np.sum(np.abs(np.cumsum(rs) - np.cumsum(cs))[:-1] * np.diff(mids)), abs=1e-12)


def test_a_category_named_like_the_unknown_cell(spark):
    """Known occurrences of the reserved name are counted in no cell."""
    base = spark.createDataFrame([("a",)] * 60 + [("__UNKNOWN__",)] * 40, "c string")
    profile = pf.build_profile(base)
    now = spark.createDataFrame([("a",)] * 50 + [("__UNKNOWN__",)] * 30 + [("z",)] * 20, "c string")
    row = dr.feature_evidence(window(now), profile).first()
    p, q = np.array([0.6, 0.4]), np.array([50 / 70, 20 / 70])
    m = (p + q) / 2
    assert row["unknown_rate"] == 0.2
    assert row["jensen_shannon"] == pytest.approx(np.sqrt(np.sum(p * np.log(p / m) + q * np.log(q / m)) / 2), abs=1e-12)


@pytest.mark.parametrize("statistic,degrees,p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
    (18.307038053275146, 10, 0.05), (0.0, 4, 1.0), (300.0, 5, 0.0)])
def test_chi_square_tail(spark, statistic, degrees, p):
    df = spark.createDataFrame([(statistic, degrees)], "x double, k long")
    assert df.select(chi_square_p(F.col("x"), F.col("k"))).first()[0] == pytest.approx(p, abs=1e-9)


def test_false_discovery_known_answer(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", None)], "feature string, p double")
    got = {r["feature"]: r["adjusted_p_value"] for r in dr.adjust_p_values(df.withColumn("g", F.lit(1)), "p", ["g"]).collect()}
    assert got["a"] == pytest.approx(0.04) and got["b"] == got["c"] == pytest.approx(0.16 / 3)
    assert got["d"] == 0.5 and got["e"] is None


def test_many_features_keep_one_scan_per_kind(spark):
    """The plan reads the windows once for all numeric columns, however many there are."""
    cols = [F.rand(i).alias(f"x{i}") for i in range(40)]
    df = spark.range(500).select(*cols)
    profile = pf.build_profile(df)
    plan = dr.numeric_counts(window(df), profile, ["window_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1


def test_scenario_sizes(spark):
    base = spark.range(100).withColumns({"tenure": F.col("id").cast("double"), "Contract": F.lit("a")})
    assert sc.shift_numeric(base, "tenure", 100).agg(F.min("tenure")).first()[0] == 100
    assert sc.replace_category(base, "Contract", value="b", fraction=0.4, seed=1, key=["id"]).where("Contract = 'b'").count() == 40
    assert sc.blank_out(base, "tenure", fraction=0.2, seed=1, key=["id"]).where("tenure IS NULL").count() == 20
    assert sc.blank_out(base, "tenure", fraction=0.0, seed=1, key=["id"]).where("tenure IS NULL").count() == 0
    assert sc.blank_out(base, "tenure", fraction=1.0, seed=1, key=["id"]).where("tenure IS NULL").count() == 100


def test_calibration_known_answers(spark):
    def outcomes(false_alarms, detected, delay):
        rows = [("stable", "warning" if i < false_alarms else "stable", None) for i in range(20)]
        rows += [("material", "critical" if i < detected else "stable", delay) for i in range(10)]
        return spark.createDataFrame(rows, "scenario string, status string, detection_windows int")

    assert sc.calibration_score(outcomes(0, 8, 2)).first()["accepted"]
    assert not sc.calibration_score(outcomes(2, 7, 3)).first()["accepted"]
    assert sc.policy_identity(sc.CalibrationPolicy()) == sc.policy_identity(sc.CalibrationPolicy())
