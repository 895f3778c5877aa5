import hashlib
import hmac

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch.config import PolicyError
from tarnwatch.functions.expressions import keyed_pseudonym, ladder, number_from_text, risk_band, trace_id, worst_of
from tarnwatch.operators import contract as ct
from tarnwatch.operators import features as fe
from tarnwatch.operators.split import stratified_split
from tarnwatch.presets import FEATURE_RECIPE, REQUEST_CONTRACT, REQUEST_TO_TRAINING_NAMES, TRAINING_COLUMNS, TRAINING_CONTRACT

ROW = {
    "id": "1", "gender": "Female", "SeniorCitizen": 0, "Partner": "Yes", "Dependents": "No", "tenure": 2, "PhoneService": "Yes",
    "MultipleLines": "No", "InternetService": "DSL", "OnlineSecurity": "Yes", "OnlineBackup": "No", "DeviceProtection": "Yes",
    "TechSupport": "No", "StreamingTV": "No", "StreamingMovies": "No", "Contract": "Month-to-month", "PaperlessBilling": "Yes",
    "PaymentMethod": "Credit card (automatic)", "MonthlyCharges": 50.0, "TotalCharges": "100.0", "Churn": "No"}


def table(spark, *changes):
    rows = [{**ROW, **c} for c in changes or ({},)]
    schema = T.StructType([T.StructField(c, {"SeniorCitizen": T.IntegerType(), "tenure": T.IntegerType(), "MonthlyCharges": T.DoubleType()}.get(
        c, T.StringType())) for c in TRAINING_COLUMNS])
    return spark.createDataFrame(rows, schema)


def test_valid_row_is_accepted(spark):
    assert len(ct.require(table(spark), TRAINING_CONTRACT).columns) == 21


def test_missing_column_is_named(spark):
    with pytest.raises(PolicyError, match="MonthlyCharges"):
        ct.require(table(spark).drop("MonthlyCharges"), TRAINING_CONTRACT)


def test_all_failures_are_reported_together(spark):
    bad = table(spark, {"Contract": "Weekly"}, {}, {"id": "2", "TotalCharges": " ", "tenure": 5})
    found = {(r["column"], r["check"]): r["n_fail"] for r in ct.violation_report(bad, TRAINING_CONTRACT).collect()}
    assert found == {("Contract", "domain"): 1, ("id", "unique"): 2, ("row", "blank_total"): 1}


def test_cross_field_rules(spark):
    bad = table(spark, {"PhoneService": "No", "MultipleLines": "Yes"}, {"id": "2", "InternetService": "No"})
    found = {(r["column"], r["check"]) for r in ct.violation_report(bad, TRAINING_CONTRACT).collect()}
    assert found == {("row", "phone"), ("row", "internet")}


def test_null_breaks_a_rule(spark):
    found = {(r["column"], r["check"]) for r in ct.violation_report(table(spark, {"gender": None}), TRAINING_CONTRACT).collect()}
    assert found == {("gender", "domain")}


def test_request_contract_sets_rows_aside(spark):
    names = {v: k for k, v in REQUEST_TO_TRAINING_NAMES.items()}
    rows = table(spark, {}, {"tenure": 80, "MonthlyCharges": 2000.0}).withColumnRenamed("id", "customerID")
    rows = rows.withColumn("TotalCharges", F.col("TotalCharges").cast("double")).withColumnsRenamed(names)
    good, bad = ct.quarantine(rows, REQUEST_CONTRACT.rules)
    assert good.count() == 1 and sorted(bad.first()["failed_rules"]) == ["monthly_charges:range", "tenure:range"]


def test_schema_walk_finds_nested_identifiers():
    schema = T.StructType.fromDDL("a struct<Customer_Id: int>, b array<struct<x: int, my_token: string>>, c map<string, int>")
    assert ct.forbidden_columns(schema) == ["a.Customer_Id", "b.my_token"]


def test_feature_known_answers(spark):
    df = table(spark, {"TotalCharges": ""}).select("tenure", "MonthlyCharges", "TotalCharges", "PaymentMethod", "OnlineSecurity", "OnlineBackup", "DeviceProtection")
    row = fe.derive(df, FEATURE_RECIPE).first()
    assert row["tc_residual"] == 0.0 and row["monthly_to_total_ratio"] == pytest.approx(0.5, abs=1e-6)
    assert (row["tenure_group"], row["is_auto_payment"], row["service_count"], row["has_any_addon"]) == ("G1_0_2", 1, 2, 1)


def test_ordered_feature_signature(spark):
    changes = [
        {"id": str(i), "Contract": c, "InternetService": n, "PaymentMethod": p, "tenure": t}
        for i, (c, n, p, t) in enumerate([
            ("Month-to-month", "DSL", "Electronic check", 1), ("One year", "Fiber optic", "Mailed check", 10),
            ("Two year", "No", "Bank transfer (automatic)", 30), ("Two year", "No", "Credit card (automatic)", 60)])]
    df = table(spark, *changes).drop("Churn")
    out = fe.fit_features(df, FEATURE_RECIPE).transform(df)
    assert out.columns == [
        "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
        "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "PaperlessBilling", "MonthlyCharges", "tc_residual",
        "monthly_to_total_ratio", "is_auto_payment", "service_count", "has_any_addon", "Contract_One year", "Contract_Two year",
        "InternetService_Fiber optic", "InternetService_No", "PaymentMethod_Credit card (automatic)", "PaymentMethod_Electronic check",
        "PaymentMethod_Mailed check", "tenure_group_G2_2_18", "tenure_group_G3_18_44", "tenure_group_G4_44_72"]
    assert out.agg(F.sum("MonthlyCharges")).first()[0] == 0  # constant column: scale 1


def test_unknown_category_is_all_zeros(spark):
    row = spark.createDataFrame([("z",)], "c string").select(*[c.alias(n) for n, c in fe.one_hot("c", ["a", "b", "d"]).items()]).first()
    assert row.asDict() == {"c_b": 0.0, "c_d": 0.0}


@pytest.mark.parametrize("text,number", [
    ("1.5", 1.5), (" 2 ", 2.0), ("-3e2", -300.0), ("inf", float("inf")), ("1.5d", None), ("NaN", None), ("", None), ("abc", None), (".5", 0.5), ("5.", 5.0)])
def test_numbers_from_text(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(number_from_text(F.col("t"))).first()[0] == number


@pytest.mark.parametrize("secret", [b"k", b"s" * 64, b"longer than one block " * 5])
def test_pseudonym_equals_hmac(spark, secret):
    got = spark.createDataFrame([("ü-1",)], "r string").select(keyed_pseudonym(F.col("r"), secret)).first()[0]
    assert got == hmac.new(secret, "ü-1".encode(), hashlib.sha256).hexdigest()


def test_ladders_ignore_nan_and_bands_are_inclusive(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.1,), (0.3,)], "x double")
    assert [r[0] for r in df.select(ladder(F.col("x"), (0.1, 0.2, 0.3))).collect()] == ["stable", "stable", "watch", "critical"]
    bands = spark.createDataFrame([(0.1,), (0.2,), (0.55,), (0.7,)], "p double").select(risk_band(F.col("p"), 0.2, 0.55, 0.7)).collect()
    assert [b[0] for b in bands] == ["SAFE", "LOW", "MEDIUM", "HIGH"]
    row = spark.createDataFrame([("insufficient_data", "stable", "watch", "unknown")], "a string, b string, c string, d string").select(
        worst_of(F.col("a"), F.col("b")), worst_of(F.col("c"), F.col("d"))).first()
    assert tuple(row) == ("stable", "unknown")


def test_trace_id(spark):
    good = "00-" + "A" * 32 + "-" + "b" * 16 + "-01"
    rows = spark.createDataFrame([(good,), (good + "x",), (None,)], "t string").select(trace_id(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["a" * 32, None, None]


def test_split_is_reproducible_and_exact(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    a = stratified_split(df, key=["id"], stratum=["y"], seed=7)
    counts = {(r["y"], r["split"]): r["n"] for r in a.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {(1, "train"): 175, (1, "validation"): 38, (1, "test"): 37, (0, "train"): 525, (0, "validation"): 113, (0, "test"): 112}
    b = stratified_split(df.repartition(13), key=["id"], stratum=["y"], seed=7)
    assert a.exceptAll(b).count() == 0
    c = stratified_split(df, key=["id"], stratum=["y"], seed=8)
    assert a.exceptAll(c).count() > 0
