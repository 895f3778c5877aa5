"""Distributed order statistics against NumPy, with hot values, few rows and many groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwatch.plans.ordering import assign_parts, quantiles, split_points

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.77, 0.95, 1.0]


def frame(spark, columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.mark.parametrize("case", ["even", "hot", "constant", "two", "negative_zero"])
def test_quantiles_equal_numpy(spark, case):
    rng = np.random.default_rng(3)
    values = {
        "even": rng.normal(size=5000),
        "hot": np.where(rng.random(5000) < 0.4, 7.0, rng.normal(size=5000)),  # one value holds 40 %
        "constant": np.full(300, 2.5),
        "two": np.array([1.0, 2.0]),
        "negative_zero": np.array([-0.0, 0.0, 0.0, 1.0, -1.0]),
    }[case]
    got = quantiles(frame(spark, {"v": values}), {"v": F.col("v")}, PROBS, buckets=16).toPandas().set_index("prob")["value"]
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantiles_per_group_with_a_hot_group(spark):
    rng = np.random.default_rng(4)
    groups = np.where(rng.random(6000) < 0.5, "hot", rng.integers(0, 40, 6000).astype(str))
    df = pd.DataFrame({"g": groups, "v": rng.exponential(size=6000)})
    got = quantiles(spark.createDataFrame(df), {"v": F.col("v")}, [0.1, 0.5, 0.95], by=["g"], buckets=8).toPandas()
    want = df.groupby("g").v.quantile([0.1, 0.5, 0.95])
    assert len(got) == len(want)
    for row in got.itertuples():
        assert row.value == pytest.approx(want[(row.g, row.prob)], abs=1e-12)


def test_nulls_and_nan_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert quantiles(df, {"v": F.col("v")}, [0.5]).first()["value"] == 2.0


def test_a_frequent_value_gets_its_own_bucket(spark):
    df = frame(spark, {"v": np.where(np.arange(1000) % 3 == 0, 5.0, np.arange(1000) / 10)})
    splits = split_points(df, {"v": F.col("v")}, 16)["v"]
    assert splits.points[splits.heavy[0] - 1] == 5.0


@pytest.mark.parametrize("partitions", [1, 5])
def test_parts_are_exact_and_independent_of_partitioning(spark, partitions):
    base = spark.range(10_007).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")))
    cuts = F.array((F.col("size") * 0.25).cast("long"), (F.col("size") * 0.5).cast("long"))
    parts = assign_parts(base.repartition(partitions), key=["id"], seed=1, cuts=cuts, by=["g"])
    sizes = parts.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("part") == i).alias(f"p{i}") for i in range(3)]).collect()
    for row in sizes:
        a, b = int(row["n"] * 0.25), int(row["n"] * 0.5)
        assert (row["p0"], row["p1"], row["p2"]) == (a, b - a, row["n"] - b)
    digest = parts.agg(F.sum(F.xxhash64("id", "part").cast("decimal(38,0)"))).first()[0]
    again = assign_parts(base, key=["id"], seed=1, cuts=cuts, by=["g"]).agg(F.sum(F.xxhash64("id", "part").cast("decimal(38,0)"))).first()[0]
    assert digest == again


def test_a_cap_above_the_size_keeps_all(spark):
    parts = assign_parts(spark.range(50), key=["id"], seed=1, cuts=F.array(F.lit(100).cast("long")))
    assert parts.where("part = 0").count() == 50
