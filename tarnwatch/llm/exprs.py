"""Column expressions and small frames that several of these operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnwatch.plans.freeze import freeze

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Connected components of the edges (a long, b long): one row (node, component) per node of an edge, where
    component is the smallest node that can be reached.

    Alternates large and small stars: every round hangs the larger neighbours of a node, then the smaller ones, under
    the least node seen, until nothing changes. A round is two aggregations and joins on the node; the edges are cut
    from their lineage by a written table, so a lost executor repeats one round at most.
    Null ends and loops are left out; no edges give no rows.
    """
    now = freeze(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b").distinct(), label)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = large.where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = (down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        now = freeze(small, label)
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
