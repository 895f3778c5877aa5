"""Joins that no frequent key can pile up in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.llm.exprs import partitions


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """rows with the columns of `table`, which has one row per key; null where it has none.

    Rows get one of as many salts as there are shuffle partitions, from `by`. Only the distinct (key, salt) meet the table
    by key, and rows meet the result by key and salt: a key that a third of all rows share is dealt over all tasks.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(partitions(rows.sparkSession))).cast("int"))
    wanted = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(wanted, [*keys, "_salt"], "left").drop("_salt")
