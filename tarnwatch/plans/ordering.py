"""Order statistics without ever sorting a whole group in one task.

Rows are cut into buckets that respect the sort order: by literal split points
for numbers, by hash prefix for hashed keys. Bucket totals are tiny and give the
rank at which every bucket starts. After that only the buckets that hold a
wanted rank are looked at row by row, each one in its own task.

Split points need not be accurate: they decide how even the buckets are, never
the result. They are literals, so every branch and every retried task puts a
value in the same bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwatch.plans.freeze import freeze
from tarnwatch.plans.longform import melt

MIN_BUCKETS = 128
SALTS = 256


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    """Buckets grow with the shuffle width the cluster is set to, so that each stays one task's work."""
    if buckets:
        return buckets
    return max(MIN_BUCKETS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hash_digits(df: DataFrame) -> int:
    """Hex digits of a hash prefix: 16 ** digits even buckets per group, at least two for every bucket asked for."""
    return max(3, math.ceil(math.log(2 * bucket_count(df), 16)))


def wrapped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group columns as structs: a null group then equals itself in joins."""
    return df.withColumns({c: F.struct(F.col(f"`{c}`").alias("v")) for c in by}) if by else df


def unwrapped(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`")["v"] for c in by}) if by else df


def clean_number(column: Column) -> Column:
    """NaN to null and -0.0 to 0.0, so that equal values are equal everywhere."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


@dataclass(frozen=True)
class Splits:
    points: tuple[float, ...]
    heavy: tuple[int, ...]  # buckets that hold one single, frequent value

    def bucketizer_splits(self) -> list[float]:
        inner = list(self.points) or [0.0]
        return [-math.inf, *inner, math.inf]


def split_points(df: DataFrame, columns: Mapping[str, Column], buckets: int | None = None) -> dict[str, Splits]:
    """Approximate quantiles of every column, merged in two steps.

    Sketches of all tasks in one reducer would be its bottleneck on many
    partitions, so groups of tasks are merged first and the quantiles of those
    groups are pooled. The driver receives at most `buckets` numbers per column.
    """
    buckets = bucket_count(df, buckets)
    probabilities = [i / buckets for i in range(1, buckets)]
    accuracy = F.lit(max(1000, 10 * buckets))
    salted = df.select(
        *[clean_number(column).alias(name) for name, column in columns.items()],
        (F.spark_partition_id() % SALTS).alias("__salt"))
    names = [f"`{name}`" for name in columns]
    grouped = salted.groupBy("__salt").agg(*[
        F.coalesce(F.percentile_approx(F.col(q), probabilities, accuracy), F.expr(f"array_repeat(CAST(NULL AS double), {buckets - 1})"))
        .alias(n) for n, q in zip(columns, names)])
    pooled = grouped.select(F.inline(F.arrays_zip(*names)))
    row = pooled.agg(*[F.percentile_approx(F.col(q), probabilities, accuracy).alias(n) for n, q in zip(columns, names)]).first()
    return {name: _splits(row[name] or []) for name in columns}


def _splits(quantiles: Sequence[float]) -> Splits:
    # A value met at two quantiles holds a whole bucket's worth of rows: give it
    # a bucket of its own, [v, next double after v).
    quantiles = [q for q in quantiles if math.isfinite(q)]
    repeated = {a for a, b in zip(quantiles, quantiles[1:]) if a == b}
    points = sorted(set(quantiles) | {math.nextafter(v, math.inf) for v in repeated})
    index = {v: i for i, v in enumerate(points)}
    return Splits(tuple(points), tuple(sorted(index[v] + 1 for v in repeated)))


def with_buckets(df: DataFrame, columns: Mapping[str, str], splits: Mapping[str, Splits]) -> DataFrame:
    """Add `columns[input]` = bucket number of every cleaned input column."""
    names = list(columns)
    return Bucketizer(
        inputCols=names,
        outputCols=[columns[n] for n in names],
        splitsArray=[splits[n].bucketizer_splits() for n in names],
        handleInvalid="keep",
    ).transform(df)


def start_ranks(totals: DataFrame, by: Sequence[str], bucket: Sequence[str], weight: str = "n") -> DataFrame:
    """Add `below` (rank of the bucket's first row) and `size` (rows of the group).

    The window runs over bucket totals, at most a few thousand per group.
    """
    ordered = Window.partitionBy(*by).orderBy(*bucket)
    return (
        totals
        .withColumn("below", F.coalesce(F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("size", F.sum(weight).over(Window.partitionBy(*by)))
    )


def rows_at_ranks(
    items: DataFrame, *, by: Sequence[str], bucket: Sequence[str], order: Sequence[str],
    ranks: Column, weight: Column | None = None,
) -> DataFrame:
    """The rows found at given ranks of every group: (by..., target, size, order...).

    `bucket` must rise with `order`. `ranks` is an array of 0-based ranks in
    terms of the column `size`; `target` is the position in that array. Ranks
    past the end give no row.
    """
    weight = F.lit(1) if weight is None else weight
    totals = items.groupBy(*by, *bucket).agg(F.sum(weight).alias("n"))
    targets = (
        start_ranks(totals, by, bucket)
        .select(*by, *bucket, "n", "below", "size", F.posexplode(ranks).alias("target", "rank"))
        .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        .groupBy(*by, *bucket, "size")
        .agg(F.collect_list(F.struct("target", (F.col("rank") - F.col("below")).alias("at"))).alias("targets"))
    )
    keys = [*by, *bucket]
    targets = freeze(targets, "rank-targets")
    # Semi join and hash aggregate first; the target lists meet the few rows that are left.
    wanted = items.join(targets.select(*keys), keys, "left_semi")
    counted = wanted.groupBy(*keys, *order).agg(F.sum(weight).alias("n"))
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counted
        .withColumn("upto", F.sum("n").over(running))
        .join(targets, keys)
        .select(*by, "size", *order, F.inline(F.filter(
            "targets", lambda t: (t["at"] >= F.col("upto") - F.col("n")) & (t["at"] < F.col("upto")))))
        .drop("at")
    )


def quantiles(
    df: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float], *,
    by: Sequence[str] = (), buckets: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles: (by..., feature, prob, value)."""
    clean = {name: clean_number(column) for name, column in columns.items()}
    base = wrapped(df.select(*by, *[column.alias(name) for name, column in clean.items()]), by)
    splits = split_points(base, {name: F.col(f"`{name}`") for name in clean}, buckets)
    bucketed = with_buckets(base, {name: f"{name}__bucket" for name in clean}, splits)
    cells = {
        name: F.struct(F.col(f"`{name}__bucket`").cast("int").alias("bucket"), F.col(f"`{name}`").alias("value"))
        for name in clean
    }
    items = melt(bucketed, by, cells).where(F.col("value").isNotNull())
    last = F.col("size") - 1
    ranks = F.array(*[
        rank.cast("long") for p in probabilities
        for rank in (F.floor(last * F.lit(float(p))), F.ceil(last * F.lit(float(p))))
    ])
    found = rows_at_ranks(items, by=[*by, "feature"], bucket=["bucket"], order=["value"], ranks=ranks)
    probability = F.element_at(F.lit([float(p) for p in probabilities]), (F.col("target") / 2).cast("int") + 1)
    position = last * F.col("prob")
    share = F.first(position - F.floor(position))
    low = F.max(F.when(F.col("target") % 2 == 0, F.col("value")))
    high = F.max(F.when(F.col("target") % 2 == 1, F.col("value")))
    return unwrapped(
        found.withColumn("prob", probability)
        .groupBy(*by, "feature", "prob")
        .agg((low + (high - low) * share).alias("value")), by)


# --- hashed order: seeded sampling and splitting ----------------------------

def hashed_key(key: Sequence[str | Column], seed: int) -> Column:
    """Order rows as if shuffled, the same way on every run and partitioning."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def assign_parts(
    df: DataFrame, *, key: Sequence[str], seed: int, cuts: Column, by: Sequence[str] = (), out: str = "part",
) -> DataFrame:
    """Number rows by hashed order and cut every group at the ranks in `cuts`.

    `cuts` is an array of 0-based ranks in terms of `size`; part i starts at
    cuts[i-1]. Group sizes are exact as long as `key` is unique in its group.
    The rows themselves are never shuffled: they are compared with a few cut keys.
    """
    group = [*by] or ["__all"]
    base = wrapped(df, by) if by else df.withColumn("__all", F.lit(0))
    items = base.select(*group, hashed_key(key, seed).alias("__hash")).withColumn(
        "__prefix", F.substring("__hash", 1, hash_digits(df)))
    cut = rows_at_ranks(items, by=group, bucket=["__prefix"], order=["__hash"], ranks=cuts)
    borders = freeze(cut.groupBy(*group).agg(F.sort_array(F.collect_list("__hash")).alias("__borders")), "cut-keys")
    tagged = base.withColumn("__hash", hashed_key(key, seed)).join(borders, group, "left")
    # Few borders per group: a linear scan over them is cheaper than a join.
    part = F.coalesce(F.size(F.filter("__borders", lambda b: b <= F.col("__hash"))), F.lit(0))
    return unwrapped(tagged.withColumn(out, part).drop("__hash", "__borders", "__all"), by)
