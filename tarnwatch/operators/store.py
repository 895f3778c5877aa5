"""The aggregate results table: append once, read newest, retire old."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnwatch.config import DATA_ORIGINS, RESULT_TYPES, STATUSES, StorePolicy
from tarnwatch.functions.expressions import HOUR_MICROS
from tarnwatch.operators.contract import (
    Rule,
    between,
    leaks_identifier,
    map_leaks_identifier,
    not_empty,
    one_of,
)
from tarnwatch.plans.freeze import freeze
from tarnwatch.sources.files import delete_folder
from tarnwatch.sources.publish import children, publish, published

RECORD_SCHEMA = (
    "result_id string, result_type string, status string, data_origin string, window_start timestamp, "
    "window_end timestamp, computed_at timestamp, sample_size long, label_coverage double, method_version string, "
    "config_version string, model_version string, baseline_id string, deployment_id string, "
    "summary map<string,double>, distribution string"
)
RECORD_COLUMNS = tuple(part.split()[0] for part in RECORD_SCHEMA.split(", "))
# The key leaves out how large and when: a recomputation of the same result is the same result.
KEY_COLUMNS = tuple(
    c for c in RECORD_COLUMNS if c not in ("sample_size", "label_coverage", "computed_at", "summary"))

RECORD_RULES: tuple[Rule, ...] = (
    *[not_empty(c) for c in ("result_id", "method_version", "config_version", "model_version")],
    one_of("result_type", RESULT_TYPES), one_of("status", STATUSES), one_of("data_origin", DATA_ORIGINS),
    Rule("window", "order", "window_start < window_end AND computed_at >= window_end"),
    between("sample_size", 0),
    Rule("label_coverage", "range", "label_coverage IS NULL OR label_coverage BETWEEN 0 AND 1"),
)


def record_problems() -> Column:
    """Names of everything that keeps a record out of the store."""
    marks = [F.when(~r.holds(), F.lit(r.name)) for r in RECORD_RULES]
    marks.append(F.when(map_leaks_identifier(F.col("summary")), F.lit("summary:privacy")))
    marks.append(F.when(leaks_identifier(F.coalesce("distribution", F.lit("{}"))), F.lit("distribution:privacy")))
    return F.filter(F.array(*marks), lambda m: m.isNotNull())


def idempotency_key() -> Column:
    entries = F.array_sort(F.map_entries("summary")).alias("summary")
    return F.sha2(F.to_json(F.struct(*KEY_COLUMNS, entries), {"ignoreNullFields": "false"}), 256)


def ingest_plan(records: DataFrame, existing: DataFrame) -> DataFrame:
    """(records..., idempotency_key, outcome): ingested, reused, conflict or invalid.

    The first record of an id (by computed_at, then key) stands; equal content
    later on is a reuse, other content a conflict. Within a batch this is decided
    by minima per id, so an id repeated any number of times stays one small row.
    """
    keyed = records.withColumn("problems", record_problems()).withColumn("idempotency_key", idempotency_key())
    valid = F.size("problems") == 0
    order = F.struct("computed_at", "idempotency_key")
    per_id = keyed.where(valid).groupBy("result_id").agg(F.min(order)["idempotency_key"].alias("first_key"))
    stored = existing.select("result_id", F.col("idempotency_key").alias("stored_key"))
    per_id = per_id.join(stored, "result_id", "left")
    # Valid and invalid copies of one key are apart: a spoiled copy must not take a good one with it.
    unique = keyed.withColumn("valid", valid).groupBy(*[c for c in KEY_COLUMNS], "idempotency_key", "valid").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(
            "computed_at", "sample_size", "label_coverage",
            F.array_sort(F.map_entries("summary")).alias("summary"), "problems")).alias("r"))
    rows = unique.select(
        *KEY_COLUMNS, "idempotency_key", "copies", "r.computed_at", "r.sample_size", "r.label_coverage",
        F.map_from_entries("r.summary").alias("summary"), "r.problems")
    outcome = (
        F.when(F.size("problems") > 0, "invalid")
        .when(F.col("stored_key") == F.col("idempotency_key"), "reused")
        .when(F.col("stored_key").isNotNull() | (F.col("first_key") != F.col("idempotency_key")), "conflict")
        .otherwise("ingested"))
    return rows.join(per_id, "result_id", "left").select(
        *RECORD_COLUMNS, "idempotency_key", "copies", outcome.alias("outcome"))


# What a row of a dimension says besides its first time: a deployment serves the model it first appeared with.
DIMENSIONS = {"model_version": (), "deployment_id": ("model_version",)}


def first_seen(records: DataFrame, column: str) -> DataFrame:
    """A dimension: each value with the time it first appeared, and what it then came with."""
    at = F.struct("computed_at", "result_id")
    return records.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.min("computed_at").alias("created_at"), *[F.min_by(c, at).alias(c) for c in DIMENSIONS[column]])


def newest(records: DataFrame, limit: int) -> DataFrame:
    return records.orderBy(F.col("window_end").desc(), F.col("result_id").asc()).limit(limit)


def freshness(window_end: Column, now: Column, policy: StorePolicy) -> Column:
    age = F.unix_micros(now) - F.unix_micros(window_end)
    interval = policy.expected_interval_hours * HOUR_MICROS
    return F.when(age <= interval, "fresh").when(age <= 2 * interval, "late").when(age.isNotNull(), "stale").otherwise("not_available")


def latest_state(records: DataFrame, now: Column, policy: StorePolicy = StorePolicy()) -> DataFrame:
    """One row, also for an empty store: state, freshness, window_end, age_seconds."""
    order = F.struct((-F.unix_micros("window_end")).alias("m"), "result_id", "status", "window_end")
    top = records.agg(F.min(order).alias("t"))
    age = F.floor((F.unix_micros(now) - F.unix_micros(F.col("t.window_end"))) / 1_000_000)
    return top.select(
        F.coalesce("t.status", F.lit("not_available")).alias("state"),
        freshness(F.col("t.window_end"), now, policy).alias("freshness"),
        F.col("t.window_end").alias("window_end"), age.alias("age_seconds"))


def retention_border(now: Column, policy: StorePolicy) -> Column:
    return now - F.expr(f"INTERVAL {policy.retention_days} DAY")


def retained(records: DataFrame, now: Column, policy: StorePolicy = StorePolicy()) -> DataFrame:
    return records.where(F.col("window_end") >= retention_border(now, policy))


def expired(records: DataFrame, now: Column, policy: StorePolicy = StorePolicy()) -> DataFrame:
    """The border is a constant, so the filter reaches the scan; of a stored table, later months aren't read at all."""
    border = retention_border(now, policy)
    old = records.where(F.col("window_end") < border)
    return old.where(F.col("window_month") <= F.date_format(border, "yyyy-MM")) if "window_month" in records.columns else old


def exportable(records: DataFrame) -> DataFrame:
    return records.where(F.col("result_type") != "public_snapshot").orderBy(F.col("window_end").desc(), F.col("result_id").asc())


@dataclass(frozen=True)
class Commit:
    """What one step made visible: a batch of results with its dimensions, or that results older than a time are gone."""

    number: int
    batch: str | None = None
    expire_before: str | None = None


@dataclass(frozen=True)
class MetricsTable:
    """Results by type and month of the window's end, in batches that become visible one by one.

    A batch (its results and what it adds to the dimensions) is written to folders of its own that nobody reads. It becomes
    visible by one marker, `commits/<number>`, which only one writer can create: who comes second finds the number taken, and
    plans again over what is there by then. So two writers of one record leave it once, and a writer that dies before the
    marker has changed nothing. Retention is such a marker too: readers leave out the expired rows of all earlier batches from
    then on; `sweep` deletes their files, and batches never published, when readers of before are done.
    """

    spark: SparkSession
    path: str

    def commits(self) -> list[Commit]:
        return [Commit(int(name), **json.loads(text)) for name, text in published(self.spark, f"{self.path}/commits")]

    def _publish(self, commits: list[Commit], **step: str) -> bool:
        number = commits[-1].number + 1 if commits else 0
        return publish(self.spark, f"{self.path}/commits/{number:012d}", json.dumps(step))

    @property
    def parts(self) -> list[str]:
        return [*(f"{column}s" for column in DIMENSIONS), "results"]

    def _batch_folder(self, batch: str, part: str) -> str:
        return f"{self.path}/{part}/batch={batch}"

    def read(self, commits: list[Commit] | None = None) -> DataFrame:
        """All results that are visible, or were after the given commits."""
        commits = self.commits() if commits is None else commits
        by_border: dict[str, list[str]] = {}
        border = ""
        for commit in reversed(commits):
            border = max(border, commit.expire_before or "")
            if commit.batch:
                by_border.setdefault(border, []).append(self._batch_folder(commit.batch, "results"))
        schema = f"{RECORD_SCHEMA}, idempotency_key string, window_month string"
        parts = []
        for since, folders in by_border.items():
            # Only folders of these batches are listed; the schema is known, so no file is opened to find it.
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/results").parquet(*folders).drop("batch")
            if since:
                rows = rows.where(F.col("window_end") >= F.lit(since).cast("timestamp")).where(F.col("window_month") >= since[:7])
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def ingest(self, records: DataFrame) -> DataFrame:
        """Add what is new, all of it or nothing; returns (result_id, idempotency_key, copies, outcome)."""
        records = freeze(records, "ingested_records")
        while True:
            commits = self.commits()
            plan = freeze(ingest_plan(records, self.read(commits)), "ingest")
            fresh = plan.where(F.col("outcome") == "ingested")
            found = plan.select("result_id", "idempotency_key", "copies", "outcome")
            if fresh.isEmpty():
                return found
            batch = uuid.uuid4().hex
            self._write_batch(batch, fresh, commits)
            if self._publish(commits, batch=batch):
                return found
            for part in self.parts:
                delete_folder(self.spark, self._batch_folder(batch, part))

    def _write_batch(self, batch: str, fresh: DataFrame, commits: list[Commit]) -> None:
        for column in DIMENSIONS:
            seen = first_seen(fresh, column).join(self.dimension(column, commits).select(column), column, "left_anti")
            seen.write.parquet(self._batch_folder(batch, f"{column}s"))
        out = fresh.drop("outcome", "copies").withColumn("window_month", F.date_format("window_end", "yyyy-MM"))
        # Rebalance, not repartition: one type and month may hold a third of all records.
        out.hint("rebalance", "result_type", "window_month").write.partitionBy("result_type", "window_month").parquet(
            self._batch_folder(batch, "results"))

    def dimension(self, column: str, commits: list[Commit] | None = None) -> DataFrame:
        """Values with the time they were first seen, also those whose results have expired."""
        folders = [self._batch_folder(c.batch, f"{column}s") for c in (self.commits() if commits is None else commits) if c.batch]
        schema = ", ".join([f"{column} string", "created_at timestamp", *(f"{c} string" for c in DIMENSIONS[column])])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{column}s").parquet(*folders).drop("batch")

    def count(self, result_type: str | None = None) -> int:
        rows = self.read()
        return (rows if result_type is None else rows.where(F.col("result_type") == result_type)).count()

    def apply_retention(self, now: str, policy: StorePolicy = StorePolicy()) -> int:
        """Make rows older than the policy allows invisible, in one step; how many these were. Dimensions stay."""
        at = F.lit(now).cast("timestamp")
        border = self.spark.range(1).select(F.date_format(retention_border(at, policy), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        while True:
            commits = self.commits()
            gone = expired(self.read(commits), at, policy).count()
            if not gone or self._publish(commits, expire_before=border):
                return gone

    def sweep(self, older_than_hours: float = 24.0) -> list[str]:
        """Delete the folders nobody can see that are at least so old: batches without a marker, and months that a marker of that
        age has expired. Returns what was deleted."""
        commits, limit = self.commits(), time.time() * 1000 - older_than_hours * HOUR_MICROS / 1000
        known, gone = {c.batch for c in commits}, []
        for part in self.parts:
            for name, changed in children(self.spark, f"{self.path}/{part}"):
                if name.partition("=")[2] not in known and changed <= limit:
                    gone.append(f"{part}/{name}")
        ages = {int(name): changed for name, changed in children(self.spark, f"{self.path}/commits") if not name.startswith(".")}
        border = ""
        for commit in reversed(commits):
            if commit.expire_before and ages.get(commit.number, limit + 1) <= limit:
                border = max(border, commit.expire_before)
            if not commit.batch or not border:
                continue
            results = self._batch_folder(commit.batch, "results")
            for kind, _ in children(self.spark, results):
                for month, _ in children(self.spark, f"{results}/{kind}") if "=" in kind else ():
                    if month.partition("=")[2] < border[:7]:
                        gone.append(f"results/batch={commit.batch}/{kind}/{month}")
        for folder in gone:
            delete_folder(self.spark, f"{self.path}/{folder}")
        return gone
