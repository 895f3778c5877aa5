"""The public snapshot: allow-listed, suppressed where groups are small, bounded, versioned."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tarnwatch.config import DATA_ORIGINS, STATUSES, ExportPolicy, PolicyError
from tarnwatch.operators.contract import Rule, allowed_only, one_of, quarantine
from tarnwatch.sources.files import folder_exists

SNAPSHOT_VERSION = "public_metrics/v1"
# --- fixed values: failure classes and published resources ---
FAILURES = ("export_failed", "sanitisation_failed", "schema_invalid")
RESOURCES = {
    "overview": "$.overview",
    "models/current": "$.models.current",
    "models/history": "$.models.history",
    "monitoring/history": "$.monitoring.history",
    "service/history": "$.service.history",
    "methodology": "$.methodology",
}
# --------------------------------------------------------------


def source_rules(policy: ExportPolicy) -> tuple[Rule, ...]:
    return (
        *[Rule(c, "present", f"`{c}` IS NOT NULL") for c in (
            "result_id", "window_start", "window_end", "sample_size", "model_version", "summary")],
        one_of("result_type", list(policy.allowed_metrics)), one_of("status", STATUSES), one_of("data_origin", DATA_ORIGINS),
    )


def split_sources(records: DataFrame, policy: ExportPolicy = ExportPolicy()) -> tuple[DataFrame, DataFrame]:
    return quarantine(records, source_rules(policy))


def public_rows(records: DataFrame, policy: ExportPolicy = ExportPolicy()) -> DataFrame:
    """One sanitised row per record; small groups keep origin, type and reason only."""
    small = F.col("sample_size") < policy.minimum_group_size

    def shown(column: Column) -> Column:
        return F.when(~small, column)

    metrics = allowed_only(F.col("summary"), F.col("result_type"), policy.allowed_metrics)
    sections = F.create_map(*[F.lit(x) for kv in policy.sections.items() for x in kv])
    return records.select(
        "result_id", "window_end", F.element_at(sections, F.col("result_type")).alias("section"), "result_type",
        "data_origin", F.when(small, "suppressed").otherwise(F.col("status")).alias("evidence_state"),
        F.when(small, "minimum_group_size").alias("suppression_reason"),
        shown(F.col("window_start")).alias("observed_start"), shown(F.col("window_end")).alias("observed_end"),
        shown(F.col("sample_size")).alias("shown_sample_size"), shown(F.col("label_coverage")).alias("shown_coverage"),
        shown(metrics).alias("metrics"))


def newest_per_section(rows: DataFrame, policy: ExportPolicy = ExportPolicy()) -> DataFrame:
    """A report feature: the newest rows per section. Spark cuts each task to that many before the shuffle."""
    order = Window.partitionBy("section").orderBy(F.col("window_end").desc(), F.col("result_id").asc())
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= policy.rows_per_category)


def model_history(records: DataFrame) -> DataFrame:
    """Each model once, as its newest result shows it."""
    order = F.struct((-F.unix_micros("window_end")).alias("m"), "result_id", "data_origin", "window_end")
    return records.groupBy("model_version").agg(F.min(order).alias("t")).select(
        "model_version", "t.data_origin", F.col("t.window_end").alias("latest_observed_window_end"), "t.result_id")


def _iso(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot(records: DataFrame, generated_at: str, policy: ExportPolicy = ExportPolicy()) -> DataFrame:
    """(snapshot_id, generated_at, payload): the whole public document in one row.

    Sections hold at most `rows_per_category` entries and there is one entry per
    model version, so the document stays small however large the store is.
    """
    good, _ = split_sources(records.where(F.col("result_type") != "public_snapshot"), policy)
    entry = F.to_json(F.struct(
        "result_type", "evidence_state", "data_origin", "suppression_reason",
        F.when(F.col("observed_start").isNotNull(), F.struct(
            _iso(F.col("observed_start")).alias("start"), _iso(F.col("observed_end")).alias("end"))).alias("observed_window"),
        F.col("shown_sample_size").alias("sample_size"), F.col("shown_coverage").alias("label_coverage"), "metrics"))
    top = newest_per_section(public_rows(good, policy), policy).withColumn("entry", entry)
    sections = top.groupBy("section").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "entry"))), lambda e: e["entry"]).alias("entries"))
    by_section = sections.agg(F.map_from_entries(F.collect_list(F.struct("section", "entries"))).alias("sections"))
    order = F.struct((-F.unix_micros("window_end")).alias("m"), "result_id", "status", "model_version", "data_origin", "window_end")
    head = good.agg(F.min(order).alias("t"), F.array_sort(F.collect_set("data_origin")).alias("origins"))
    history = model_history(good).agg(F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros("latest_observed_window_end")).alias("m"), "result_id", "model_version", "data_origin",
        "latest_observed_window_end"))).alias("models"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    joined = one(head).join(one(by_section), "__one").join(one(history), "__one")

    def section(name: str) -> Column:
        listed = F.coalesce(F.try_element_at(F.col("sections"), F.lit(name)), F.array().cast("array<string>"))
        return F.concat(F.lit('{"history":['), F.array_join(listed, ","), F.lit("]}"))

    latest = F.col("t")
    overview = F.to_json(F.struct(
        F.coalesce(latest["status"], F.lit("not_available")).alias("evidence_state"), F.col("origins").alias("data_origins"),
        _iso(latest["window_end"]).alias("latest_observed_window_end"), F.lit(policy.candidate_mode).alias("candidate_mode")))
    current = F.coalesce(F.to_json(F.when(latest.isNotNull(), F.struct(
        latest["model_version"].alias("model_version"), latest["data_origin"].alias("data_origin"),
        _iso(latest["window_end"]).alias("observed_window_end")))), F.lit("null"))
    models = F.to_json(F.transform("models", lambda m: F.struct(
        m["model_version"].alias("model_version"), m["data_origin"].alias("data_origin"),
        _iso(m["latest_observed_window_end"]).alias("latest_observed_window_end"))))
    methodology = F.to_json(F.struct(
        F.lit(policy.candidate_mode).alias("candidate_mode"), F.lit(policy.minimum_group_size).alias("minimum_group_size"),
        F.lit(True).alias("data_origin_required")))
    body = F.concat(
        F.lit(f'"schema_version":"{SNAPSHOT_VERSION}","generated_at":"{generated_at}",'),
        F.lit(f'"freshness":{{"state":"fresh","target_seconds":{policy.freshness_target_seconds}}},"overview":'), overview,
        F.lit(',"models":{"current":'), current, F.lit(',"history":'), models, F.lit("}"),
        *[x for name in policy.sections.values() for x in (F.lit(f',"{name}":'), section(name))],
        F.lit(',"methodology":'), methodology)
    return joined.select(
        F.concat(F.lit("public-"), F.substring(F.sha2(body, 256), 1, 20)).alias("snapshot_id"),
        F.lit(generated_at).alias("generated_at"), F.concat(F.lit("{"), body, F.lit("}")).alias("payload"))


def resource(snapshots: DataFrame, name: str) -> DataFrame:
    """One published resource of a snapshot row."""
    return snapshots.select("snapshot_id", "generated_at", F.get_json_object("payload", RESOURCES[name]).alias("data"))


def current_snapshot(published: DataFrame, failures: DataFrame) -> DataFrame:
    """Newest snapshot; stale, with the reason, if an export failed after it."""
    top = published.agg(F.max_by(F.struct("snapshot_id", "generated_at", "payload"), F.struct("generated_at", "snapshot_id")).alias("s"))
    failed = failures.agg(F.max(F.struct("failed_at", "reason")).alias("f"))
    both = top.where(F.col("s").isNotNull()).withColumn("__one", F.lit(1)).join(failed.withColumn("__one", F.lit(1)), "__one")
    after = F.coalesce(F.col("f.failed_at") >= F.col("s.generated_at"), F.lit(False))
    return both.select(
        "s.snapshot_id", "s.generated_at", "s.payload", F.when(after, "stale").otherwise("fresh").alias("freshness"),
        F.when(after, F.col("f.reason")).alias("reason"), F.when(after, F.col("f.failed_at")).alias("last_failure_at"))


@dataclass(frozen=True)
class SnapshotLog:
    """Published snapshots and failed exports, both append-only."""

    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        home = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(home) if folder_exists(self.spark, home) else self.spark.createDataFrame([], schema)

    def published(self) -> DataFrame:
        return self._read("snapshots", "snapshot_id string, generated_at string, payload string")

    def failures(self) -> DataFrame:
        return self._read("failures", "failed_at string, reason string, error string")

    def export(self, records: DataFrame, now: str, policy: ExportPolicy = ExportPolicy()) -> DataFrame:
        """Publish, or keep the last snapshot and note the failure. `now` is ISO-8601 UTC."""
        try:
            _, bad = split_sources(records.where(F.col("result_type") != "public_snapshot"), policy)
            if bad.limit(1).count():
                raise PolicyError("source rows break the export contract")
            self.publish(snapshot(records, now, policy))
        except (PolicyError, PySparkException, Py4JError) as error:  # the last good snapshot stays up, the failure says what broke
            self.record_failure(now, "export_failed", type(error).__name__)
        return self.current()

    def publish(self, row: DataFrame) -> bool:
        """True if this very snapshot was published before; other content under its id is an error."""
        new = row.first()
        old = self.published().where(F.col("snapshot_id") == new["snapshot_id"]).first()
        if old is not None:
            if old["payload"] != new["payload"]:
                raise PolicyError("snapshot id was published with other content")
            return True
        self.spark.createDataFrame([new], "snapshot_id string, generated_at string, payload string").coalesce(1).write.mode(
            "append").parquet(f"{self.path}/snapshots")
        return False

    def record_failure(self, now: str, reason: str, error: str | None = None) -> None:
        if reason not in FAILURES:
            raise PolicyError("failure reason is unsupported")
        if self.published().limit(1).count() == 0:
            raise PolicyError("no prior snapshot is available")
        self.spark.createDataFrame([(now, reason, error)], "failed_at string, reason string, error string").coalesce(1).write.mode("append").parquet(
            f"{self.path}/failures")

    def current(self) -> DataFrame:
        return current_snapshot(self.published(), self.failures())
