"""File scans and sinks: CSV, JSON lines, JSON documents, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

PREDICTION_SCHEMA = (
    "prediction_id string, entity_key string, key_id string, prediction_at timestamp, probability double, "
    "decision_threshold double, model_version string, model_bundle_sha256 string, schema_version string, "
    "threshold_version string, risk_policy_version string"
)
LABEL_SCHEMA = (
    "prediction_id string, entity_key string, key_id string, churned_within_horizon boolean, outcome_at timestamp, "
    "received_at timestamp, label_revision int, label_definition_version string"
)
EVIDENCE_SCHEMA = (
    "source_result_id string, domain string, source_status string, signal string, window_id string, "
    "window_end timestamp, sample_size long, label_coverage double, model_version string, baseline_id string, "
    "config_version string, data_origin string"
)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, blank_columns: Sequence[str] = ()) -> DataFrame:
    """CSV with a header. Where a blank has a meaning of its own it stays '' instead of null."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in blank_columns}) if blank_columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """ISO-8601 timestamps with Z or an offset; what does not parse becomes null and fails the contract."""
    return spark.read.schema(schema).json(path)


def read_records_document(
    spark: SparkSession, path: str, record_schema: str, required: Sequence[str], one_per_file: bool = True,
) -> DataFrame:
    """{"records": [...]} documents, one per file or one per line, to rows that have all required fields."""
    schema = f"records array<struct<{_as_struct(record_schema)}>>"
    df = spark.read.schema(schema).option("multiLine", one_per_file).json(path)
    rows = df.select(F.inline("records"))
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    return rows


def _as_struct(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def instant_schema(schema: T.StructType) -> T.StructType:
    """Timestamps without a zone are UTC instants, here and in every policy."""
    return T.StructType([
        T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable)
        for f in schema.fields])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan with zone-less timestamps read as instants, no cast in the way of pushdown."""
    return spark.read.schema(instant_schema(spark.read.parquet(path).schema)).parquet(path)


# --- folders -----------------------------------------------------------------

def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _hadoop_path(spark, path)
    return fs.exists(jpath)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Did a Spark job finish writing this folder?"""
    return folder_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def delete_folder(spark: SparkSession, path: str) -> None:
    jpath, fs = _hadoop_path(spark, path)
    fs.delete(jpath, True)
