"""Dataset manifests: what a table held when it was accepted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwatch.config import PolicyError

MANIFEST_SCHEMA = (
    "schema_version string, source_name string, row_count long, column_count long, checksum string, code_revision string")


def content_checksum(df: DataFrame) -> DataFrame:
    """(row_count, column_count, checksum) in one pass, independent of row order and file layout.

    XOR and sum of row hashes: the sum also sees rows that occur twice.
    """
    names = sorted(df.columns)
    h = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("h"))
    return h.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(names)).cast("long").alias("column_count"),
        F.sha2(F.concat_ws(
            "|", F.lit(",".join(names)), F.count(F.lit(1)).cast("string"), F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string"),
            F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")), 256).alias("checksum"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the bytes of every file below a path (for files that fit a row, such as CSV drops)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def build_manifest(df: DataFrame, *, schema_version: str, source_name: str, code_revision: str) -> DataFrame:
    if not code_revision.strip():
        raise PolicyError("a code revision is required for lineage")
    return content_checksum(df).select(
        F.lit(schema_version).alias("schema_version"), F.lit(source_name).alias("source_name"), "row_count",
        "column_count", "checksum", F.lit(code_revision).alias("code_revision"))


@dataclass(frozen=True)
class Verified:
    data: DataFrame
    row_count: int


def load_verified(df: DataFrame, manifest: DataFrame, *, schema_version: str, source_name: str) -> Verified:
    """The table, if it is what its manifest says; an error that names the difference otherwise."""
    stored = manifest.first()
    if stored is None:
        raise PolicyError("manifest is missing")
    reasons: Sequence[str] = [
        name for name, wrong in (
            ("schema_version", stored["schema_version"] != schema_version),
            ("source_name", stored["source_name"] != source_name)) if wrong]
    now = content_checksum(df).first()
    reasons = [*reasons, *[c for c in ("row_count", "column_count", "checksum") if stored[c] != now[c]]]
    if reasons:
        raise PolicyError(f"manifest does not match: {', '.join(reasons)}")
    return Verified(df, now["row_count"])
