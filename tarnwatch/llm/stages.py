"""Stages of the corpus pipeline: (spark, documents, folder of the tables) to documents; the last one gives the mix.

Each takes all its predecessor kept and returns the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwatch.llm import decontaminate as leaks, lines, mixing, neardup, quality
from tarnwatch.llm.exprs import table
from tarnwatch.plans.freeze import freeze

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good and not toxic."""
    judged = quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("keep").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that later documents hold too; a document of which nothing stays has an empty text."""
    kept = lines.dedup_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """The rows with a number of their own (_row), written once: a doc_id may be null, or that of several rows."""
    return freeze(docs.select(F.monotonically_increasing_id().alias("_row"), *COLUMNS), label)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar rows the one with the smallest doc_id, one without doc_id only if none has it; of several
    rows with that doc_id, one. Rows are told apart by number, so unlike texts of one doc_id, or without, all stay."""
    rows = numbered(docs, "grouped_rows")
    groups = neardup.classes(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", F.xxhash64("text").alias("_text"), "source", "lang", "n_chars", "_row")
    first = rows.select("_row", order.alias("_order")).join(groups, "_row").groupBy("component_id").agg(F.min("_order")["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item, whatever their doc_id."""
    rows = numbered(docs, "searched_rows")
    found = leaks.leaks(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs.select("doc_id", "text", "source"))
