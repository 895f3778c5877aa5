"""From raw documents to a training mix: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnwatch.llm import stages
from tarnwatch.llm.exprs import table
from tarnwatch.plans.freeze import frozen_folder

STAGES = [
    ("quality classifier", stages.keep_good),
    ("line dedup", stages.dedup_lines),
    ("n-gram Jaccard join", stages.one_of_each_group),
    ("benchmark decontamination", stages.decontaminate),
    ("mixing sources to target weights", stages.mix_sources),
]
# The classifier of the first stage is fitted; no SQL expresses it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{frozen_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
