"""Cut lineage by writing a small table to the shared folder and reading it back.

Unlike a cached or checkpointed frame, a written table carries its true size,
so Catalyst broadcasts it only while it is under autoBroadcastJoinThreshold
and shuffles otherwise. It also survives the loss of any executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnwatch.session import shared_folder
from tarnwatch.sources.files import delete_folder


def frozen_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tarnwatch/{spark.sparkContext.applicationId}"


def freeze(df: DataFrame, label: str = "table", **options: str | int) -> DataFrame:
    """df, written and read back. `options` are those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{frozen_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_frozen(spark: SparkSession) -> None:
    """Remove what this application froze, once no result of it is needed any more."""
    delete_folder(spark, frozen_folder(spark))
