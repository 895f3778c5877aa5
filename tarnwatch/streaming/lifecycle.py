"""Alert state kept on a stream of actions.

Of an alert's actions two at most take effect, and which is decided by first occurrences. So a micro-batch is settled by
minima per alert over its actions and the alert's state before it: no list of actions is gathered, however many an alert has.
States are a table with a version per batch; a batch that is run again reads the version before it and replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnwatch.operators.alerts import ACTIONS
from tarnwatch.sources.files import folder_exists

STATES = "alert_id string, state string"


def settle(actions: DataFrame, states: DataFrame) -> DataFrame:
    """Every action of a batch with `accepted` and the `state` after it, given the states (alert_id, state) before the batch."""
    order = F.struct("at", "action_id")
    complete = (F.col("action").isin(*ACTIONS) & (F.coalesce(F.length("actor_id"), F.lit(0)) > 0)
                & (F.coalesce(F.length("reason"), F.lit(0)) > 0))
    rows = actions.join(states.withColumnRenamed("state", "__before"), "alert_id", "left").withColumns({
        "__before": F.coalesce("__before", F.lit("open")), "__ok": complete, "__o": order})

    def first(name, condition=F.lit(True)):
        return F.min(F.when(F.col("__ok") & (F.col("action") == name) & condition, F.col("__o")))

    opening = rows.groupBy("alert_id").agg(
        F.first("__before").alias("__was"), first("acknowledge").alias("__ack"), first("suppress").alias("__sup"))
    opened, kept = F.col("__was") == "open", F.col("__was") == "acknowledged"
    opening = opening.withColumn("__first", F.when(opened, F.least("__ack", "__sup")))
    opening = opening.withColumn("__acked", F.when(opened & (F.col("__first") == F.col("__ack")), F.col("__ack")))
    marked = rows.join(opening.select("alert_id", "__was", "__first", "__acked"), "alert_id")
    # The second move: the first resolution or suppression behind the acknowledgement, of this batch or an earlier one.
    behind = (F.col("__was") == "acknowledged") | (F.col("__o") > F.col("__acked"))
    ends = marked.where(F.col("__ok") & F.col("action").isin("resolve", "suppress") & behind).groupBy("alert_id").agg(F.min("__o").alias("__end"))
    marked = marked.join(ends, "alert_id", "left")
    accepted = F.coalesce(F.col("__o") == F.col("__first"), F.lit(False)) | F.coalesce(F.col("__o") == F.col("__end"), F.lit(False))
    outcome = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    moves = marked.where(accepted).groupBy("alert_id").agg(
        F.min_by(outcome[F.col("action")], "__o").alias("__s1"), F.min("__o").alias("__o1"),
        F.max_by(outcome[F.col("action")], "__o").alias("__s2"), F.max("__o").alias("__o2"))
    out = marked.withColumn("accepted", accepted).join(moves, "alert_id", "left")
    state = (F.when(F.col("__o2").isNotNull() & (F.col("__o") >= F.col("__o2")), F.col("__s2"))
             .when(F.col("__o1").isNotNull() & (F.col("__o") >= F.col("__o1")), F.col("__s1")).otherwise(F.col("__was")))
    return out.select("alert_id", "action_id", "at", "action", "accepted", state.alias("state"))


def run_lifecycle(actions: DataFrame, path: str, checkpoint: str) -> None:
    """Settle all available actions, batch by batch, under `path`."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = f"{path}/states/{number - 1}"
        states = spark.read.schema(STATES).parquet(before) if folder_exists(spark, before) else spark.createDataFrame([], STATES)
        settle(rows, states).write.mode("overwrite").parquet(f"{path}/history/batch={number}")
        own = spark.read.parquet(f"{path}/history/batch={number}")
        last = own.groupBy("alert_id").agg(F.max_by("state", F.struct("at", "action_id")).alias("state"))
        states.join(last, "alert_id", "left_anti").unionByName(last).write.mode("overwrite").parquet(f"{path}/states/{number}")

    actions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/history").parquet(f"{path}/history")
