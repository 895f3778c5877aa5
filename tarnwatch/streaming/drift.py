"""Drift of a stream: counts per closed window on the stream, measures in foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwatch.config import DriftPolicy
from tarnwatch.operators.drift import categorical_evidence, numeric_counts, numeric_evidence, with_status
from tarnwatch.operators.profile import Profile, category_counts


def _windowed(events: DataFrame, at: str, length: str, watermark: str) -> DataFrame:
    return events.withWatermark(at, watermark).withColumn("w", F.window(at, length))


def monitor_stream(
    events: DataFrame, profile: Profile, at: str, *, path: str, checkpoint: str, kind: str = "numeric",
    length: str = "1 day", watermark: str = "24 hours", policy: DriftPolicy = DriftPolicy(),
) -> StreamingQuery:
    """Write the evidence of every closed window below `path`.

    The state holds counts per window, feature and bin (or category), never rows.
    All bins of a window are emitted in the batch in which it closes. A batch that
    is replayed after a failure overwrites its own folder.
    """
    windowed = _windowed(events, at, length, watermark)
    if kind == "numeric":
        counts = numeric_counts(windowed, profile, ["w"])
    else:
        counts = category_counts(windowed, profile.categorical_features, ["w"])

    def measure(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("window_id", F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss")).drop("w")
        if kind == "numeric":
            evidence = numeric_evidence(rows, profile, policy, ["window_id"])
        else:
            evidence = categorical_evidence(rows, profile, policy, ["window_id"])
        with_status([evidence], ["window_id"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        counts.writeStream.outputMode("append").foreachBatch(measure).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
