"""Streaming jobs: alerts and status counts from packet streams, with sinks that can be re-run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import packets, status
from tidewatch.sources.packets import ip_only
from tidewatch.streaming import stateful

# Seconds between micro-batches, and the length of a status interval.
FLUSH_SECONDS = 5
STATUS_SECONDS = 10


def stream_alerts(
    scored: DataFrame,
    threshold: float,
    trusted: DataFrame | Iterable[str] = (),
    space: str = "logit",
    drop_normal: bool = False,
) -> DataFrame:
    """Alerts from a stream of scored packets; scans are tracked among anomalous packets."""
    anomalous = packets.flag_anomalies(ip_only(scored), threshold, space)
    flagged = stateful.stream_port_scan(anomalous)
    return packets.alerts(packets.mark_trusted(flagged, trusted), drop_normal)


def stream_status(
    scored: DataFrame, threshold: float, seconds: int = STATUS_SECONDS, space: str = "logit"
) -> DataFrame:
    """Counts per interval of a stream with a watermark."""
    return status.status_window(scored, threshold, seconds, space=space)


def start(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    output_mode: str = "append",
    available_now: bool = False,
    flush_seconds: int = FLUSH_SECONDS,
) -> StreamingQuery:
    """Write each micro-batch to its own folder ``batch_id=N``.

    A batch that is run again after a failure replaces its folder, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).outputMode(output_mode)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{flush_seconds} seconds").start()


def run_bounded(query: StreamingQuery, timeout: float | None = None) -> bool:
    """Wait until the query ends, or stop it after ``timeout`` seconds; True if it ended by itself."""
    if timeout is None:
        query.awaitTermination()
        return True
    ended = query.awaitTermination(timeout)
    if not ended:
        query.stop()
    return ended


def written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``start`` has written so far, with ``batch_id``."""
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(whole).parquet(path)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last version of each row of a stream written in update mode."""
    values = F.struct(*[c for c in rows.columns if c not in keys])
    newest = rows.groupBy(*keys).agg(F.max_by(values, "batch_id").alias("_row"))
    return newest.select(*keys, "_row.*").drop("batch_id")
