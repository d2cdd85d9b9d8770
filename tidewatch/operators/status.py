"""Traffic counts per batch, per interval and per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import packets as p
from tidewatch.functions import scoring

INTERVAL = 10


def attacks(threshold, space: str = "logit") -> Column:
    """Number of anomalous packets; packets outside IP are counted as traffic but never scored."""
    hit = p.is_ip() & scoring.exceeds(F.col("score"), threshold, space)
    return F.count(F.when(hit, 1))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole)


def batch_alert_rate(
    scored: DataFrame, threshold, batch: str = "batch_id", space: str = "logit"
) -> DataFrame:
    """Anomalies and their share of each batch. A batch holds IP packets only; others never enter one."""
    counts = scored.filter(p.is_ip()).groupBy(batch).agg(
        F.count("*").alias("packets"), attacks(threshold, space).alias("anomalies")
    )
    return counts.withColumn("alert_percentage", percentage(F.col("anomalies"), F.col("packets")))


def status_window(
    scored: DataFrame,
    threshold,
    seconds: int = INTERVAL,
    offset: str | None = None,
    end_time: Column | None = None,
    space: str = "logit",
) -> DataFrame:
    """Traffic and attacks per interval, batch or stream. ``end_time`` adds the remaining seconds."""
    window = F.window("ts", f"{seconds} seconds", startTime=offset)
    counts = scored.groupBy(window.alias("w")).agg(
        F.count("*").alias("packets_analyzed"),
        attacks(threshold, space).alias("potential_attacks_detected"),
    )
    columns = {
        "window_start": F.col("w.start"),
        "window_end": F.col("w.end"),
        "runtime": F.lit(float(seconds)),
        "packets_analyzed": F.col("packets_analyzed"),
        "packets_per_second": F.col("packets_analyzed") / float(seconds),
        "potential_attacks_detected": F.col("potential_attacks_detected"),
        "attack_percentage": percentage(
            F.col("potential_attacks_detected"), F.col("packets_analyzed")
        ),
    }
    if end_time is not None:
        left = (F.unix_micros(end_time) - F.unix_micros("w.end")) / 1e6
        columns["remaining_time"] = F.greatest(F.lit(0.0), left)
    return counts.select(*[c.alias(n) for n, c in columns.items()])


def run_totals(
    scored: DataFrame, threshold, space: str = "logit", runtime: float | None = None
) -> DataFrame:
    """Totals of a run as one row. ``runtime`` is the planned length of a timed run in seconds;
    without it the time from the first to the last packet."""
    seen = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    totals = scored.agg(
        F.count("*").alias("total_packets"),
        attacks(threshold, space).alias("total_attacks"),
        (seen if runtime is None else F.lit(float(runtime))).alias("runtime"),
    )
    share = percentage(F.col("total_attacks"), F.col("total_packets"))
    return totals.withColumn("attack_percentage", share)
