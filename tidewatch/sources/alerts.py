"""Alert tables and alert log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import ALERT_FIELDS, ALERT_SCHEMA

LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) \[(\w+)\] (ALERT|STATUS UPDATE): (\{.*\})$"
LINE_TIME = "yyyy-MM-dd HH:mm:ss,SSS"

STATUS_FIELDS = [
    "runtime", "packets_analyzed", "packets_per_second", "potential_attacks_detected",
    "attack_percentage", "remaining_time",
]


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    """Alerts as Parquet, one folder per day."""
    dated = alerts.withColumn("alert_date", F.to_date("ts"))
    dated.write.mode(mode).partitionBy("alert_date").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*ALERT_SCHEMA.fields, T.StructField("alert_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def _line(time: Column, level: str, kind: str, body: Column) -> Column:
    head = F.date_format(time, LINE_TIME)
    return F.concat(head, F.lit(f" [{level}] {kind}: "), body).alias("value")


def alert_lines(alerts: DataFrame) -> DataFrame:
    """One text line per alert, its fields as JSON."""
    fields = F.to_json(F.struct(*ALERT_FIELDS), {"ignoreNullFields": "false"})
    return alerts.select(_line(F.col("ts"), "WARNING", "ALERT", fields))


def status_lines(status: DataFrame) -> DataFrame:
    """One text line per interval of ``status_window``, at the end of the interval."""
    shown = {
        "runtime": F.format_string("%.1f seconds", "runtime"),
        "packets_analyzed": F.col("packets_analyzed"),
        "packets_per_second": F.format_string("%.1f", "packets_per_second"),
        "potential_attacks_detected": F.col("potential_attacks_detected"),
        "attack_percentage": F.format_string("%.2f%%", "attack_percentage"),
    }
    if "remaining_time" in status.columns:
        shown["remaining_time"] = F.format_string("%.1f seconds", "remaining_time")
    fields = F.to_json(F.struct(*[c.alias(n) for n, c in shown.items()]))
    return status.select(_line(F.col("window_end"), "INFO", "STATUS UPDATE", fields))


def _json(body: Column) -> Column:
    """Bodies printed by Python become JSON: numbers lose their type names, ``None`` is null.

    Single quotes need no change, Spark's reader takes them.
    """
    bare = F.regexp_replace(body, r"np\.float\d+\(([^)]*)\)", "$1")
    return F.regexp_replace(bare, r": None(?=[,}])", ": null")


def _read(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    text = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", LINE, i)
    lines = text.select(
        F.to_timestamp(F.nullif(part(1), F.lit("")), LINE_TIME).alias("logged_at"),
        part(2).alias("level"),
        part(3).alias("kind"),
        part(4).alias("body"),
    ).filter(F.col("kind") == kind)
    return lines.select("logged_at", "level", F.from_json(_json(F.col("body")), schema).alias("f")).select(
        "logged_at", "level", "f.*"
    )


def read_alert_lines(spark: SparkSession, path: str) -> DataFrame:
    """Alert lines back as columns, whether their fields are JSON or printed by Python."""
    schema = T.StructType([ALERT_SCHEMA[name] for name in ALERT_FIELDS])
    return _read(spark, path, "ALERT", schema)


def read_status_lines(spark: SparkSession, path: str) -> DataFrame:
    """Status lines back as columns, numbers without their units."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in STATUS_FIELDS])
    lines = _read(spark, path, "STATUS UPDATE", schema)
    number = lambda c: F.regexp_extract(c, r"^([0-9.]+)", 1).cast("double")
    counts = ("packets_analyzed", "potential_attacks_detected")
    return lines.withColumns({
        n: F.col(n).cast("long") if n in counts else number(n) for n in STATUS_FIELDS
    })
