"""Labelled flow files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.prepare import require_columns
from tidewatch.schemas import FLOW_COLUMNS, FLOW_SCHEMA, LABEL


def read_flows(spark: SparkSession, path: str | list[str], required=(LABEL,)) -> DataFrame:
    """Comma-separated flow files without a header line."""
    flows = spark.read.schema(FLOW_SCHEMA).csv(path, header=False)
    return require_columns(flows, required)


def write_flows(flows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flows.select(*FLOW_COLUMNS).write.mode(mode).csv(path, header=False)
