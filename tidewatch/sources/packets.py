"""Packet tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import PACKET_SCHEMA

BATCH_FILES = 100


def read_packets(
    spark: SparkSession, path: str, limit: int | None = None, schema=PACKET_SCHEMA
) -> DataFrame:
    """Packets from Parquet; ``limit`` keeps the first ones in time, like a packet count."""
    packets = spark.read.schema(schema).parquet(path)
    return packets if limit is None else first_packets(packets, limit)


def first_packets(packets: DataFrame, limit: int) -> DataFrame:
    return packets.orderBy("ts", "packet_id").limit(limit)


def stream_packets(
    spark: SparkSession, path: str, schema=PACKET_SCHEMA, max_files: int = BATCH_FILES
) -> DataFrame:
    """Packets from Parquet files as they arrive, at most ``max_files`` files per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def kafka_packets(spark: SparkSession, servers: str, topic: str, schema=PACKET_SCHEMA, **options):
    """Packets as JSON records of a topic (needs Spark's Kafka package)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    records = reader.option("subscribe", topic).options(**options).load()
    parsed = F.from_json(F.col("value").cast("string"), schema)
    return records.select(parsed.alias("packet")).select("packet.*")


def ip_only(packets: DataFrame, exclude_host: str | None = None) -> DataFrame:
    """IPv4 packets; with ``exclude_host`` only those with neither end at that host.

    Plain comparisons, so that the Parquet reader gets them.
    """
    kept = packets.filter(F.col("ip_version") == 4)
    if exclude_host is not None:
        kept = kept.filter((F.col("src_ip") != exclude_host) & (F.col("dst_ip") != exclude_host))
    return kept
