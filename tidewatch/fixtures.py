"""Packet, score and flow tables derived from general-purpose tables, for checks and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import SCORED_PACKET_SCHEMA
from tidewatch.session import staged

TRUSTED_HOSTS = ["10.0.0.1", "127.0.0.1"]
THRESHOLD = 0.1
START_MICROS = 1_704_067_200_000_000


_derived: dict[tuple, DataFrame] = {}


def _files(spark: SparkSession, folder: str, name: str) -> tuple:
    """Names, times and sizes of a table's files, from the file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    listed = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
    found = []
    while listed.hasNext():
        file = listed.next()
        found.append((file.getPath().toString(), file.getModificationTime(), file.getLen()))
    return tuple(sorted(found))


def _derive(spark: SparkSession, folder: str, name: str, make) -> DataFrame:
    """A derived table, written once per application and state of the given table's files."""
    key = (spark.sparkContext.applicationId, folder, name, _files(spark, folder, "events"))
    if key not in _derived:
        _derived[key] = staged(make(spark, folder))
    return _derived[key]


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a scored packet, ten packets a second.

    Of 23 packets one is no IP packet and one is an IPv6 packet.
    """
    return _derive(spark, folder, "packets", _packets)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a probability ``p``, a logit ``z`` and a label ``y``."""
    return _derive(spark, folder, "scored", _scored)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _packets(spark: SparkSession, folder: str) -> DataFrame:
    k, user, other = F.col("k"), F.col("user_id"), F.col("event_id") % 23
    ip = other >= 2
    m = F.when(ip, k % 20).otherwise(99)
    tcp, udp, icmp = m < 14, m.between(14, 16), m.between(17, 18)
    source = F.concat(
        F.lit("10.0."), F.floor(F.col("event_id") / 4000).cast("string"),
        F.lit("."), (user % 4).cast("string"),
    )
    ports = F.when(k % 7 == 0, 80).when(k % 7 == 1, 443).when(k % 7 == 2, 22).when(k % 7 == 3, 21)
    flags = (
        F.when(m == 0, 0).when(m == 1, 1).when(m == 2, 41).when(m == 3, 18).when(m == 4, 16)
        .when(m == 5, 24).when(m == 6, 4).when(m == 7, 43).otherwise(2)
    )
    columns = {
        "packet_id": F.col("event_id"),
        "ts": F.timestamp_micros(F.lit(START_MICROS) + F.col("event_id") * 100_000),
        "ip_version": F.when(ip, 4).when(other == 1, 6),
        "src_ip": F.when(ip, source).when(other == 1, F.concat(F.lit("fd00::"), (user % 4).cast("string"))),
        "dst_ip": F.when(ip & (k % 25 == 0), source)
        .when(ip, F.concat(F.lit("10.1.0."), (k % 8).cast("string")))
        .when(other == 1, F.concat(F.lit("fd00::1:"), (k % 8).cast("string"))),
        "ip_proto": F.when(tcp, 6).when(udp, 17).when(icmp, 1).when(ip, 47).when(other == 1, 6),
        "src_port": F.when(tcp, 1024 + user % 16).when(udp, 5000),
        "dst_port": F.when(tcp, ports.otherwise(1000 + k)).when(
            udp, F.when(k % 2 == 0, 53).otherwise(161)
        ),
        "tcp_flags": F.when(tcp, flags),
        "urgptr": F.when(tcp, (k % 11 == 0).cast("int")),
        "icmp_type": F.when(m == 17, 8).when(m == 18, 0),
        "ip_mf": F.when(ip, k % 13 == 0),
        "ip_frag": F.when(ip, F.when(k % 17 == 0, 185).otherwise(0)),
        "ip_len": F.when(ip, 40 + k),
        "frame_len": F.when(k % 50 == 49, 1514).otherwise(54 + k),
        "score": (k - 40) / F.lit(20.0),
    }
    events = table(spark, folder, "events").select("event_id", "user_id", _k().alias("k"))
    return events.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in SCORED_PACKET_SCHEMA]
    )


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "event_type", _k().alias("k"))
    return events.select(
        "event_id",
        (F.col("k") / F.lit(100.0)).alias("p"),
        ((F.col("k") - 40) / F.lit(20.0)).alias("z"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
    )


FLOW_NUMERIC = ["quantity", "extendedprice", "discount", "tax", "constant"]
FLOW_CATEGORICAL = ["returnflag", "linestatus"]


def flows(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line as a labelled flow; ``raw`` has null and both infinities for cleaning."""
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    raw = F.when(line == 2, float("inf")).when(line == 3, float("-inf")).otherwise(quantity)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        quantity.alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.lit(7.0).alias("constant"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
        F.when(F.col("l_returnflag") == "N", "normal").otherwise(F.col("l_returnflag")).alias("label"),
        F.when(line != 1, raw).alias("raw"),
    )
