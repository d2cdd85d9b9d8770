"""Row-wise operators over packet tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import alerts as a
from tidewatch.functions import packets as p
from tidewatch.functions import scoring
from tidewatch.operators import connections, skew
from tidewatch.schemas import ALERT_SCHEMA, PACKET_FEATURES
from tidewatch.session import staged

LOOPBACK = "127.0.0.1"


def feature_columns(count=None) -> dict:
    """The packet features as columns, ``count`` given by the caller (1 if not)."""
    columns = {
        "protocol_type": p.protocol_type(),
        "service": p.service(),
        "flag": p.flag(),
        "src_bytes": p.datagram_bytes(),
        "dst_bytes": p.datagram_bytes(),
        "land": p.land(),
        "wrong_fragment": p.wrong_fragment(),
        "urgent": p.urgent(),
        "count": F.lit(1) if count is None else count,
        **{name: F.lit(value) for name, value in p.CONSTANT_FEATURES.items()},
    }
    return {name: columns[name] for name in PACKET_FEATURES}


def packet_features(
    packets: DataFrame,
    max_age: float | None = None,
    max_rows: int = skew.MAX_GROUP_ROWS,
    keep: Iterable[str] = ("packet_id",),
) -> DataFrame:
    """The features of each packet. ``max_age=300`` forgets connections as the live job does."""
    counted = connections.connection_count(packets, max_age, max_rows)
    columns = feature_columns(F.col("count"))
    return counted.select(*keep, *[c.alias(n) for n, c in columns.items()])


def mark_trusted(packets: DataFrame, hosts: DataFrame | Iterable[str] = ()) -> DataFrame:
    """Add ``trusted``: whether the source is a trusted host. The loopback address never is.

    The hosts, a table with column ``ip`` or a list of any length, are joined; Spark broadcasts them
    only if they are small.
    """
    if not isinstance(hosts, DataFrame):
        listed = [(host,) for host in sorted(set(hosts))]
        hosts = packets.sparkSession.createDataFrame(listed, "ip string")
    known = (
        hosts.select(F.col("ip").alias("src_ip")).filter(F.col("src_ip") != LOOPBACK).distinct()
    )
    marked = packets.join(known.withColumn("_known", F.lit(True)), "src_ip", "left")
    return marked.withColumn("trusted", F.col("_known").isNotNull()).drop("_known")


def only_trusted(packets: DataFrame, hosts: DataFrame, keep: bool = True) -> DataFrame:
    """Packets whose source is (or with ``keep=False`` is not) a trusted host."""
    known = hosts.select(F.col("ip").alias("src_ip")).filter(F.col("src_ip") != LOOPBACK)
    return packets.join(known, "src_ip", "left_semi" if keep else "left_anti")


def flag_anomalies(scored: DataFrame, threshold, space: str = "logit") -> DataFrame:
    """Keep the packets whose ``score`` passes the threshold (a number or a column)."""
    return scored.filter(scoring.exceeds(F.col("score"), threshold, space))


def details_columns() -> dict:
    known = F.upper(p.protocol_type())
    return {
        "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"),
        "src_ip": F.when(p.is_ip(), F.col("src_ip")),
        "dst_ip": F.when(p.is_ip(), F.col("dst_ip")),
        "protocol": F.when(p.protocol_type() == "unknown", "unknown").otherwise(known),
        "src_port": F.when(p.is_tcp() | p.is_udp(), F.col("src_port")),
        "dst_port": F.when(p.is_tcp() | p.is_udp(), F.col("dst_port")),
        "flags": p.tcp_flag_names(),
        "size": F.coalesce("frame_len", F.lit(0)),
    }


def packet_details(packets: DataFrame) -> DataFrame:
    """Addresses, ports, protocol, flag names, size and attack type, with the score if there is one.

    Takes ``port_scan`` and ``trusted`` columns into account where present.
    """
    columns = {**details_columns(), "attack_type": _attack(packets)}
    if "score" in packets.columns:
        columns["prediction_score"] = F.col("score")
    return packets.select("packet_id", *[c.alias(n) for n, c in columns.items()])


def _attack(packets: DataFrame):
    present = {c: F.col(c) if c in packets.columns else F.lit(False) for c in ("port_scan", "trusted")}
    return a.attack_type(present["port_scan"], present["trusted"])


def alerts(anomalous: DataFrame, drop_normal: bool = False) -> DataFrame:
    """One alert per anomalous packet (columns ``score``, ``port_scan`` and ``trusted``)."""
    d = details_columns()
    columns = {
        "packet_id": F.col("packet_id"),
        "ts": F.col("ts"),
        "attack_type": _attack(anomalous),
        "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "source_ip": d["src_ip"],
        "source_port": d["src_port"],
        "destination_ip": d["dst_ip"],
        "destination_port": d["dst_port"],
        "protocol": d["protocol"],
        "flags": d["flags"],
        "size": d["size"],
        "anomaly_score": F.col("score"),
    }
    # In steps, so that each rule is evaluated once and then referred to.
    found = anomalous.select(*[c.alias(n) for n, c in columns.items()])
    found = found.withColumn("attack_type", a.alert_type(F.col("attack_type")))
    if drop_normal:
        found = found.filter(F.col("attack_type") != "NORMAL")
    kind = F.col("attack_type")
    message = a.alert_message(kind, F.col("source_ip"), F.col("destination_ip"))
    found = found.withColumns({"severity": a.severity(kind), "alert_message": message})
    return found.select(*ALERT_SCHEMA.names)


def recent_suspicious(scored: DataFrame, n: int = 1000) -> DataFrame:
    """Details of the newest ``n`` scored packets."""
    newest = scored.orderBy(F.desc("ts"), F.desc("packet_id")).limit(n)
    return packet_details(newest)


def first_rows(packets: DataFrame, n: int) -> DataFrame:
    """The first ``n`` packets by time and id, written, for any ``n``.

    Packets are range-partitioned; the numbers of rows per range tell which ranges are wanted whole and in which one the
    limit falls. Only that one is sorted.
    """
    if n <= 0:
        return packets.limit(0)
    order = ["ts", "packet_id"]
    ranged = staged(packets.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    left, whole = n, []
    for r in sorted(ranged.groupBy("_range").count().collect()):  # a row per task
        if r["count"] > left:
            edge = ranged.where(F.col("_range") == r["_range"]).orderBy(*order).limit(left)
            return ranged.where(F.col("_range").isin(whole)).unionByName(edge).drop("_range")
        whole.append(r["_range"])
        left -= r["count"]
    return ranged.drop("_range")
