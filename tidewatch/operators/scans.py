"""Port scans: many destination ports tried by one source in a short time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import packets as p
from tidewatch.session import staged

# A scan is more than this many ports, within this many seconds of the first one.
PORTS = 5
WITHIN = 30

# Above any packet id.
ROOM = 10**19


def scanners(packets: DataFrame, ports: int = PORTS, within: float = WITHIN) -> DataFrame:
    """The sources that become scanners: where in time they do, and until when they count as such.

    The running number of distinct ports passes ``ports`` with the first packet to port number
    ``ports + 1``, so first packets per (source, port) decide. They are pre-aggregated before the
    shuffle, and one source has at most 65,536 of them however many packets it sends.
    """
    return scanners_of(first_ports(packets, ports=ports), ports, within)


def first_ports(packets: DataFrame, earlier: DataFrame | None = None, ports: int = PORTS) -> DataFrame:
    """The ``first`` packet to each of the first ``ports + 1`` ports of a source (``src_ip``, ``dst_port``).

    Later ports change nothing. ``earlier`` has such rows of traffic before.
    """
    syns = packets.filter(p.is_bare_syn()).select(
        "src_ip", "dst_port", _position().cast("decimal(38,0)").alias("first"))
    if earlier is not None:
        syns = syns.unionByName(earlier)
    firsts = syns.groupBy("src_ip", "dst_port").agg(F.min("first").alias("first"))
    nth = F.row_number().over(Window.partitionBy("src_ip").orderBy("first"))
    return firsts.withColumn("nth", nth).filter(F.col("nth") <= ports + 1).drop("nth")


def scanners_of(firsts: DataFrame, ports: int = PORTS, within: float = WITHIN) -> DataFrame:
    """The scanners among the sources of ``first_ports``."""
    nth = F.row_number().over(Window.partitionBy("src_ip").orderBy("first"))
    micros = lambda c: F.expr(f"{c} div {ROOM}")
    until = F.timestamp_micros(micros("start") + F.lit(round(within * 1_000_000)))
    return (
        firsts.withColumn("nth", nth)
        .groupBy("src_ip")
        .agg(
            F.min("first").alias("start"),
            F.max(F.when(F.col("nth") == ports + 1, F.col("first"))).alias("reached"),
        )
        .select(
            "src_ip",
            F.timestamp_micros(micros("reached")).alias("scan_ts"),
            F.expr(f"reached % {ROOM}").cast("long").alias("scan_id"),
            until.alias("scan_until"),
        )
        .filter(F.col("scan_ts") < F.col("scan_until"))
    )


def _position() -> Column:
    """One number that orders packets like (``ts``, ``packet_id``), for times from 1970 on and ids from 0 on.

    Its minimum is found by hash aggregation, while that of a struct would need a sort.
    """
    micros = F.unix_micros("ts").cast("decimal(18,0)")
    return micros * F.lit(str(ROOM)).cast("decimal(20,0)") + F.col("packet_id").cast("decimal(19,0)")


def port_scan(
    packets: DataFrame,
    observed: DataFrame | None = None,
    ports: int = PORTS,
    within: float = WITHIN,
) -> DataFrame:
    """Add ``port_scan``: bare SYNs of a source that has tried more than ``ports`` ports by then.

    The clock of a source starts at its first bare SYN and is never reset. ``observed`` is the
    traffic that counts towards scans (default: ``packets`` itself); the live rule sees anomalous
    packets only, which holds if ``packets`` are filtered by score.

    The scanners are written out first, so that the join below broadcasts them if, and only if, they
    are few. Otherwise it is a join by source in which Spark splits skewed sources.
    """
    return mark_scans(packets, scanners(packets if observed is None else observed, ports, within))


def mark_scans(packets: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``port_scan`` to packets, given the scanners."""
    found = staged(found)
    later = (F.col("ts") > F.col("scan_ts")) | (
        (F.col("ts") == F.col("scan_ts")) & (F.col("packet_id") >= F.col("scan_id"))
    )
    hit = p.is_bare_syn() & later & (F.col("ts") < F.col("scan_until"))
    return (
        packets.join(found, "src_ip", "left")
        .withColumn("port_scan", F.coalesce(hit, F.lit(False)))
        .drop("scan_ts", "scan_id", "scan_until")
    )


def source_scan_summary(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """First bare SYN and number of distinct ports per source.

    The exact count goes through (source, port) first, so a busy source is spread over its ports.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    return (
        packets.filter(p.is_bare_syn())
        .groupBy("src_ip")
        .agg(F.min("ts").alias("first_seen"), count("dst_port").alias("ports"))
    )


# Each sketch has 2^14 registers: a relative standard error of 0.8 % and some 16 kB at most, however many ports.
SKETCH = 14


def port_sketches(packets: DataFrame, log_size: int = SKETCH) -> DataFrame:
    """``first_seen`` and a ``sketch`` of the distinct ports per source, for ``merge_sketches``.

    Parts of the traffic can be sketched apart, and twice: order and repeats change an estimate only within its error.
    """
    return packets.filter(p.is_bare_syn()).groupBy("src_ip").agg(
        F.min("ts").alias("first_seen"), F.hll_sketch_agg("dst_port", log_size).alias("sketch"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """One sketch per source for the traffic of all ``parts``."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("src_ip").agg(
        F.min("first_seen").alias("first_seen"), F.hll_union_agg("sketch", False).alias("sketch"))


def sketched_summary(sketches: DataFrame) -> DataFrame:
    """``source_scan_summary`` with the number of ports estimated from the sketches."""
    return sketches.select("src_ip", "first_seen", F.hll_sketch_estimate("sketch").alias("ports"))
