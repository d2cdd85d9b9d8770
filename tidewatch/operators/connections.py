"""State per one-way TCP connection: running counts, epochs and summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions import packets as p
from tidewatch.operators import skew
from tidewatch.schemas import CONNECTION
from tidewatch.session import staged

# Fixed value: seconds after its first packet at which a connection's count starts again.
MAX_AGE = 300

# Times of one connection that one task may hold as an array.
FOLD_ROWS = 200_000

def connection_count(
    packets: DataFrame,
    max_age: float | None = None,
    max_rows: int = skew.MAX_GROUP_ROWS,
    running_bytes: bool = False,
    weights: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add ``count``: the number of the packet in its connection; 1 outside TCP.

    With ``max_age`` (seconds) the connection is forgotten once a packet comes later than that after
    the first one counted, and ``epoch`` tells how often it has been started. ``running_bytes`` adds
    the byte total that goes with the count. Packets outside connections are not shuffled at all.

    The starts of epochs become rows among the packets of their connection, just before the first
    packet of the epoch. The epoch is their running number, and counts restart at them: all of it is
    one pass over the packets in order, however many epochs there are.
    """
    sums = {"count": F.lit(1).cast("long")}
    if running_bytes:
        sums["running_bytes"] = F.col("frame_len").cast("long")
    if weights:  # rows that stand for several packets
        sums = {name: F.coalesce(weights[name], value) for name, value in sums.items()}
    tracked = packets.filter(p.in_connection())
    others = packets.filter(~p.in_connection()).withColumns(sums)
    hot = skew.hot_keys(tracked, CONNECTION, max_rows)
    if max_age is None:
        return skew.running_sums(tracked, CONNECTION, sums, max_rows, hot=hot).unionByName(others)
    others = others.withColumn("epoch", F.lit(1))
    starts = _epoch_starts(tracked, max_age, max_rows)
    marks = starts.select(*CONNECTION, F.timestamp_micros("us").alias("ts"))
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in tracked.schema if f.name not in marks.columns]
    marked = tracked.withColumn("_start", F.lit(0)).unionByName(
        marks.select("*", *absent, F.lit(1).alias("_start"))
    )
    at_start = F.col("_start") == 1
    parts = {name: F.when(at_start, 0).otherwise(value).cast("long") for name, value in sums.items()}
    order = ["ts", "_after", "packet_id"]
    marked = marked.withColumn("_after", 1 - F.col("_start"))
    counted = skew.running_sums(marked, CONNECTION, parts, max_rows, order, at_start, hot)
    epochs = skew.running_sums(counted, CONNECTION, {"epoch": F.col("_start").cast("long")}, max_rows, order, hot=hot)
    found = epochs.filter(~at_start).withColumn("epoch", F.col("epoch").cast("int"))
    return found.drop("_start", "_after").unionByName(others)


def carried_count(
    packets: DataFrame,
    known: DataFrame,
    max_age: float | None = MAX_AGE,
    max_rows: int = skew.MAX_GROUP_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Number packets that follow others, and what is to be carried on to those that follow them.

    ``known`` has per connection the start of its epoch (``ts``), ``carried_count`` and ``carried_bytes``.
    It goes in as one row among the packets, which stands for all of the epoch so far. Returns the packets
    with ``count`` and ``running_bytes``, and the new state; connections whose epoch has ended before the
    newest packet are forgotten.
    """
    tracked = packets.filter(p.in_connection())
    keys = tracked.select(*CONNECTION).distinct()
    carried = [F.lit(None).cast("long").alias(c) for c in ("carried_count", "carried_bytes")]
    absent = [
        F.lit(None).cast(f.dataType).alias(f.name) for f in packets.schema
        if f.name not in (*CONNECTION, "ts", "packet_id", "ip_version", "ip_proto")
    ]
    stand_in = known.join(keys, CONNECTION, "left_semi").select(
        "*", *absent, F.lit(-1).cast("long").alias("packet_id"), F.lit(4).alias("ip_version"),
        F.lit(p.TCP).alias("ip_proto"),
    )
    rows = packets.select("*", *carried).unionByName(stand_in)
    weights = {"count": F.col("carried_count"), "running_bytes": F.col("carried_bytes")}
    counted = staged(connection_count(rows, max_age, max_rows, running_bytes=True, weights=weights))
    last = F.max(F.struct(*(["epoch"] if max_age is not None else []), "count", "running_bytes")).alias("x")
    ends = counted.filter(p.in_connection()).groupBy(*CONNECTION).agg(last, F.min("ts").alias("_first"))
    if max_age is None:
        started = ends.withColumn("ts", F.col("_first"))
    else:
        first = counted.filter(p.in_connection()).groupBy(*CONNECTION, "epoch").agg(F.min("ts").alias("ts"))
        started = ends.withColumn("epoch", F.col("x.epoch")).join(first, [*CONNECTION, "epoch"])
    state = started.select(
        *CONNECTION, "ts", F.col("x.count").alias("carried_count"), F.col("x.running_bytes").alias("carried_bytes")
    ).unionByName(known.join(keys, CONNECTION, "left_anti"))
    if max_age is not None:
        newest = packets.agg(F.max("ts")).first()[0]
        if newest is not None:
            left = F.unix_micros(F.lit(newest)) - F.unix_micros("ts") <= round(max_age * 1_000_000)
            state = state.filter(left)
    found = counted.filter(F.col("carried_count").isNull()).drop("carried_count", "carried_bytes")
    return found, state


def running_bytes(packets: DataFrame, max_rows: int = skew.MAX_GROUP_ROWS) -> DataFrame:
    """Add ``count`` and ``running_bytes`` per connection."""
    return connection_count(packets, max_rows=max_rows, running_bytes=True)


def connection_summary(packets: DataFrame) -> DataFrame:
    """Start time, packet count, byte total and service per connection.

    The service follows from the destination port, so it is the same for all packets of one.
    """
    return (
        packets.filter(p.in_connection())
        .groupBy(*CONNECTION)
        .agg(
            F.min("ts").alias("start_time"),
            F.count("*").alias("count"),
            F.sum("frame_len").alias("bytes"),
        )
        .withColumn("service", p.by_port(p.TCP_SERVICES))
    )


def epoch_starts(
    packets: DataFrame, max_age: float = MAX_AGE, max_rows: int = skew.MAX_GROUP_ROWS
) -> DataFrame:
    """One row per epoch of every connection: ``epoch`` (from 1) and ``epoch_start``."""
    starts = _epoch_starts(packets.filter(p.in_connection()), max_age, max_rows)
    numbered = skew.running_sums(
        starts, CONNECTION, {"epoch": F.lit(1).cast("long")}, max_rows, ["us"]
    )
    return numbered.select(
        *CONNECTION, F.col("epoch").cast("int").alias("epoch"),
        F.timestamp_micros("us").alias("epoch_start"),
    )


def _epoch_starts(tracked: DataFrame, max_age: float, max_rows: int) -> DataFrame:
    """One row per epoch: the connection and the time (``us``, microseconds) of its first packet.

    An epoch starts at the first packet later than ``max_age`` after the previous start. A connection
    no longer than ``max_age`` has one epoch, so most are settled by one aggregate. Of the others, those with
    up to ``FOLD_ROWS`` packets fold their times one after another. The times of the rest point to the
    first time more than ``max_age`` later. These pointers, doubled in length each round, give all starts;
    rounds grow with the logarithm of the span, and all joins are on (connection, time): no skew.
    """
    age = round(max_age * 1_000_000)
    times = tracked.select(*CONNECTION, F.unix_micros("ts").alias("us"))
    spans = staged(times.groupBy(*CONNECTION).agg(
        F.min("us").alias("_first"), F.max("us").alias("_last"), F.count("*").alias("_n"),
    ).withColumn("_id", F.monotonically_increasing_id()))
    firsts = spans.select(*CONNECTION, F.col("_first").alias("us"))
    long = spans.filter(F.col("_last") - F.col("_first") > age)
    most = min(max_rows, FOLD_ROWS)
    hot = F.col("_n") > most
    some, span = long.agg(F.count_if(~hot), F.max(F.when(hot, F.col("_last") - F.col("_first")))).first()
    found = firsts
    if some:
        found = found.unionByName(_fold(times, long.filter(~hot), age))
    if span is not None:
        found = found.unionByName(_follow(times, long.filter(hot), age, span))
    return staged(found)


def _fold(times: DataFrame, connections: DataFrame, age: int) -> DataFrame:
    """The later epoch starts of connections whose times fit one task."""
    rows = skew._joined(times, connections.select(*CONNECTION), CONNECTION)
    folded = rows.groupBy(*CONNECTION).agg(F.array_sort(F.collect_set("us")).alias("_times"))
    start = F.struct(F.col("_times")[0].alias("last"), F.array().cast("array<bigint>").alias("starts"))

    def later(so_far: Column, us: Column) -> Column:
        new = F.struct(us.alias("last"), F.array_append(so_far["starts"], us).alias("starts"))
        return F.when(us - so_far["last"] > age, new).otherwise(so_far)

    starts = F.aggregate("_times", start, later, lambda x: x["starts"])
    return folded.select(*CONNECTION, F.explode(starts).alias("us"))


def _follow(times: DataFrame, connections: DataFrame, age: int, span: int) -> DataFrame:
    """The later epoch starts of the given connections, by pointer doubling.

    Every time points to the first time more than ``age`` later. Starting from the first time of the
    connection, the reached set doubles its depth each round while the pointers are squared.
    """
    named = connections.select(*CONNECTION, "_id")
    nodes = skew._joined(times, named, CONNECTION).select("_id", "us").distinct()
    jumps = staged(_next_after(nodes, age))
    first = connections.select("_id", F.col("_first").alias("us"))
    reached, depth = staged(first), 1
    while depth <= span // age + 1:
        step = reached.join(jumps, ["_id", "us"]).select("_id", F.col("_next").alias("us"))
        reached = staged(reached.unionByName(step).distinct())
        depth *= 2
        if depth > span // age + 1:
            break
        onward = jumps.select("_id", F.col("us").alias("_next"), F.col("_next").alias("_far"))
        jumps = staged(
            jumps.join(onward, ["_id", "_next"]).select("_id", "us", F.col("_far").alias("_next"))
        )
    later = reached.join(first, ["_id", "us"], "left_anti")
    return later.join(named, "_id").select(*CONNECTION, "us")


def _next_after(nodes: DataFrame, age: int, tick: int = 1_000_000) -> DataFrame:
    """For each time the first one more than ``age`` later; times without one are left out.

    Looked for in the tick in which the age runs out, else in the next tick that has any time, so
    that no window holds more than one tick of a connection or one row per tick.
    """
    tick_of = lambda c: F.floor(c / tick)
    marks = nodes.withColumns({"_at": F.col("us"), "_from": F.lit(None).cast("long")}).unionByName(
        nodes.withColumns({"_at": F.col("us") + age, "_from": F.col("us")})
    ).withColumn("_tick", tick_of(F.col("_at")))
    is_node = F.col("_from").isNull()

    def following(group: list[str], order: list[Column]) -> WindowSpec:
        """Rows behind the current one in time, read backwards so that frames only ever grow."""
        return (
            Window.partitionBy(*group).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

    in_tick = following(
        ["_id", "_tick"], [F.col("_at").desc(), F.when(is_node, 1).otherwise(0)]
    )
    ticks = marks.groupBy("_id", "_tick").agg(F.min(F.when(is_node, F.col("_at"))).alias("_lo"))
    later = (
        Window.partitionBy("_id").orderBy(F.col("_tick").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ticks = ticks.select(
        "_id", "_tick", F.last("_lo", ignorenulls=True).over(later).alias("_later")
    )
    nearest = F.last(F.when(is_node, F.col("_at")), ignorenulls=True).over(in_tick)
    return (
        marks.withColumn("_near", nearest)
        .filter(~is_node)
        .join(ticks, ["_id", "_tick"])
        .select("_id", "us", F.coalesce("_near", "_later").alias("_next"))
        .filter(F.col("_next").isNotNull())
    )
