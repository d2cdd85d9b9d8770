"""The live job: raw packets in; alerts, counts per interval and a final report out.

Each micro-batch goes through the batch operators, which split hot keys and stay in the JVM but for the
network. What a batch must know of the ones before it is carried over in tables that hold, per connection, its start,
count and bytes, and per source the first packets to its first ports. A batch writes the keys that it touched, see
``carried``. All outputs of a batch are written under its number, so a batch that is run again replaces them.

Batches must follow each other in time. With ``delay`` the job sees to that itself: packets wait until one
that is more than ``delay`` seconds later has come, then they go on, once each, whatever the order in which they came.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import packets as packet_fields
from tidewatch.operators import connections, learn, packets, prepare, scans, status
from tidewatch.schemas import ALERT_SCHEMA, CONNECTION
from tidewatch.session import staged, staging
from tidewatch.sources import reports
from tidewatch.sources.packets import ip_only
from tidewatch.streaming import jobs
from tidewatch.streaming.carried import CarriedTable, delete

KEY = ", ".join([f"{c} {'int' if c.endswith('port') else 'string'}" for c in CONNECTION])
CONNECTION_STATE = f"{KEY}, ts timestamp, carried_count long, carried_bytes long"
SOURCE_STATE = "src_ip string, started long, firsts array<struct<first: decimal(38,0), dst_port: int>>"
COUNTS = "window_start timestamp, packets long, attacks long, first_ts timestamp, last_ts timestamp"
#: Microseconds before which packets are late, packets taken so far, repeated or late ones left out so far.
PROGRESS = "watermark long, taken long, left_out long"

DAY = 86_400


@dataclass
class Live:
    """A job over packets without scores. ``folder`` holds its outputs and what it carries over.

    ``forget`` (seconds, by default a day) drops what is known of sources whose clock started longer ago; with None a
    source is remembered for ever, as its clock is never reset. ``delay`` (seconds) is how much later than others a packet
    may come; later ones are left out, as are repeats by ``packet_id``. Without it packets must come in order
    from batch to batch and once. ``count`` ends the job after so many packets, the first ones in time.
    """

    folder: str
    scaler: prepare.Scaler
    network: learn.DenseNetwork
    threshold: float
    trusted: Iterable[str] = field(default_factory=tuple)
    max_age: float | None = connections.MAX_AGE
    interval: int = status.INTERVAL
    forget: float | None = DAY
    delay: float | None = None
    count: int | None = None

    def __post_init__(self) -> None:
        self.connections = CarriedTable(f"{self.folder}/connections", CONNECTION_STATE, CONNECTION)
        self.sources = CarriedTable(f"{self.folder}/sources", SOURCE_STATE, ["src_ip"])
        self.last: int | None = None
        self.done = self.count == 0

    def _path(self, what: str, batch_id: int) -> str:
        return f"{self.folder}/{what}/batch_id={batch_id}"

    # --- what comes in ---

    def _progress(self, spark: SparkSession, batch_id: int) -> tuple[int | None, int, int]:
        if batch_id < 0:
            return None, 0, 0
        return tuple(spark.read.schema(PROGRESS).parquet(self._path("progress", batch_id)).first())

    def _taken(self, batch: DataFrame, batch_id: int, end: bool) -> DataFrame:
        """The packets that this batch handles; the others wait in ``held``, or are left out."""
        spark = batch.sparkSession
        watermark, taken, left_out = self._progress(spark, batch_id - 1)
        rows = staged(batch)
        if self.delay is not None:
            micros = F.unix_micros("ts")
            came = rows.count()
            fresh = rows if watermark is None else rows.where(micros >= watermark)
            if batch_id:
                waiting = spark.read.schema(batch.schema).parquet(self._path("held", batch_id - 1))
                came += waiting.count()
                fresh = fresh.unionByName(waiting)
            fresh = staged(fresh.dropDuplicates(["packet_id"]))
            newest, kept = fresh.agg(F.max(micros), F.count("*")).first()
            left_out += came - kept
            if newest is not None:
                watermark = max(watermark or 0, newest - round(self.delay * 1e6))
            ready = F.lit(end) | (micros < watermark) if watermark is not None else F.lit(end)
            fresh.where(~ready).write.mode("overwrite").parquet(self._path("held", batch_id))
            rows = fresh.where(ready)
        number = rows.count()
        if self.count is not None and number > self.count - taken:
            number = self.count - taken
            rows = packets.first_rows(rows, number)
        taken += number
        self.done = self.done or taken == self.count
        progress = spark.createDataFrame([(watermark, taken, left_out)], PROGRESS)
        progress.write.mode("overwrite").parquet(self._path("progress", batch_id))
        return rows

    # --- what is carried over ---

    def _fresh(self, started: Column, now: int | None) -> Column:
        """Is a source still remembered whose clock started then (microseconds)?"""
        return F.lit(True) if self.forget is None or now is None else started >= now - round(self.forget * 1e6)

    def _known_ports(self, spark: SparkSession, batch_id: int, among: DataFrame, now: int | None) -> DataFrame:
        known = self.sources.read(spark, batch_id, among).where(self._fresh(F.col("started"), now))
        return known.select("src_ip", F.explode("firsts").alias("f")).select("src_ip", "f.dst_port", "f.first")

    def _carry_ports(self, seen: DataFrame, batch_id: int, now: int | None) -> None:
        firsts = F.array_sort(F.collect_list(F.struct("first", "dst_port")))
        sources = seen.groupBy("src_ip").agg(firsts.alias("firsts"))  # a few ports each
        started = F.expr(f"cast(firsts[0].first div {scans.ROOM} as long)")
        keep = self._fresh(F.col("started"), now)
        self.sources.write(batch_id, sources.withColumn("started", started).where(self._fresh(started, now)), keep)

    def _carry_connections(self, after: DataFrame, batch_id: int, now: int | None) -> None:
        keep = None
        if self.max_age is not None and now is not None:
            keep = F.unix_micros("ts") >= now - round(self.max_age * 1e6)
        self.connections.write(batch_id, after, keep)

    # --- a batch ---

    def process(self, batch: DataFrame, batch_id: int, end: bool = False) -> None:
        """Handle one micro-batch; the batch before it must have been handled. ``end``: nothing waits any longer."""
        spark = batch.sparkSession
        for table in (self.connections, self.sources):
            table.forget(spark, batch_id)
        for what in ("held", "progress"):
            delete(spark, self._path(what, batch_id - 2))
        with staging(spark):
            self._process(self._taken(batch, batch_id, end), batch_id)
        self.last = batch_id

    def _process(self, taken: DataFrame, batch_id: int) -> None:
        spark, rows = taken.sparkSession, staged(taken)
        now = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
        traffic = ip_only(rows)
        touched = traffic.filter(packet_fields.in_connection()).select(*CONNECTION).distinct()
        known = staged(self.connections.read(spark, batch_id, touched))
        counted, after = connections.carried_count(traffic, known, self.max_age)
        self._carry_connections(after, batch_id, now)
        features = packets.feature_columns(F.col("count"))
        inputs = counted.select(*rows.columns, *[c.alias(n) for n, c in features.items() if n not in rows.columns])
        vectors = learn.encode_packets(inputs, self.scaler)
        scored = learn.score_dense_network(vectors, self.network).select(*rows.columns, "score")
        anomalous = staged(packets.flag_anomalies(scored, self.threshold))

        asking = anomalous.filter(packet_fields.is_bare_syn()).select("src_ip").distinct()
        firsts = staged(self._known_ports(spark, batch_id, asking, now))
        seen = staged(scans.first_ports(anomalous, firsts))
        self._carry_ports(seen, batch_id, now)
        flagged = scans.mark_scans(anomalous, scans.scanners_of(seen))
        found = packets.alerts(packets.mark_trusted(flagged, self.trusted))
        dated = found.withColumns({"alert_date": F.to_date("ts"), "batch_id": F.lit(batch_id).cast("long")})
        writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("alert_date", "batch_id").parquet(f"{self.folder}/alerts")

        window = F.window("ts", f"{self.interval} seconds").start.alias("window_start")
        hits = anomalous.groupBy(window).agg(F.count("*").alias("attacks"))
        counts = rows.groupBy(window).agg(
            F.count("*").alias("packets"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        joined = counts.join(hits, "window_start", "left").fillna(0, ["attacks"])
        joined.write.mode("overwrite").parquet(self._path("counts", batch_id))

    def start(self, stream: DataFrame, available_now: bool = False, flush_seconds: int = jobs.FLUSH_SECONDS) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        if available_now:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{flush_seconds} seconds").start()

    def run(self, stream: DataFrame, timeout: float | None = None, **options) -> bool:
        """Run for ``timeout`` seconds (without it until the stream ends) or up to ``count`` packets, finish the open
        batch and what still waits, and write the report; True if the job ended before its time was up.

        A run is whole after that: the stream is not to be taken up again.
        """
        spark = stream.sparkSession
        if not self.done:
            until = None if timeout is None else time.monotonic() + timeout
            query = self.start(stream, **{"available_now": timeout is None, **options})
            while not query.awaitTermination(0.1) and not self.done and (until is None or time.monotonic() < until):
                pass
            ended = self.done or not query.isActive
            while query.isActive and query.status["isTriggerActive"]:
                time.sleep(0.1)
            query.stop()
            if self.delay is not None and self.last is not None and not self.done:
                self.process(spark.createDataFrame([], stream.schema), self.last + 1, end=True)
        else:
            ended = True
        reports.write_report(self.totals(spark, timeout), f"{self.folder}/report")
        return ended

    def _counts(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(f"{COUNTS}, batch_id long").parquet(f"{self.folder}/counts")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{COUNTS}, batch_id long")  # no batch came

    def alerts(self, spark: SparkSession) -> DataFrame:
        """What has been found so far, with ``alert_date`` and ``batch_id``."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ALERT_SCHEMA)
        return spark.read.schema(f"{schema}, alert_date date, batch_id long").parquet(f"{self.folder}/alerts")

    def status(self, spark: SparkSession) -> DataFrame:
        """Counts per interval, over all batches that had packets of it."""
        sums = self._counts(spark).groupBy("window_start").agg(
            F.sum("packets").alias("packets_analyzed"), F.sum("attacks").alias("potential_attacks_detected"))
        share = status.percentage(F.col("potential_attacks_detected"), F.col("packets_analyzed"))
        return sums.withColumn("attack_percentage", share)

    def left_out(self, spark: SparkSession) -> int:
        """Packets that were left out as repeated or late."""
        return 0 if self.last is None else self._progress(spark, self.last)[2]

    def totals(self, spark: SparkSession, runtime: float | None = None) -> DataFrame:
        """Totals of the run as one row."""
        seen = (F.unix_micros(F.max("last_ts")) - F.unix_micros(F.min("first_ts"))) / 1e6
        sums = self._counts(spark).agg(
            F.coalesce(F.sum("packets"), F.lit(0)).alias("total_packets"),
            F.coalesce(F.sum("attacks"), F.lit(0)).alias("total_attacks"),
            (seen if runtime is None else F.lit(float(runtime))).alias("runtime"))
        return sums.withColumn("attack_percentage", status.percentage(F.col("total_attacks"), F.col("total_packets")))
