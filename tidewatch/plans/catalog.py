"""Checkable queries: each operator over whole tables, with the SQL that gives the same result.

A query takes (spark, folder) and returns a DataFrame. Times are given as microseconds, ratios are
rounded to six digits. ``SQL`` has an entry wherever SQL can express the operator.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import fixtures as fx
from tidewatch.functions import alerts as a
from tidewatch.functions import packets as p
from tidewatch.functions import scoring
from tidewatch.operators import connections, evaluate, learn, packets, prepare, scans, status
from tidewatch.plans import detection, training
from tidewatch.schemas import ALERT_FIELDS, NUMERIC, SCORED_PACKET_SCHEMA
from tidewatch.session import STATE_STORE, shared_folder
from tidewatch.sources import alerts as alert_files
from tidewatch.sources import flows as flow_files
from tidewatch.sources import packets as packet_files
from tidewatch.sources import params, reports
from tidewatch.streaming import jobs, stateful
from tidewatch.streaming.live import Live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- the fixture tables in SQL --------------------------------------------------------------------

EVENTS = """
ev AS (
  SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
)"""

PACKETS = EVENTS + """,
kinds AS (SELECT *, CASE WHEN event_id % 23 >= 2 THEN k % 20 ELSE 99 END AS m FROM ev),
pk AS (
  SELECT event_id AS packet_id,
    1704067200000000 + event_id * 100000 AS us,
    m < 99 AS ip,
    CASE WHEN m < 99 THEN '10.0.' || (event_id // 4000) || '.' || (user_id % 4)
         WHEN event_id % 23 = 1 THEN 'fd00::' || (user_id % 4) END AS src_ip,
    CASE WHEN m < 99 AND k % 25 = 0 THEN '10.0.' || (event_id // 4000) || '.' || (user_id % 4)
         WHEN m < 99 THEN '10.1.0.' || (k % 8)
         WHEN event_id % 23 = 1 THEN 'fd00::1:' || (k % 8) END AS dst_ip,
    CASE WHEN m < 14 THEN 'tcp' WHEN m < 17 THEN 'udp' WHEN m < 19 THEN 'icmp'
         ELSE 'unknown' END AS proto,
    CASE WHEN m < 14 THEN 1024 + user_id % 16 WHEN m < 17 THEN 5000 END AS src_port,
    CASE WHEN m < 14 THEN
           CASE k % 7 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 21 ELSE 1000 + k END
         WHEN m < 17 THEN CASE WHEN k % 2 = 0 THEN 53 ELSE 161 END END AS dst_port,
    CASE WHEN m < 14 THEN
      CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 41 WHEN 3 THEN 18 WHEN 4 THEN 16
        WHEN 5 THEN 24 WHEN 6 THEN 4 WHEN 7 THEN 43 ELSE 2 END END AS tcp_flags,
    CASE WHEN m < 14 AND k % 11 = 0 THEN 1 ELSE 0 END AS urgent,
    CASE m WHEN 17 THEN 8 WHEN 18 THEN 0 END AS icmp_type,
    CASE WHEN m < 99 AND (k % 13 = 0 OR k % 17 = 0) THEN 1 ELSE 0 END AS fragment,
    CASE WHEN m < 99 AND k % 25 = 0 THEN 1 ELSE 0 END AS land,
    CASE WHEN m < 99 THEN 40 + k ELSE 0 END AS ip_len,
    CASE WHEN k % 50 = 49 THEN 1514 ELSE 54 + k END AS frame_len,
    (k - 40) / 20.0::DOUBLE AS score
  FROM kinds
)"""

FLAG_NAMES = """
CASE WHEN proto = 'tcp' THEN
  CASE WHEN tcp_flags & 63 = 0 THEN 'None' ELSE concat_ws(',',
    CASE WHEN tcp_flags & 1 <> 0 THEN 'FIN' END, CASE WHEN tcp_flags & 2 <> 0 THEN 'SYN' END,
    CASE WHEN tcp_flags & 4 <> 0 THEN 'RST' END, CASE WHEN tcp_flags & 8 <> 0 THEN 'PSH' END,
    CASE WHEN tcp_flags & 16 <> 0 THEN 'ACK' END, CASE WHEN tcp_flags & 32 <> 0 THEN 'URG' END) END
  WHEN proto IN ('udp', 'icmp') THEN 'N/A' END"""

STEALTH = "(proto = 'tcp' AND (tcp_flags IN (0, 1) OR tcp_flags & 41 = 41))"
BARE_SYN = "(proto = 'tcp' AND tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0)"
SERVICE = """
CASE proto WHEN 'tcp' THEN CASE dst_port WHEN 80 THEN 'http' WHEN 443 THEN 'https'
    WHEN 22 THEN 'ssh' WHEN 21 THEN 'ftp' ELSE 'other' END
  WHEN 'udp' THEN CASE dst_port WHEN 53 THEN 'domain' ELSE 'other' END
  WHEN 'icmp' THEN 'ecr_i' ELSE 'other' END"""
FLAG = """
CASE proto WHEN 'tcp' THEN CASE WHEN tcp_flags & 2 <> 0 THEN 'S' WHEN tcp_flags & 16 <> 0 THEN 'A'
    ELSE 'OTH' END WHEN 'udp' THEN 'SF' WHEN 'icmp' THEN 'SF' ELSE 'OTH' END"""


def _scan_sql(scope: str) -> str:
    """CTE ``hits``: the packet ids of port scans among the bare SYNs that meet ``scope``."""
    return f"""
syn AS (SELECT packet_id, us, src_ip, dst_port FROM pk WHERE {BARE_SYN} AND {scope}),
firsts AS (
  SELECT src_ip, dst_port, min(packet_id) AS packet_id, min(us) AS us FROM syn GROUP BY ALL
),
seen AS (SELECT src_ip, min(us) AS first_seen FROM syn GROUP BY src_ip),
nth AS (
  SELECT src_ip, packet_id, row_number() OVER (PARTITION BY src_ip ORDER BY us, packet_id) AS n
  FROM firsts
),
hits AS (
  SELECT syn.packet_id FROM syn JOIN seen USING (src_ip)
  JOIN nth ON nth.src_ip = syn.src_ip AND nth.n = 6 AND syn.packet_id >= nth.packet_id
  WHERE syn.us - first_seen < 30000000
)"""


ATTACK = f"""
CASE WHEN frame_len > 1500 THEN 'POSSIBLE_DOS' WHEN {STEALTH} THEN 'STEALTH_SCAN'
  WHEN packet_id IN (SELECT packet_id FROM hits) THEN 'PORT_SCAN'
  WHEN icmp_type = 8 THEN CASE WHEN src_ip = '10.0.0.1' THEN 'NORMAL' ELSE 'PING_SCAN' END
  ELSE 'ANOMALY' END"""

ALERTS = f"""WITH {PACKETS}, {_scan_sql('score > 0.1')},
typed AS (SELECT *, {ATTACK} AS attack_type, {FLAG_NAMES} AS flags FROM pk WHERE ip AND score > 0.1),
al AS (
  SELECT packet_id, us, attack_type,
    strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS timestamp,
    CASE WHEN attack_type IN ('PORT_SCAN', 'STEALTH_SCAN', 'POSSIBLE_DOS') THEN 'HIGH'
      ELSE 'MEDIUM' END AS severity,
    attack_type || ' detected from ' || src_ip || ' to ' || dst_ip AS alert_message,
    src_ip AS source_ip, src_port AS source_port, dst_ip AS destination_ip,
    dst_port AS destination_port,
    CASE WHEN proto = 'unknown' THEN proto ELSE upper(proto) END AS protocol, flags,
    frame_len AS size, score AS anomaly_score
  FROM typed
)"""


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


# --- packets: row-wise ----------------------------------------------------------------------------


def _packet_query(sql: str, **columns: Callable[[], Column]) -> tuple[Query, str]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fx.packets(spark, folder).select(
            "packet_id", *[c().alias(n) for n, c in columns.items()]
        )

    return run, f"WITH {PACKETS} SELECT packet_id, {sql} FROM pk"


def _register(name: str, pair: tuple[Query, str]) -> None:
    QUERIES[name], SQL[name] = pair


def _int(condition: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: condition().cast("int")


_register("protocol_service_flag", _packet_query(
    f"proto AS protocol_type, {SERVICE} AS service, {FLAG} AS flag",
    protocol_type=p.protocol_type, service=p.service, flag=p.flag,
))
_register("packet_marks", _packet_query(
    """land, fragment AS wrong_fragment, urgent, ip_len AS src_bytes,
    ip_len AS dst_bytes""",
    land=p.land, wrong_fragment=p.wrong_fragment, urgent=p.urgent, src_bytes=p.datagram_bytes,
    dst_bytes=p.datagram_bytes,
))
_register("tcp_flag_names", _packet_query(f"{FLAG_NAMES} AS flags", flags=p.tcp_flag_names))
_register("stealth_scan", _packet_query(
    f"coalesce({STEALTH}, false)::INT AS stealth", stealth=_int(p.is_stealth_scan)
))
_register("bare_syn", _packet_query(
    f"coalesce({BARE_SYN}, false)::INT AS bare_syn", bare_syn=_int(p.is_bare_syn)
))
_register("ping_scan", _packet_query(
    """CASE WHEN icmp_type = 8 THEN CASE WHEN src_ip = '10.0.0.1' THEN 'NORMAL' ELSE 'PING_SCAN' END
    END AS ping""",
    ping=lambda: p.ping_scan(F.col("src_ip") == "10.0.0.1"),
))
_register("large_packet", _packet_query(
    "(frame_len > 1500)::INT AS is_large", is_large=_int(p.is_large_packet)
))
_register("connection_key", _packet_query(
    """CASE WHEN proto = 'tcp' THEN src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port END
    AS connection""",
    connection=p.connection_key,
))
_register("severity", _packet_query(
    f"""CASE WHEN frame_len > 1500 OR {STEALTH} THEN 'HIGH' ELSE 'MEDIUM' END AS severity""",
    severity=lambda: a.severity(a.alert_type(a.attack_type(F.lit(False), F.lit(False)))),
))


@query(f"""WITH {PACKETS} SELECT packet_id, 0 AS duration, proto AS protocol_type,
  {SERVICE} AS service, {FLAG} AS flag, ip_len AS src_bytes, ip_len AS dst_bytes,
  land, fragment AS wrong_fragment, urgent,
  CASE WHEN proto = 'tcp' THEN row_number() OVER (
    PARTITION BY proto, src_ip, src_port, dst_ip, dst_port ORDER BY us, packet_id) ELSE 1 END AS count,
  1 AS srv_count, 0 AS serror_rate, 0 AS srv_serror_rate, 0 AS rerror_rate, 0 AS srv_rerror_rate,
  1 AS same_srv_rate, 0 AS diff_srv_rate, 0 AS srv_diff_host_rate FROM pk""")
def packet_features(spark, folder):
    return packets.packet_features(fx.packets(spark, folder))


@query(f"""WITH {PACKETS} SELECT packet_id,
  strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.') || printf('%03d', (us // 1000) % 1000) AS timestamp,
  CASE WHEN ip THEN src_ip END AS src_ip, CASE WHEN ip THEN dst_ip END AS dst_ip,
  CASE WHEN proto = 'unknown' THEN proto ELSE upper(proto) END AS protocol, src_port, dst_port, {FLAG_NAMES} AS flags, frame_len AS size,
  CASE WHEN frame_len > 1500 THEN 'POSSIBLE_DOS' WHEN {STEALTH} THEN 'STEALTH_SCAN'
    WHEN icmp_type = 8 THEN 'PING_SCAN' ELSE 'unknown' END AS attack_type,
  score AS prediction_score FROM pk""")
def packet_details(spark, folder):
    return packets.packet_details(fx.packets(spark, folder))


@query(f"""WITH {PACKETS} SELECT packet_id, score FROM pk
WHERE ip AND src_ip <> '10.0.0.1' AND dst_ip <> '10.0.0.1'""")
def ip_only(spark, folder):
    kept = packet_files.ip_only(fx.packets(spark, folder), exclude_host="10.0.0.1")
    return kept.select("packet_id", "score")


@query(f"WITH {PACKETS} SELECT packet_id, us FROM pk ORDER BY us, packet_id LIMIT 100")
def first_packets(spark, folder):
    first = packet_files.first_packets(fx.packets(spark, folder), 100)
    return first.select("packet_id", F.unix_micros("ts").alias("us"))


@query(f"WITH {PACKETS} SELECT packet_id, coalesce(src_ip = '10.0.0.1', false)::INT AS trusted FROM pk")
def mark_trusted(spark, folder):
    hosts = spark.createDataFrame([(h,) for h in fx.TRUSTED_HOSTS], "ip string")
    marked = packets.mark_trusted(fx.packets(spark, folder), hosts)
    return marked.select("packet_id", F.col("trusted").cast("int").alias("trusted"))


@query(f"WITH {PACKETS} SELECT packet_id, src_ip FROM pk WHERE src_ip IS DISTINCT FROM '10.0.0.1'")
def untrusted_only(spark, folder):
    hosts = spark.createDataFrame([(h,) for h in fx.TRUSTED_HOSTS], "ip string")
    kept = packets.only_trusted(fx.packets(spark, folder), hosts, keep=False)
    return kept.select("packet_id", "src_ip")


@query(f"WITH {PACKETS} SELECT packet_id, score FROM pk WHERE score > 0.1")
def flag_anomalies(spark, folder):
    found = packets.flag_anomalies(fx.packets(spark, folder), fx.THRESHOLD)
    return found.select("packet_id", "score")


@query(f"WITH {EVENTS} SELECT event_id, k / 100.0::DOUBLE AS score FROM ev WHERE k >= 50")
def flag_probabilities(spark, folder):
    rows = fx.scored(spark, folder).select("event_id", F.col("p").alias("score"))
    return packets.flag_anomalies(rows, 0.5, space="probability")


# --- alerts ---------------------------------------------------------------------------------------


def _alerts(spark: SparkSession, folder: str, **options) -> DataFrame:
    return detection.detect(fx.packets(spark, folder), fx.THRESHOLD, fx.TRUSTED_HOSTS, **options)


def _plain(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("us", F.unix_micros("ts")).drop("ts")


@query(f"{ALERTS} SELECT * FROM al")
def alerts(spark, folder):
    return _plain(_alerts(spark, folder))


@query(f"""{ALERTS} SELECT attack_type, severity, count(*) AS n_alerts,
  count(DISTINCT source_ip) AS n_sources, round(max(anomaly_score), 6) AS top_score
FROM al GROUP BY ALL""")
def alerts_by_severity(spark, folder):
    return _alerts(spark, folder).groupBy("attack_type", "severity").agg(
        F.count("*").alias("n_alerts"),
        F.count_distinct("source_ip").alias("n_sources"),
        r6(F.max("anomaly_score")).alias("top_score"),
    )


@query(ALERTS.replace(_scan_sql("score > 0.1"), _scan_sql("true"))
       + " SELECT packet_id, attack_type, severity FROM al WHERE attack_type <> 'NORMAL'")
def alerts_scope_all(spark, folder):
    found = _alerts(spark, folder, scope="all", drop_normal=True)
    return found.select("packet_id", "attack_type", "severity")


@query(f"""{ALERTS} SELECT strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S,')
  || printf('%03d', (us // 1000) % 1000) || ' [WARNING] ALERT: '
  || '{{"timestamp":"' || timestamp || '","severity":"' || severity || '","alert_message":"'
  || alert_message || '","source_ip":"' || source_ip || '","source_port":'
  || coalesce(source_port::VARCHAR, 'null') || ',"destination_ip":"' || destination_ip
  || '","destination_port":' || coalesce(destination_port::VARCHAR, 'null') || ',"protocol":"'
  || protocol || '","flags":' || coalesce('"' || flags || '"', 'null') || ',"size":' || size
  || ',"anomaly_score":' || anomaly_score || '}}' AS value FROM al""")
def alert_lines(spark, folder):
    return alert_files.alert_lines(_alerts(spark, folder))


@query(f"{ALERTS} SELECT {', '.join(ALERT_FIELDS)}, 'WARNING' AS level FROM al")
def read_alert_lines(spark, folder):
    path = fresh(spark, "alert-lines")
    alert_files.alert_lines(_alerts(spark, folder)).write.text(path)
    return alert_files.read_alert_lines(spark, path).drop("logged_at")


@query(f"{ALERTS} SELECT *, (us // 86400000000)::INT AS day FROM al")
def alert_table(spark, folder):
    path = fresh(spark, "alerts")
    alert_files.write_alerts(_alerts(spark, folder), path)
    stored = alert_files.read_alerts(spark, path)
    return _plain(stored.withColumn("day", F.unix_date("alert_date"))).drop("alert_date")


# --- scans ----------------------------------------------------------------------------------------


@query(f"WITH {PACKETS}, {_scan_sql('true')} SELECT packet_id FROM hits")
def port_scan(spark, folder):
    return scans.port_scan(fx.packets(spark, folder)).filter("port_scan").select("packet_id")


@query(f"""WITH {PACKETS}, {_scan_sql('score > 0.1')} SELECT packet_id,
  (packet_id IN (SELECT packet_id FROM hits))::INT AS port_scan FROM pk WHERE score > 0.1""")
def port_scan_anomalous(spark, folder):
    anomalous = packets.flag_anomalies(fx.packets(spark, folder), fx.THRESHOLD)
    flagged = scans.port_scan(anomalous)
    return flagged.select("packet_id", F.col("port_scan").cast("int").alias("port_scan"))


@query(f"""WITH {PACKETS} SELECT src_ip, min(us) AS first_seen, count(DISTINCT dst_port) AS ports
FROM pk WHERE {BARE_SYN} GROUP BY src_ip""")
def source_scan_summary(spark, folder):
    summary = scans.source_scan_summary(fx.packets(spark, folder))
    return summary.withColumn("first_seen", F.unix_micros("first_seen"))


@query(f"""WITH {PACKETS} SELECT src_ip, min(us) AS first_seen, count(DISTINCT dst_port) AS ports, TRUE AS near
FROM pk WHERE {BARE_SYN} GROUP BY src_ip""")
def port_sketches(spark, folder):
    """Sketches of three parts of the traffic, united: ``near`` if at most four standard errors from the exact number."""
    traffic = fx.packets(spark, folder)
    parts = [scans.port_sketches(traffic.filter(F.col("packet_id") % 3 == i)) for i in range(3)]
    found = scans.sketched_summary(scans.merge_sketches(*parts)).withColumnRenamed("ports", "estimate")
    exact = scans.source_scan_summary(traffic).drop("first_seen")
    near = F.abs(F.col("estimate") - F.col("ports")) <= 4 * 1.04 / 2 ** (scans.SKETCH / 2) * F.col("ports")
    both = found.join(exact, found["src_ip"].eqNullSafe(exact["src_ip"])).drop(exact["src_ip"])
    return both.select("src_ip", F.unix_micros("first_seen").alias("first_seen"), "ports", near.alias("near"))


# --- connections ----------------------------------------------------------------------------------

RUNNING = "OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port ORDER BY us, packet_id)"

EPOCHS = f"""WITH RECURSIVE {PACKETS},
times AS (SELECT DISTINCT src_ip, src_port, dst_ip, dst_port, us FROM pk WHERE proto = 'tcp'),
chain AS (
  SELECT src_ip, src_port, dst_ip, dst_port, min(us) AS start, 1 AS epoch FROM times
  GROUP BY src_ip, src_port, dst_ip, dst_port
  UNION ALL
  SELECT c.src_ip, c.src_port, c.dst_ip, c.dst_port, min(t.us), c.epoch + 1
  FROM chain c JOIN times t ON t.src_ip = c.src_ip AND t.src_port = c.src_port
    AND t.dst_ip = c.dst_ip AND t.dst_port = c.dst_port AND t.us > c.start + 300000000
  GROUP BY c.src_ip, c.src_port, c.dst_ip, c.dst_port, c.epoch
)"""


@query(f"""WITH {PACKETS}
SELECT packet_id, CASE WHEN proto = 'tcp' THEN count(*) {RUNNING.replace('BY src_ip', 'BY proto, src_ip')}
  ELSE 1 END AS count FROM pk""")
def connection_count(spark, folder):
    counted = connections.connection_count(fx.packets(spark, folder))
    return counted.select("packet_id", "count")


@query(f"""{EPOCHS},
placed AS (
  SELECT p.packet_id, p.us, c.src_ip, c.src_port, c.dst_ip, c.dst_port, c.epoch
  FROM pk p ASOF JOIN chain c ON p.src_ip = c.src_ip AND p.src_port = c.src_port
    AND p.dst_ip = c.dst_ip AND p.dst_port = c.dst_port AND p.us >= c.start
  WHERE p.proto = 'tcp'
)
SELECT packet_id, epoch, row_number() OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, epoch
  ORDER BY us, packet_id) AS count FROM placed
UNION ALL SELECT packet_id, 1, 1 FROM pk WHERE proto <> 'tcp'""")
def connection_epochs(spark, folder):
    counted = connections.connection_count(fx.packets(spark, folder), max_age=300)
    return counted.select("packet_id", "epoch", "count")


@query(f"{EPOCHS} SELECT src_ip, src_port, dst_ip, dst_port, epoch, start AS epoch_start FROM chain")
def epoch_starts(spark, folder):
    starts = connections.epoch_starts(fx.packets(spark, folder))
    return starts.withColumn("epoch_start", F.unix_micros("epoch_start"))


@query(f"""WITH {PACKETS}
SELECT packet_id, count(*) {RUNNING} AS count, sum(frame_len) {RUNNING}::BIGINT AS running_bytes
FROM pk WHERE proto = 'tcp'
UNION ALL SELECT packet_id, 1, frame_len FROM pk WHERE proto <> 'tcp'""")
def running_bytes(spark, folder):
    counted = connections.running_bytes(fx.packets(spark, folder))
    return counted.select("packet_id", "count", "running_bytes")


@query(f"""WITH {PACKETS} SELECT src_ip, src_port, dst_ip, dst_port, min(us) AS start_time,
  count(*) AS count, sum(frame_len)::BIGINT AS bytes, min({SERVICE}) AS service
FROM pk WHERE proto = 'tcp' GROUP BY ALL""")
def connection_summary(spark, folder):
    summary = connections.connection_summary(fx.packets(spark, folder))
    return summary.withColumn("start_time", F.unix_micros("start_time"))


@query(f"""WITH {PACKETS}
SELECT packet_id, CASE WHEN proto = 'unknown' THEN proto ELSE upper(proto) END AS protocol,
  {FLAG_NAMES} AS flags, score AS prediction_score FROM pk ORDER BY us DESC, packet_id DESC LIMIT 1000""")
def recent_suspicious(spark, folder):
    recent = packets.recent_suspicious(fx.packets(spark, folder))
    return recent.select("packet_id", "protocol", "flags", "prediction_score")


# --- status ---------------------------------------------------------------------------------------

STATUS = f"""WITH {PACKETS}, st AS (
  SELECT us // 10000000 * 10000000 AS window_start, 10.0::DOUBLE AS runtime,
    count(*) AS packets_analyzed, round(count(*) / 10.0, 6) AS packets_per_second,
    count(*) FILTER (ip AND score > 0.1) AS potential_attacks_detected,
    round(100.0 * count(*) FILTER (ip AND score > 0.1) / count(*), 6) AS attack_percentage
  FROM pk GROUP BY 1
)"""


def _status(status_rows: DataFrame) -> DataFrame:
    return status_rows.select(
        F.unix_micros("window_start").alias("window_start"), "runtime", "packets_analyzed",
        r6("packets_per_second").alias("packets_per_second"), "potential_attacks_detected",
        r6("attack_percentage").alias("attack_percentage"),
    )


@query(f"{STATUS} SELECT * FROM st")
def status_window(spark, folder):
    return _status(status.status_window(fx.packets(spark, folder), fx.THRESHOLD))


@query(f"""{STATUS} SELECT window_start + 10000000 AS logged_us, 'INFO' AS level, runtime,
  packets_analyzed, round(packets_per_second, 1) AS packets_per_second,
  potential_attacks_detected, round(attack_percentage, 2) AS attack_percentage FROM st""")
def status_lines(spark, folder):
    path = fresh(spark, "status-lines")
    rows = status.status_window(fx.packets(spark, folder), fx.THRESHOLD)
    alert_files.status_lines(rows).write.text(path)
    lines = alert_files.read_status_lines(spark, path).drop("remaining_time")
    return lines.withColumn("logged_us", F.unix_micros("logged_at")).drop("logged_at")


@query(f"""WITH {PACKETS} SELECT count(*) AS total_packets, count(*) FILTER (ip AND score > 0.1) AS total_attacks,
  round((max(us) - min(us)) / 1000000.0, 6) AS runtime,
  round(100.0 * count(*) FILTER (ip AND score > 0.1) / count(*), 6) AS attack_percentage FROM pk""")
def run_totals(spark, folder):
    totals = status.run_totals(fx.packets(spark, folder), fx.THRESHOLD)
    return totals.withColumns({c: r6(c) for c in ("runtime", "attack_percentage")})


@query(SQL["run_totals"])
def report_file(spark, folder):
    path = fresh(spark, "report")
    reports.write_report(status.run_totals(fx.packets(spark, folder), fx.THRESHOLD), path)
    totals = spark.read.json(path)
    return totals.withColumns({c: r6(c) for c in ("runtime", "attack_percentage")})


@query(f"""WITH {PACKETS} SELECT packet_id // 100 AS batch_id, count(*) AS packets,
  count(*) FILTER (ip AND score > 0.1) AS anomalies,
  round(100.0 * count(*) FILTER (ip AND score > 0.1) / count(*), 6) AS alert_percentage FROM pk WHERE ip GROUP BY 1""")
def batch_alert_rate(spark, folder):
    batches = fx.packets(spark, folder).withColumn("batch_id", F.expr("packet_id div 100"))
    rates = status.batch_alert_rate(batches, fx.THRESHOLD)
    return rates.withColumn("alert_percentage", r6("alert_percentage"))


# --- flow preparation -----------------------------------------------------------------------------

FLOWS = """
fl AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity AS quantity,
    l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, 7.0 AS constant,
    l_returnflag AS returnflag, l_linestatus AS linestatus,
    CASE WHEN l_returnflag = 'N' THEN 'normal' ELSE l_returnflag END AS label,
    CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE
      ELSE l_quantity END AS raw
  FROM lineitem
)"""

FLOW_KEY = ["l_orderkey", "l_linenumber"]


@query(f"WITH {FLOWS} SELECT label, count(*) AS count FROM fl GROUP BY label")
def label_distribution(spark, folder):
    return evaluate.label_distribution(fx.flows(spark, folder))


@query("""SELECT 'flows' AS table_name, count(*) AS n_rows, 14 AS n_columns FROM lineitem
UNION ALL SELECT 'scores', count(*), 4 FROM events""")
def table_shape(spark, folder):
    return evaluate.table_shape(flows=fx.flows(spark, folder), scores=fx.scored(spark, folder))


@query(f"""WITH {FLOWS} SELECT l_orderkey, l_linenumber, l_shipdate::DATE - DATE '1970-01-01' AS day,
  label, (label <> 'normal')::INT AS binary_label FROM fl""")
def binary_label(spark, folder):
    labelled = prepare.binary_label(fx.flows(spark, folder))
    return labelled.select(
        *FLOW_KEY, F.unix_date(F.col("l_shipdate").cast("date")).alias("day"), "label",
        "binary_label",
    )


@query(f"""WITH {FLOWS} SELECT DISTINCT 'returnflag' AS feature, returnflag AS category FROM fl
UNION ALL SELECT DISTINCT 'linestatus', linestatus FROM fl""")
def fit_vocabulary(spark, folder):
    flows = fx.flows(spark, folder)
    early, late = flows.filter("quantity < 25"), flows.filter("quantity >= 25")
    return prepare.categories([early, late], fx.FLOW_CATEGORICAL)


@query(f"""WITH {FLOWS} SELECT l_orderkey, l_partkey, quantity,
  (linestatus = 'F')::INT AS "linestatus_F", (linestatus = 'O')::INT AS "linestatus_O",
  (returnflag = 'A')::INT AS "returnflag_A", (returnflag = 'N')::INT AS "returnflag_N",
  (returnflag = 'R')::INT AS "returnflag_R" FROM fl""")
def one_hot(spark, folder):
    flows = fx.flows(spark, folder)
    vocabulary = prepare.fit_vocabulary(flows, columns=fx.FLOW_CATEGORICAL)
    hot = prepare.one_hot(flows, vocabulary)
    return hot.select("l_orderkey", "l_partkey", "quantity", *vocabulary.columns)


@query(f"""WITH {FLOWS} SELECT quantity, 0 AS discount, tax, 'left' AS side FROM fl WHERE tax < 0.04
UNION ALL SELECT quantity, discount, 0, 'right' FROM fl WHERE tax >= 0.04""")
def align_features(spark, folder):
    flows = fx.flows(spark, folder)
    left, right = prepare.align_features(
        flows.filter("tax < 0.04").select("quantity", "tax"),
        flows.filter("tax >= 0.04").select("quantity", "discount"),
    )
    sides = [d.withColumn("side", F.lit(n)) for d, n in ((left, "left"), (right, "right"))]
    return sides[0].unionByName(sides[1])


@query(f"WITH {FLOWS} SELECT l_orderkey, tax, 0 AS dst_host_count, quantity FROM fl")
def conform_to(spark, folder):
    features = ["tax", "dst_host_count", "quantity"]
    return prepare.conform_to(fx.flows(spark, folder), features, keep=["l_orderkey"])


_CATEGORIES = f"SELECT proto AS protocol_type, {SERVICE} AS service, {FLAG} AS flag FROM pk"


@query(f"""WITH {PACKETS}, f AS ({_CATEGORIES}), u AS ({_CATEGORIES} WHERE proto <> 'tcp'),
fs AS (SELECT 'protocol_type_' || protocol_type AS c FROM f UNION SELECT 'service_' || service FROM f
  UNION SELECT 'flag_' || flag FROM f),
us AS (SELECT 'protocol_type_' || protocol_type AS c FROM u UNION SELECT 'service_' || service FROM u
  UNION SELECT 'flag_' || flag FROM u)
SELECT 'missing' AS kind, c AS feature FROM fs WHERE c NOT IN (SELECT c FROM us)
UNION ALL SELECT 'extra', c FROM us WHERE c NOT IN (SELECT c FROM fs)""")
def feature_differences(spark, folder):
    traffic = fx.packets(spark, folder)
    categories = traffic.select(
        "ip_proto", *[c().alias(n) for n, c in
                      (("protocol_type", p.protocol_type), ("service", p.service), ("flag", p.flag))]
    )
    return prepare.feature_differences(categories.filter("ip_proto <> 6"), categories)


@query(f"""WITH {FLOWS} SELECT l_orderkey, l_linenumber, quantity, CASE WHEN raw IS NULL THEN 0
  WHEN isinf(raw) THEN 3.4028234663852886e38 ELSE raw END AS raw FROM fl""")
def clean_numeric(spark, folder):
    cleaned = prepare.clean_numeric(fx.flows(spark, folder), ["raw"])
    return cleaned.select(*FLOW_KEY, "quantity", "raw")


SCALER = "WITH " + FLOWS + ", sc AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS pos, '{c}' AS feature, avg({c}) AS mean,
    CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS std FROM fl"""
    for i, c in enumerate(fx.FLOW_NUMERIC)
) + ")"


def _scaler(params: DataFrame) -> DataFrame:
    return params.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(f"{SCALER} SELECT pos, feature, round(mean, 4) AS mean, round(std, 4) AS std FROM sc")
def scaler_params(spark, folder):
    return _scaler(prepare.scaler_params(fx.flows(spark, folder), fx.FLOW_NUMERIC))


@query(SQL["scaler_params"])
def stored_scaler(spark, folder):
    path = fresh(spark, "scaler")
    fitted = prepare.fit_scaler(fx.flows(spark, folder), fx.FLOW_NUMERIC)
    params.save_scaler(spark, fitted, path)
    return _scaler(spark.read.parquet(path))


@query(f"""{SCALER} SELECT l_orderkey, l_partkey, """ + ", ".join(
    f"round(({c} - (SELECT mean FROM sc WHERE feature = '{c}')) / "
    f"(SELECT std FROM sc WHERE feature = '{c}'), 6) + 0 AS {c}" for c in fx.FLOW_NUMERIC
) + " FROM fl")
def apply_scaler(spark, folder):
    flows = fx.flows(spark, folder)
    scaled = prepare.apply_scaler(flows, prepare.fit_scaler(flows, fx.FLOW_NUMERIC))
    return scaled.select(
        "l_orderkey", "l_partkey", *[(r6(c) + 0).alias(c) for c in fx.FLOW_NUMERIC]
    )


@query(f"""WITH {FLOWS}, n AS (
  SELECT (label <> 'normal')::INT AS binary_label, count(*) AS n, sum(count(*)) OVER () AS total
  FROM fl GROUP BY 1
), want AS (
  SELECT *, ceil(total * 0.1) * n / total AS exact, floor(ceil(total * 0.1) * n / total) AS low FROM n
), held AS (
  SELECT binary_label, n, (low + CASE WHEN row_number() OVER (ORDER BY exact - low DESC, binary_label)
    <= ceil(total * 0.1) - sum(low) OVER () THEN 1 ELSE 0 END)::BIGINT AS h FROM want
)
SELECT binary_label, 'holdout' AS split, h AS n FROM held
UNION ALL SELECT binary_label, 'train', n - h FROM held""")
def stratified_split_sizes(spark, folder):
    split = stratified_split(spark, folder)
    return split.groupBy("binary_label", "split").agg(F.count("*").alias("n"))


def _split_sql(key_text: str, columns: str) -> str:
    """Every flow with its split, by md5 of ``key_text``; equal hashes in any order."""
    return f"""WITH {FLOWS}, hashed AS (
  SELECT {columns}, (label <> 'normal')::INT AS binary_label, md5('42|' || {key_text}) AS place FROM fl
), n AS (
  SELECT binary_label, count(*) AS n, sum(count(*)) OVER () AS total FROM hashed GROUP BY 1
), want AS (
  SELECT *, ceil(total * 0.1) * n / total AS exact, floor(ceil(total * 0.1) * n / total) AS low FROM n
), held AS (
  SELECT binary_label, low + CASE WHEN row_number() OVER (ORDER BY exact - low DESC, binary_label)
    <= ceil(total * 0.1) - sum(low) OVER () THEN 1 ELSE 0 END AS h FROM want
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY binary_label ORDER BY place) AS rank FROM hashed
), sides AS (
  SELECT ranked.*, CASE WHEN rank <= h THEN 'holdout' ELSE 'train' END AS split
  FROM ranked JOIN held USING (binary_label)
)"""


@query(_split_sql("l_orderkey || '|' || l_linenumber || '|' || l_partkey", "l_orderkey, l_linenumber, l_partkey")
       + " SELECT l_orderkey, l_linenumber, l_partkey, binary_label, split FROM sides")
def stratified_split(spark, folder):
    flows = prepare.binary_label(fx.flows(spark, folder))
    split = prepare.stratified_split(flows, "binary_label", ["l_orderkey", "l_linenumber", "l_partkey"])
    return split.select("l_orderkey", "l_linenumber", "l_partkey", "binary_label", "split")


@query(_split_sql("returnflag || '|' || linestatus", "returnflag, linestatus")
       + """ SELECT binary_label, returnflag, linestatus, split, count(*) AS n FROM sides GROUP BY ALL""")
def stratified_split_repeated(spark, folder):
    """Keys of a few values only: the limit falls among very many equal rows."""
    flows = prepare.binary_label(fx.flows(spark, folder))
    split = prepare.stratified_split(flows, "binary_label", fx.FLOW_CATEGORICAL)
    return split.groupBy("binary_label", *fx.FLOW_CATEGORICAL, "split").agg(F.count("*").alias("n"))


@query(f"""WITH {FLOWS} SELECT DISTINCT returnflag, linestatus, label,
  (SELECT count(*) FROM (SELECT DISTINCT returnflag FROM fl) x WHERE x.returnflag < fl.returnflag) AS first,
  (SELECT count(*) FROM (SELECT DISTINCT linestatus FROM fl) y WHERE y.linestatus < fl.linestatus)
  + (SELECT count(DISTINCT returnflag) FROM fl) AS second FROM fl""")
def one_hot_vector(spark, folder):
    flows = fx.flows(spark, folder).select("returnflag", "linestatus", "label")
    hot = prepare.one_hot_vector(flows, columns=fx.FLOW_CATEGORICAL)
    at = F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda i: F.get("v", i) == 1)
    places = hot.withColumn("v", vector_to_array("categories")).withColumn("at", at)
    return places.select("returnflag", "linestatus", "label", F.col("at")[0].alias("first"),
                         F.col("at")[1].alias("second")).distinct()


@query(f"""WITH {FLOWS},
cells AS (SELECT 'returnflag' AS feature, returnflag AS category FROM fl
  UNION ALL SELECT 'linestatus', linestatus FROM fl),
counts AS (SELECT feature, category, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM fl) AS mean
  FROM cells WHERE category IS NOT NULL GROUP BY feature, category)
SELECT feature, category, row_number() OVER (ORDER BY feature DESC, category) - 1 AS place, round(mean, 6) AS mean,
  round(CASE WHEN mean = 1 THEN 1 ELSE sqrt(mean * (1 - mean)) END, 6) AS std FROM counts""")
def category_scaler(spark, folder):
    flows = fx.flows(spark, folder)
    places = prepare.category_places(flows, columns=fx.FLOW_CATEGORICAL)
    scaled = prepare.category_scaler(flows, places, fx.FLOW_CATEGORICAL)
    return scaled.select("feature", "category", "place", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {FLOWS} SELECT l_orderkey, l_linenumber, quantity, tax FROM fl")
def assemble(spark, folder):
    flows = fx.flows(spark, folder).select("l_orderkey", "l_linenumber", "quantity", "tax")
    packed = prepare.assemble(flows, ["quantity", "tax"]).withColumn("v", vector_to_array("features"))
    return packed.select("l_orderkey", "l_linenumber", F.col("v")[0].alias("quantity"), F.col("v")[1].alias("tax"))


@query(f"WITH {FLOWS} SELECT l_orderkey, l_linenumber, label FROM fl")
def drop_columns(spark, folder):
    flows = fx.flows(spark, folder).select("l_orderkey", "l_linenumber", "label")
    return prepare.drop_columns(flows.withColumn("difficulty_level", F.lit(1)))


# --- evaluation -----------------------------------------------------------------------------------

SCORES = EVENTS + """,
sd AS (
  SELECT event_id, k, k / 100.0::DOUBLE AS p, (k - 40) / 20.0::DOUBLE AS z,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM ev
)"""

RATES = """
  CASE WHEN tn + fp + fn + tp > 0 THEN round((tp + tn) / (tn + fp + fn + tp), 6) ELSE 0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1,
  CASE WHEN fn + tp > 0 THEN round(fn / (fn + tp), 6) ELSE 0 END AS fnr,
  CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) ELSE 0 END AS fpr"""

CELLS = """count(*) FILTER (k < cut AND y = 0) AS tn, count(*) FILTER (k >= cut AND y = 0) AS fp,
  count(*) FILTER (k < cut AND y = 1) AS fn, count(*) FILTER (k >= cut AND y = 1) AS tp"""

SWEEP = f"""WITH {SCORES}, sw AS (
  SELECT cut, {CELLS} FROM sd, (SELECT unnest(range(10, 91)) AS cut) GROUP BY cut
), rates AS (SELECT round(cut / 100.0, 2) AS threshold, tn, fp, fn, tp, {RATES} FROM sw)"""

AT_HALF = f"WITH {SCORES}, cm AS (SELECT {CELLS.replace('cut', '50')} FROM sd)"

RATE_NAMES = ["accuracy", "precision", "recall", "f1", "fnr", "fpr"]


def _rounded(rates: DataFrame, *names: str) -> DataFrame:
    return rates.withColumns({n: r6(n) for n in names or RATE_NAMES})


@query(f"""WITH {SCORES} SELECT count(*) FILTER (y = 0) AS negatives, count(*) FILTER (y = 1) AS positives,
  round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1), 6) AS pos_weight FROM sd""")
def class_weight(spark, folder):
    return _rounded(evaluate.class_weight(fx.scored(spark, folder)), "pos_weight")


@query(f"""WITH {SCORES} SELECT round(avg(4.0 * y * ln(1 + exp(-z)) + (1 - y) * ln(1 + exp(z))), 6) AS loss
FROM sd""")
def weighted_log_loss(spark, folder):
    return _rounded(evaluate.weighted_log_loss(fx.scored(spark, folder), 4.0), "loss")


@query(f"WITH {SCORES} SELECT event_id, round(1 / (1 + exp(-z)), 6) AS p FROM sd")
def sigmoid(spark, folder):
    return fx.scored(spark, folder).select("event_id", r6(scoring.sigmoid(F.col("z"))).alias("p"))


@query(f"{AT_HALF} SELECT tn, fp, fn, tp FROM cm")
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(fx.scored(spark, folder), 0.5)


@query(f"{AT_HALF} SELECT tn, fp, fn, tp, {RATES} FROM cm")
def metrics(spark, folder):
    return _rounded(evaluate.metrics(fx.scored(spark, folder), 0.5))


@query(f"{AT_HALF}, r AS (SELECT {RATES} FROM cm) SELECT f1 FROM r")
def f1_at_half(spark, folder):
    return _rounded(evaluate.f1_at(fx.scored(spark, folder), 0.5), "f1")


@query(f"{SWEEP} SELECT * FROM rates")
def threshold_sweep(spark, folder):
    return _rounded(evaluate.threshold_sweep(fx.scored(spark, folder)))


BEST = "ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, threshold LIMIT 1"


@query(f"{SWEEP} SELECT * FROM rates {BEST}")
def best_threshold(spark, folder):
    sweep = evaluate.threshold_sweep(fx.scored(spark, folder))
    return _rounded(evaluate.best_threshold(sweep))


@query(f"{SWEEP} SELECT tp, fp, tn, fn, fpr, fnr FROM rates {BEST}")
def final_report(spark, folder):
    return _rounded(training.evaluate_scores(fx.scored(spark, folder)).report, "fpr", "fnr")


@query(f"""{SWEEP}, best AS (SELECT * FROM rates {BEST})
SELECT event_id, round(p - threshold, 6) + 0 AS margin, (k >= threshold * 100 - 0.5)::INT AS hit
FROM sd, best""")
def with_params(spark, folder):
    scores = fx.scored(spark, folder)
    best = evaluate.best_threshold(evaluate.threshold_sweep(scores)).select("threshold")
    threshold = best.scalar()
    hit = scoring.exceeds(F.col("p"), threshold, "probability")
    margin = (r6(F.col("p") - threshold) + 0).alias("margin")
    return scores.select("event_id", margin, hit.cast("int").alias("hit"))


CURVE = f"""WITH {SCORES}, g AS (
  SELECT p AS threshold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sd GROUP BY p
), cu AS (
  SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g
)"""


@query(f"""{CURVE} SELECT threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM cu
UNION ALL SELECT NULL, 0, 0""")
def roc_curve(spark, folder):
    curve = evaluate.roc_curve(fx.scored(spark, folder), drop_intermediate=False)
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return _rounded(curve.withColumn("threshold", finite), "fpr", "tpr")


@query(f"""{CURVE}, steps AS (
  SELECT *, lag(pos) OVER w AS pos0, lead(pos) OVER w AS pos1, lead(neg) OVER w AS neg1 FROM cu
  WINDOW w AS (ORDER BY threshold DESC)
) SELECT threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM steps
WHERE pos0 IS NULL OR pos1 IS NULL OR pos <> pos1 OR neg <> neg1 UNION ALL SELECT NULL, 0, 0""")
def roc_curve_corners(spark, folder):
    """The default form: no points between others on a straight line."""
    curve = evaluate.roc_curve(fx.scored(spark, folder))
    finite = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return _rounded(curve.withColumn("threshold", finite), "fpr", "tpr")


MISSING = CURVE.replace("SELECT p AS threshold", """SELECT
    CASE WHEN event_id % 5 < 2 THEN '-inf'::DOUBLE ELSE p END AS threshold""").replace(
    "FROM sd GROUP BY p", "FROM sd GROUP BY 1")


@query(f"""{MISSING} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall,
  round(fp / n, 6) AS fpr FROM cu""")
def curves_with_missing_scores(spark, folder):
    """Null and NaN scores reach the lowest threshold only."""
    gone = F.when(F.col("event_id") % 5 == 1, float("nan"))
    scores = fx.scored(spark, folder).withColumn("p", F.when(F.col("event_id") % 5 < 2, gone).otherwise(F.col("p")))
    roc = evaluate.roc_curve(scores, drop_intermediate=False).filter("threshold < double('inf')")
    pr = evaluate.pr_curve(scores).filter("threshold is not null")
    both = pr.join(roc.select("threshold", "fpr"), "threshold")
    return _rounded(both, "precision", "recall", "fpr")


@query(f"""{CURVE}, b AS (
  SELECT fp / n AS x, tp / p AS y, lag(fp / n, 1, 0) OVER (ORDER BY threshold DESC) AS x0,
    lag(tp / p, 1, 0) OVER (ORDER BY threshold DESC) AS y0 FROM cu
) SELECT round(sum((x - x0) * (y + y0) / 2), 6) AS auc FROM b""")
def roc_auc(spark, folder):
    return _rounded(evaluate.auc(fx.scored(spark, folder)), "auc")


@query(f"""{CURVE} SELECT threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall
FROM cu UNION ALL SELECT NULL, 1, 0""")
def pr_curve(spark, folder):
    return _rounded(evaluate.pr_curve(fx.scored(spark, folder)), "precision", "recall")


@query(f"{CURVE} SELECT round(sum(pos / p * (tp / (tp + fp))), 6) AS average_precision FROM cu")
def average_precision(spark, folder):
    return _rounded(evaluate.average_precision(fx.scored(spark, folder)), "average_precision")


# --- learning -------------------------------------------------------------------------------------

# A small scaler for packets, with one input that packets do not have.
PACKET_SCALER = prepare.Scaler(
    ["duration", "src_bytes", "count", "dst_host_count", "flag_A", "flag_S", "protocol_type_tcp",
     "service_http"],
    [0.0, 90.0, 2.0, 16.0, 0.25, 0.5, 0.5, 0.125],
    [1.0, 32.0, 4.0, 64.0, 0.5, 0.5, 0.5, 0.25],
)


def _vectors(spark, folder, **options) -> DataFrame:
    features = packets.packet_features(fx.packets(spark, folder))
    encoded = learn.encode_packets(features, PACKET_SCALER, **options)
    columns = [F.col("vector")[i].alias(f) for i, f in enumerate(PACKET_SCALER.features)]
    return encoded.select("packet_id", *columns)


def _vector_sql(compat: bool) -> str:
    dummy = (lambda test: "0") if compat else (lambda test: f"coalesce({test}, false)::INT")
    values = [
        "0", "ip_len",
        "CASE WHEN proto = 'tcp' THEN row_number() " + RUNNING.replace("BY src_ip", "BY proto, src_ip")
        + " ELSE 1 END", "0",
        dummy("proto = 'tcp' AND tcp_flags & 2 = 0 AND tcp_flags & 16 <> 0"),
        dummy("proto = 'tcp' AND tcp_flags & 2 <> 0"), dummy("proto = 'tcp'"),
        dummy("proto = 'tcp' AND dst_port = 80"),
    ]
    s = PACKET_SCALER
    columns = [
        f"(({v}) - {m}::DOUBLE) / {d}::DOUBLE AS {f}"
        for v, f, m, d in zip(values, s.features, s.means, s.stds)
    ]
    return f"WITH {PACKETS} SELECT packet_id, {', '.join(columns)} FROM pk"


@query(_vector_sql(False))
def encode_packets(spark, folder):
    return _vectors(spark, folder)


@query(_vector_sql(True))
def encode_packets_compat(spark, folder):
    return _vectors(spark, folder, compat=True)


def _ruled_network(inputs: int) -> learn.DenseNetwork:
    """A network whose weights follow from their positions, so that SQL can state them too."""
    widths = [inputs, *learn.HIDDEN, 1]
    layers, norms = [], []
    for i, (n_in, n_out) in enumerate(zip(widths, widths[1:])):
        o = np.arange(n_out)
        grid = (o[:, None] * 7 + np.arange(n_in) * 3 + i * 5) % 5 - 2.0
        layers.append((grid, o % 3 - 1.0))
        if n_out > 1:
            norms.append((1.0 + o % 2, o % 5 - 2.0, o % 4 * 1.0, 1.0 + o % 3))
    return learn.DenseNetwork(layers, norms)


def _layer_sql(i: int, n_in: int, n_out: int, source: str) -> str:
    product = f"""list_sum(list_transform(range(0, {n_in}),
      lambda j: x[j + 1] * ((o * 7 + j * 3 + {i * 5}) % 5 - 2))) + (o % 3 - 1)"""
    if n_out > 1:
        product = f"""(greatest({product}, 0) - o % 4) / sqrt(1 + o % 3 + 1e-5) * (1 + o % 2)
      + (o % 5 - 2)"""
    return f"""n{i} AS (SELECT vec_id, list_transform(range(0, {n_out}), lambda o: {product}) AS x
  FROM {source})"""


DENSE = "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), " + ", ".join(
    _layer_sql(i, n_in, n_out, "n" if i == 0 else f"n{i - 1}")
    for i, (n_in, n_out) in enumerate(zip([64, *learn.HIDDEN], [*learn.HIDDEN, 1]))
)


@query(f"{DENSE} SELECT vec_id, round(x[1], 4) AS score FROM n3")
def dense_score(spark, folder):
    path = fresh(spark, "network")
    params.save_network(spark, _ruled_network(64), path)
    vectors = fx.table(spark, folder, "embeddings").select("vec_id", "embedding")
    scored = learn.score_dense_network(vectors, params.load_network(spark, path), "embedding")
    return scored.select("vec_id", F.round("score", 4).alias("score"))


UNSCORED = _vector_sql(False).replace(f"WITH {PACKETS} SELECT packet_id, ", "SELECT packet_id AS vec_id, [").replace(
    " FROM pk", "] AS x FROM pk WHERE ip")
UNSCORED = re.sub(r" AS (?:" + "|".join(PACKET_SCALER.features) + r")(?=[,\]])", "", UNSCORED)
UNSCORED_LAYERS = ", ".join(
    _layer_sql(i, n_in, n_out, "n" if i == 0 else f"n{i - 1}")
    for i, (n_in, n_out) in enumerate(zip([8, *learn.HIDDEN], [*learn.HIDDEN, 1]))
)
UNSCORED_ALERTS = (
    ALERTS.replace(PACKETS, PACKETS.replace("pk AS (", "pk0 AS (") + f""", n AS ({UNSCORED.replace("FROM pk ", "FROM pk0 ")}),
{UNSCORED_LAYERS}, pk AS (
  SELECT pk0.* EXCLUDE (score), n3.x[1] AS score FROM pk0 JOIN n3 ON n3.vec_id = pk0.packet_id
)""")
)


@query(f"""{UNSCORED_ALERTS} SELECT packet_id, attack_type, severity, source_ip, destination_port,
  round(anomaly_score, 4) AS anomaly_score FROM al""")
def detect_unscored(spark, folder):
    """Packets without a score, through features, encoding and network to alerts."""
    traffic = fx.packets(spark, folder).drop("score")
    scored = detection.score_packets(traffic, PACKET_SCALER, _ruled_network(8), max_age=None)
    found = detection.detect(scored, fx.THRESHOLD, fx.TRUSTED_HOSTS)
    return found.select("packet_id", "attack_type", "severity", "source_ip", "destination_port",
                        F.round("anomaly_score", 4).alias("anomaly_score"))


# With one input of 0 or 1 the weighted logistic fit has a closed form: the log odds of either half.
HALVES = f"""WITH {FLOWS}, rows AS (
  SELECT (label <> 'normal')::INT AS y, (quantity > 25)::INT AS x, year(l_shipdate::DATE) >= 2000 AS test FROM fl
), n AS (
  SELECT count(*) FILTER (y = 0 AND x = 0) AS a, count(*) FILTER (y = 1 AND x = 0) AS b,
    count(*) FILTER (y = 0 AND x = 1) AS c, count(*) FILTER (y = 1 AND x = 1) AS d FROM rows WHERE NOT test
), fit AS (
  SELECT ln(((a + c) / (b + d)) * (b / a)) AS intercept, ln((d / c) / (b / a)) AS coefficient FROM n
), scored AS (SELECT y, x, intercept + coefficient * x AS z FROM rows, fit WHERE test),
predicted AS (SELECT y AS binary_label, round(z, 3) AS z, round(1 / (1 + exp(-z)), 4) AS p,
  1 / (1 + exp(-z)) AS exact FROM scored)"""


def _halves(spark, folder) -> training.Prepared:
    flows = fx.flows(spark, folder).withColumn("half", (F.col("quantity") > 25).cast("int"))
    rows = flows.select("half", "label", (F.year("l_shipdate") >= 2000).alias("test"))
    parts = [rows.filter(F.col("test") == t).drop("test") for t in (False, True)]
    return training.prepare_flows(*parts, ["half"], [])


EXACT = {"maxIter": 200, "tol": 1e-12}


@query(f"{HALVES} SELECT 0 AS pos, round(coefficient, 3) AS coefficient FROM fit "
       "UNION ALL SELECT 1, round(intercept, 3) FROM fit")
def train_classifier(spark, folder):
    prepared = _halves(spark, folder)
    model = learn.train_classifier(prepared.train, **EXACT)
    slope = float(model.coefficients[0]) / prepared.scaler.stds[0]
    start = float(model.intercept) - slope * prepared.scaler.means[0]
    rows = spark.createDataFrame([(0, slope), (1, start)], "pos int, coefficient double")
    return rows.withColumn("coefficient", F.round("coefficient", 3))


@query(f"{HALVES} SELECT binary_label, z, p FROM predicted")
def predict_test(spark, folder):
    prepared = _halves(spark, folder)
    model = learn.train_classifier(prepared.train, **EXACT)
    scored = learn.predict(model, prepared.test)
    return scored.select("binary_label", F.round("z", 3).alias("z"), F.round("p", 4).alias("p"))


@query(f"""{HALVES}, sw AS (
  SELECT cut / 100.0 AS threshold,
    count(*) FILTER (exact < cut / 100.0 AND binary_label = 0) AS tn,
    count(*) FILTER (exact >= cut / 100.0 AND binary_label = 0) AS fp,
    count(*) FILTER (exact < cut / 100.0 AND binary_label = 1) AS fn,
    count(*) FILTER (exact >= cut / 100.0 AND binary_label = 1) AS tp
  FROM predicted, (SELECT unnest(range(10, 91)) AS cut) GROUP BY cut
), rates AS (SELECT threshold, tn, fp, fn, tp, {RATES} FROM sw)
SELECT round(threshold, 2) AS threshold, tp, fp, tn, fn, fpr, fnr FROM rates
ORDER BY f1 DESC, threshold LIMIT 1""")
def evaluate_test(spark, folder):
    prepared = _halves(spark, folder)
    model = learn.train_classifier(prepared.train, **EXACT)
    scored = learn.predict(model, prepared.test)
    evaluation = training.evaluate_scores(scored, "p", "binary_label")
    report = evaluation.report.withColumn("threshold", F.lit(round(evaluation.threshold, 2)))
    return report.withColumns({"fpr": r6("fpr"), "fnr": r6("fnr")})


@query(f"""{HALVES} SELECT 0 AS epoch, round(-(q * ln(q) + (1 - q) * ln(1 - q)), 6) AS train_loss
FROM (SELECT (b + d) / (a + b + c + d) AS q FROM n)""")
def training_history(spark, folder):
    """The loss before the first step: that of the share of positives, told to every row."""
    model = learn.train_classifier(_halves(spark, folder).train, pos_weight=1.0, **EXACT)
    history = learn.training_history(spark, model).filter("epoch = 0")
    return history.select("epoch", r6("train_loss").alias("train_loss"))


@query(f"""{HALVES.replace("WITH", "WITH RECURSIVE", 1)}, val AS (
  SELECT count(*) FILTER (y = 0 AND x = 0) AS va, count(*) FILTER (y = 1 AND x = 0) AS vb,
    count(*) FILTER (y = 0 AND x = 1) AS vc, count(*) FILTER (y = 1 AND x = 1) AS vd FROM rows WHERE test
), shares AS (SELECT *, (a + c) / (b + d) AS w, w * b / (a + w * b) AS q0, w * d / (c + w * d) AS q1 FROM n, val),
steps AS (
  SELECT 1 AS epoch, 2 * q0 - 1 AS f0, 2 * q1 - 1 AS f1 FROM shares UNION ALL
  SELECT epoch + 1, f0 + 0.1 * (4 * q0 / (1 + exp(2 * f0)) - 4 * (1 - q0) / (1 + exp(-2 * f0))),
    f1 + 0.1 * (4 * q1 / (1 + exp(2 * f1)) - 4 * (1 - q1) / (1 + exp(-2 * f1)))
  FROM steps, shares WHERE epoch <= 8
), margins AS (SELECT *, (f0 >= 0)::INT AS h0, (f1 >= 0)::INT AS h1, ln(1 + exp(2 * f0)) AS n0, ln(1 + exp(-2 * f0)) AS p0,
  ln(1 + exp(2 * f1)) AS n1, ln(1 + exp(-2 * f1)) AS p1 FROM steps, shares)
SELECT epoch, round((a * n0 + w * b * p0 + c * n1 + w * d * p1) / (a + b + c + d), 6) AS train_loss,
  round((va * n0 + w * vb * p0 + vc * n1 + w * vd * p1) / (va + vb + vc + vd), 6) AS val_loss,
  round(coalesce(2 * (b * h0 + d * h1) / nullif((b + a) * h0 + (d + c) * h1 + b + d, 0), 0), 6) AS train_f1,
  round(coalesce(2 * (vb * h0 + vd * h1) / nullif((vb + va) * h0 + (vd + vc) * h1 + vb + vd, 0), 0), 6) AS val_f1
FROM margins""")
def training_epochs(spark, folder):
    """Loss and F1 of training and validation rows after each boosted tree; the validation rows are the test set."""
    prepared = _halves(spark, folder)
    train = prepared.train.drop("split")
    weight = evaluate.class_weight(train, "binary_label").first()["pos_weight"]
    model = learn.train_classifier(train, pos_weight=weight, algorithm="gbt", maxIter=9, maxDepth=1, stepSize=0.1)
    rows = train.withColumn("held", F.lit(False)).unionByName(prepared.test.withColumn("held", F.lit(True)))
    figures = learn.epoch_history(model, rows, "held", weight)
    return figures.select("epoch", *[r6(c).alias(c) for c in ("train_loss", "val_loss", "train_f1", "val_f1")])


@query(f"{HALVES} SELECT binary_label, z, p FROM predicted")
def stored_model(spark, folder):
    """The test set scored by a model that has been stored and read back."""
    prepared = _halves(spark, folder)
    path = fresh(spark, "model")
    params.save_model(learn.train_classifier(prepared.train, **EXACT), path)
    scored = learn.predict(params.load_model(path), prepared.test)
    return scored.select("binary_label", F.round("z", 3).alias("z"), F.round("p", 4).alias("p"))


_WIDE = {
    **{c: c for c in fx.FLOW_NUMERIC},
    **{f"linestatus_{v}": f"(linestatus = '{v}')::INT" for v in ("F", "O")},
}


@query(f"""WITH {FLOWS}, parts AS (SELECT *, year(l_shipdate::DATE) >= 2000 AS test FROM fl), tr AS (
  SELECT * FROM parts WHERE NOT test
) SELECT (label <> 'normal')::INT AS binary_label, """ + ", ".join(
    f"""round(({x} - (SELECT avg({x}) FROM tr)) / (SELECT CASE WHEN stddev_pop({x}) = 0 THEN 1
    ELSE stddev_pop({x}) END FROM tr), 4) + 0 AS "{n}" """ for n, x in _WIDE.items()
) + " FROM parts WHERE test")
def prepare_flows(spark, folder):
    """Labels, numbers and dummies of the test set as one scaled vector each."""
    flows = fx.flows(spark, folder).drop("raw")
    test = flows.filter(F.year("l_shipdate") >= 2000)
    train = flows.filter(F.year("l_shipdate") < 2000)
    # The label is the return flag itself, so the inputs are the line status and the numbers.
    prepared = training.prepare_flows(train, test, fx.FLOW_NUMERIC, ["linestatus"])
    values = prepared.test.withColumn("v", vector_to_array("features"))
    return values.select("binary_label", *[
        (F.round(F.col("v")[i], 4) + 0).alias(n) for i, n in enumerate(prepared.scaler.features)])


# --- files ----------------------------------------------------------------------------------------


@query(f"""WITH {FLOWS} SELECT quantity::BIGINT AS duration, returnflag AS flag, tax AS serror_rate, label
FROM fl""")
def flow_file(spark, folder):
    path = fresh(spark, "flows")
    flows = fx.flows(spark, folder).select(
        F.col("quantity").cast("long").alias("duration"),
        F.col("returnflag").alias("flag"),
        F.col("tax").alias("serror_rate"),
        "label",
    )
    given = {"flag", "label", "protocol_type", "service"}
    filled = flows.withColumns({
        **{c: F.lit(0) for c in [*NUMERIC, "difficulty_level"] if c not in flows.columns},
        **{c: F.lit("x") for c in given - set(flows.columns)},
    })
    flow_files.write_flows(filled, path)
    stored = flow_files.read_flows(spark, path)
    return stored.select("duration", "flag", "serror_rate", "label")


@query(f"""WITH {PACKETS} SELECT packet_id, us, src_ip, dst_ip, src_port, dst_port, tcp_flags, icmp_type,
  CASE WHEN ip THEN ip_len END AS ip_len, frame_len FROM pk""")
def packet_file(spark, folder):
    path = fresh(spark, "packets")
    fx.packets(spark, folder).drop("score").write.parquet(path)
    stored = packet_files.read_packets(spark, path)
    return stored.select(
        "packet_id", F.unix_micros("ts").alias("us"), "src_ip", "dst_ip", "src_port", "dst_port",
        "tcp_flags", "icmp_type", "ip_len", "frame_len",
    )


# --- streams --------------------------------------------------------------------------------------


def _streamed(
    spark: SparkSession, folder: str, slices: int = 4, files: int = 2, repeats: bool = False
) -> DataFrame:
    """The packets as a stream of files, one slice of time per micro-batch.

    Slices are written one after another, since a stream takes files by age. ``repeats`` gives every
    tenth packet a second time in its slice.
    """
    path = fresh(spark, "stream")
    traffic = fx.packets(spark, folder)
    first, last = traffic.agg(F.min("packet_id"), F.max("packet_id")).first()
    if repeats:
        times = F.when(F.col("packet_id") % 10 == 0, 2).otherwise(1)
        traffic = traffic.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")
    for i in range(slices):
        upto = first + (last - first + 1) * (i + 1) // slices
        start = first + (last - first + 1) * i // slices
        part = traffic.filter((F.col("packet_id") >= start) & (F.col("packet_id") < upto))
        part.repartition(files).write.mode("append").parquet(path)
    streaming = spark.newSession()
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in {**STATE_STORE, "spark.sql.shuffle.partitions": shuffles}.items():
        streaming.conf.set(key, value)
    return packet_files.stream_packets(streaming, path, SCORED_PACKET_SCHEMA, max_files=files)


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    return stateful.in_event_time(_streamed(spark, folder), unique=True)


def _drained(spark: SparkSession, stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """Everything a stream gives, read back after it has ended."""
    path = fresh(spark, "stream-out")
    started = jobs.start(stream, path, fresh(spark, "stream-state"), output_mode, available_now=True)
    jobs.run_bounded(started)
    return jobs.written(spark, path, stream.schema)


@query(SQL["status_window"])
def stream_status(spark, folder):
    repeated = stateful.in_event_time(_streamed(spark, folder, repeats=True))
    counts = jobs.stream_status(repeated, fx.THRESHOLD)
    rows = _drained(spark, counts, "update")
    return _status(jobs.latest(rows, "window_start", "window_end"))


@query(f"{ALERTS} SELECT * FROM al")
def stream_alerts(spark, folder):
    found = jobs.stream_alerts(_timed(spark, folder), fx.THRESHOLD, fx.TRUSTED_HOSTS)
    return _plain(_drained(spark, found).drop("batch_id"))


@query(SQL["port_scan"])
def stream_port_scan(spark, folder):
    flagged = stateful.stream_port_scan(_timed(spark, folder))
    return _drained(spark, flagged).filter("port_scan").select("packet_id")


@query(SQL["connection_epochs"].replace("SELECT packet_id, epoch, row", "SELECT packet_id, row")
       .replace("SELECT packet_id, 1, 1 ", "SELECT packet_id, 1 "))
def stream_connection_count(spark, folder):
    counted = stateful.stream_connection_count(_timed(spark, folder))
    return _drained(spark, counted).select("packet_id", "count")


def _live(spark: SparkSession, folder: str) -> tuple[Live, SparkSession]:
    """A finished live run over packets without scores."""
    stream = _streamed(spark, folder).drop("score")
    live = Live(fresh(spark, "live"), PACKET_SCALER, _ruled_network(8), fx.THRESHOLD, fx.TRUSTED_HOSTS, max_age=None, forget=None)
    live.run(stream)
    return live, spark


@query(SQL["detect_unscored"])
def stream_scored_alerts(spark, folder):
    """Raw packets as a stream, through counts, encoding and network to alerts."""
    live, _ = _live(spark, folder)
    return live.alerts(spark).select(
        "packet_id", "attack_type", "severity", "source_ip", "destination_port",
        F.round("anomaly_score", 4).alias("anomaly_score"))


@query(UNSCORED_ALERTS.split("typed AS (")[0].rstrip().rstrip(",") + """
SELECT (SELECT count(*) FROM pk0) AS total_packets, count(*) FILTER (score > 0.1) AS total_attacks,
  (SELECT round((max(us) - min(us)) / 1000000.0, 6) FROM pk0) AS runtime,
  round(100.0 * count(*) FILTER (score > 0.1) / (SELECT count(*) FROM pk0), 6) AS attack_percentage FROM pk""")
def bounded_report(spark, folder):
    """The report that a live run writes at its end."""
    live, _ = _live(spark, folder)
    totals = spark.read.json(f"{live.folder}/report")
    return totals.withColumns({c: r6(c) for c in ("runtime", "attack_percentage")})
