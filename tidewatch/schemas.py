"""Table contracts: labelled flows, packets and alerts."""

from __future__ import annotations

from pyspark.sql import types as T

# The 43 columns of a flow file, in file order.
FLOW_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
    "label", "difficulty_level",
]

CATEGORICAL = ["protocol_type", "service", "flag"]

LABEL = "label"
DIFFICULTY = "difficulty_level"

NUMERIC = [c for c in FLOW_COLUMNS if c not in [*CATEGORICAL, LABEL, DIFFICULTY]]

# The 18 features that a single packet yields, in output order.
PACKET_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate",
]


def _flow_type(name: str) -> T.DataType:
    if name in CATEGORICAL or name == LABEL:
        return T.StringType()
    return T.DoubleType() if name.endswith("_rate") else T.LongType()


FLOW_SCHEMA = T.StructType([T.StructField(c, _flow_type(c)) for c in FLOW_COLUMNS])

PACKET_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ip_version", T.IntegerType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("ip_proto", T.IntegerType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("urgptr", T.IntegerType()),
    T.StructField("icmp_type", T.IntegerType()),
    T.StructField("ip_mf", T.BooleanType()),
    T.StructField("ip_frag", T.IntegerType()),
    T.StructField("ip_len", T.IntegerType()),
    T.StructField("frame_len", T.IntegerType()),
])

SCORED_PACKET_SCHEMA = T.StructType([*PACKET_SCHEMA.fields, T.StructField("score", T.DoubleType())])

ALERT_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("alert_message", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destination_ip", T.StringType()),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("flags", T.StringType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("anomaly_score", T.DoubleType()),
])

# The eleven fields an alert line carries, in order.
ALERT_FIELDS = [f.name for f in ALERT_SCHEMA if f.name not in ("packet_id", "ts", "attack_type")]

# The columns that name one direction of a TCP connection.
CONNECTION = ["src_ip", "src_port", "dst_ip", "dst_port"]
