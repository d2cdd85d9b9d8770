import pytest
from packet_rows import icmp, packet, udp
from pyspark.sql import functions as F

from tidewatch.functions import alerts as a
from tidewatch.functions import packets as p
from tidewatch.operators import packets
from tidewatch.schemas import PACKET_FEATURES
from tidewatch.sources.packets import first_packets, ip_only


def values(df, column):
    """The column's value per row, in order of packet id."""
    return [r[0] for r in df.orderBy("packet_id").select(column).collect()]


def other(**changes):
    none = dict(src_port=None, dst_port=None, tcp_flags=None, urgptr=None)
    return packet(**{"ip_proto": 47, **none, **changes})


def not_ip():
    none = dict(src_ip=None, dst_ip=None, ip_proto=None, src_port=None, dst_port=None)
    return packet(ip_version=None, tcp_flags=None, ip_len=None, **none)


def test_protocol_service_flag(make):
    df = make([
        packet(dst_port=80), packet(dst_port=443, tcp_flags=18), packet(dst_port=22, tcp_flags=16),
        packet(dst_port=21, tcp_flags=4), packet(dst_port=81, tcp_flags=0), udp(dst_port=53),
        udp(dst_port=80), icmp(), other(), not_ip(), packet(ip_version=6),
    ])
    assert values(df, p.protocol_type()) == ["tcp"] * 5 + ["udp"] * 2 + ["icmp"] + ["unknown"] * 3
    assert values(df, p.service()) == [
        "http", "https", "ssh", "ftp", "other", "domain", "other", "ecr_i", "other", "other", "other"
    ]
    assert values(df, p.flag()) == [
        "S", "S", "A", "OTH", "OTH", "SF", "SF", "SF", "OTH", "OTH", "OTH"
    ]


def test_marks(make):
    df = make([
        packet(src_ip="10.0.0.1", dst_ip="10.0.0.1"), packet(ip_mf=True), packet(ip_frag=8),
        packet(urgptr=3), udp(urgptr=3), packet(), not_ip(),
    ])
    assert values(df, p.land()) == [1, 0, 0, 0, 0, 0, 0]
    assert values(df, p.wrong_fragment()) == [0, 1, 1, 0, 0, 0, 0]
    assert values(df, p.urgent()) == [0, 0, 0, 1, 0, 0, 0]
    assert values(df, p.datagram_bytes()) == [40, 40, 40, 40, 40, 40, 0]


def test_flag_names(make):
    df = make([packet(tcp_flags=f) for f in (0, 1, 2, 41, 63, 64, 18)] + [udp(), icmp(), other()])
    assert values(df, p.tcp_flag_names()) == [
        "None", "FIN", "SYN", "FIN,PSH,URG", "FIN,SYN,RST,PSH,ACK,URG", "None", "SYN,ACK", "N/A",
        "N/A", None,
    ]


@pytest.mark.parametrize(
    ("flags", "stealth", "bare"),
    [(0, True, False), (1, True, False), (41, True, False), (43, True, True), (2, False, True),
     (18, False, False), (9, False, False), (57, True, False), (33, False, False)],
)
def test_flag_rules(make, flags, stealth, bare):
    df = make([packet(tcp_flags=flags), udp(tcp_flags=flags)])
    assert values(df, p.is_stealth_scan()) == [stealth, False]
    assert values(df, p.is_bare_syn()) == [bare, False]


def test_large_packet_starts_at_1501(make):
    df = make([packet(frame_len=1500), packet(frame_len=1501), packet(frame_len=None)])
    assert values(df, p.is_large_packet()) == [False, True, False]


def test_attack_type_takes_the_strongest_rule(make):
    rows = [
        packet(frame_len=1501, tcp_flags=0), packet(tcp_flags=43), packet(), packet(tcp_flags=16),
        icmp(), icmp(src_ip="10.0.0.1"), icmp(icmp_type=0), icmp(frame_len=2000), udp(),
    ]
    trusted = F.col("src_ip") == "10.0.0.1"
    kind = a.attack_type(F.lit(True), trusted)
    assert values(make(rows), kind) == [
        "POSSIBLE_DOS", "STEALTH_SCAN", "PORT_SCAN", "unknown", "PING_SCAN", "NORMAL", "unknown",
        "POSSIBLE_DOS", "unknown",
    ]
    level = a.severity(a.alert_type(kind))
    assert values(make(rows), level) == [
        "HIGH", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM", "HIGH", "MEDIUM",
    ]


def test_features_have_all_columns_in_order(make):
    df = packets.packet_features(make([packet(), packet(), udp(), not_ip()]), keep=())
    assert df.columns == PACKET_FEATURES
    assert sorted(r["count"] for r in df.collect()) == [1, 1, 1, 2]


def test_details_and_alerts(make):
    rows = [packet(0.25, dst_port=81), icmp(), not_ip(), other()]
    details = packets.packet_details(make(rows)).orderBy("packet_id").collect()
    assert details[0]["timestamp"] == "2024-01-01 00:00:00.250"
    assert [r["protocol"] for r in details] == ["TCP", "ICMP", "unknown", "unknown"]
    assert [r["src_port"] for r in details] == [4000, None, None, None]
    assert [r["flags"] for r in details] == ["SYN", "N/A", None, None]
    assert details[0]["prediction_score"] == 1.0
    marked = packets.mark_trusted(make(rows), ["10.0.0.9"]).withColumn("port_scan", F.lit(False))
    found = packets.alerts(marked).orderBy("packet_id").collect()
    assert [r["attack_type"] for r in found] == ["ANOMALY", "NORMAL", "ANOMALY", "ANOMALY"]
    assert found[0]["alert_message"] == "ANOMALY detected from 10.0.0.9 to 10.0.0.2"
    assert found[2]["alert_message"] == "ANOMALY detected from None to None"
    assert [r["attack_type"] for r in packets.alerts(marked, drop_normal=True).collect()] == (
        ["ANOMALY"] * 3
    )


def test_loopback_is_never_trusted(spark, make):
    rows = [packet(src_ip="127.0.0.1"), packet(src_ip="10.0.0.1"), packet(), not_ip()]
    hosts = ["127.0.0.1", "10.0.0.1"]
    table = spark.createDataFrame([(h,) for h in hosts * 2], "ip string")
    for given in (hosts, table):
        assert values(packets.mark_trusted(make(rows), given), "trusted") == [
            False, True, False, False
        ]
    assert packets.only_trusted(make(rows), table).count() == 1
    assert packets.only_trusted(make(rows), table, keep=False).count() == 3


def test_ip_only(make):
    rows = [packet(), packet(src_ip="127.0.0.1"), packet(dst_ip="127.0.0.1"), not_ip()]
    assert ip_only(make(rows)).count() == 3
    assert ip_only(make(rows), exclude_host="127.0.0.1").count() == 1


def test_threshold_spaces(make):
    df = make([packet(score=s) for s in (0.1, 0.2, float("nan"), None)])
    assert packets.flag_anomalies(df, 0.1).count() == 1
    assert packets.flag_anomalies(df, 0.1, space="probability").count() == 2
    with pytest.raises(ValueError):
        packets.flag_anomalies(df, 0.1, space="other")


def test_first_and_newest(make):
    df = make([packet(s) for s in (3, 1, 2, 1)])
    assert [r["ts"].second for r in first_packets(df, 3).collect()] == [1, 1, 2]
    assert [r["timestamp"][-6:] for r in packets.recent_suspicious(df, 2).collect()] == (
        ["03.000", "02.000"]
    )
