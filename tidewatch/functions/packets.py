"""Column expressions over one packet row. All of them compile into the scan stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# IP protocol numbers.
ICMP, TCP, UDP = 1, 6, 17

# TCP flag bits, in the order in which flag names are listed.
TCP_FLAGS = {"FIN": 0x01, "SYN": 0x02, "RST": 0x04, "PSH": 0x08, "ACK": 0x10, "URG": 0x20}

# Service names by destination port.
TCP_SERVICES = {80: "http", 443: "https", 22: "ssh", 21: "ftp"}
UDP_SERVICES = {53: "domain"}
ICMP_SERVICE = "ecr_i"

# Features that a single packet cannot tell.
CONSTANT_FEATURES = {
    "duration": 0, "srv_count": 1, "serror_rate": 0, "srv_serror_rate": 0, "rerror_rate": 0,
    "srv_rerror_rate": 0, "same_srv_rate": 1, "diff_srv_rate": 0, "srv_diff_host_rate": 0,
}

# Fixed value: frames above this many bytes count as large.
LARGE_FRAME = 1500

XMAS = TCP_FLAGS["FIN"] | TCP_FLAGS["PSH"] | TCP_FLAGS["URG"]


def _true(condition: Column) -> Column:
    """The condition with null read as false."""
    return F.coalesce(condition, F.lit(False))


def _flag(name: str) -> Column:
    return F.col("tcp_flags").bitwiseAND(TCP_FLAGS[name]) != 0


def is_ip() -> Column:
    """IPv4 only: IPv6 is another layer to the capture filter ``ip``."""
    return F.col("ip_version").eqNullSafe(4)


def is_tcp() -> Column:
    return is_ip() & F.col("ip_proto").eqNullSafe(TCP)


def is_udp() -> Column:
    return is_ip() & F.col("ip_proto").eqNullSafe(UDP)


def is_icmp() -> Column:
    return is_ip() & F.col("ip_proto").eqNullSafe(ICMP)


def protocol_type() -> Column:
    return F.when(is_tcp(), "tcp").when(is_udp(), "udp").when(is_icmp(), "icmp").otherwise("unknown")


def by_port(names: dict[int, str]) -> Column:
    chain = reduce(lambda c, kv: c.when(F.col("dst_port") == kv[0], kv[1]), names.items(), F)
    return chain.otherwise("other")


def service() -> Column:
    return (
        F.when(is_tcp(), by_port(TCP_SERVICES))
        .when(is_udp(), by_port(UDP_SERVICES))
        .when(is_icmp(), ICMP_SERVICE)
        .otherwise("other")
    )


def flag() -> Column:
    tcp = F.when(_flag("SYN"), "S").when(_flag("ACK"), "A").otherwise("OTH")
    return F.when(is_tcp(), tcp).when(is_udp() | is_icmp(), "SF").otherwise("OTH")


def land() -> Column:
    return (is_ip() & _true(F.col("src_ip") == F.col("dst_ip"))).cast("int")


def wrong_fragment() -> Column:
    return (is_ip() & (_true(F.col("ip_mf")) | _true(F.col("ip_frag") > 0))).cast("int")


def urgent() -> Column:
    return (is_tcp() & _true(F.col("urgptr") > 0)).cast("int")


def datagram_bytes() -> Column:
    """Used for both directions: one packet shows one datagram length only."""
    return F.when(is_ip(), F.coalesce("ip_len", F.lit(0))).otherwise(0)


def tcp_flag_names() -> Column:
    names = F.concat_ws(",", *[F.when(_flag(n), n) for n in TCP_FLAGS])
    return F.when(is_tcp(), F.when(names == "", "None").otherwise(names)).when(
        is_udp() | is_icmp(), "N/A"
    )


def is_bare_syn() -> Column:
    return is_tcp() & _true(_flag("SYN") & ~_flag("ACK"))


def is_stealth_scan() -> Column:
    flags = F.col("tcp_flags")
    return is_tcp() & _true(
        (flags == 0) | (flags == TCP_FLAGS["FIN"]) | (flags.bitwiseAND(XMAS) == XMAS)
    )


def is_echo_request() -> Column:
    return is_icmp() & F.col("icmp_type").eqNullSafe(8)


def is_large_packet() -> Column:
    return _true(F.col("frame_len") > LARGE_FRAME)


def ping_scan(trusted: Column) -> Column:
    return F.when(is_echo_request(), F.when(trusted, "NORMAL").otherwise("PING_SCAN"))


def connection_key() -> Column:
    """Display form of a connection; group by the four columns instead."""
    key = F.format_string("%s:%d-%s:%d", "src_ip", "src_port", "dst_ip", "dst_port")
    return F.when(is_tcp(), key)


def in_connection() -> Column:
    """Rows that take part in connection state."""
    complete = reduce(
        lambda a, b: a & b,
        [F.col(c).isNotNull() for c in ("src_ip", "src_port", "dst_ip", "dst_port")],
    )
    return is_tcp() & complete
