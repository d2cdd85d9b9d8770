"""Rows of packets for tests."""

import datetime as dt

from tidewatch.schemas import SCORED_PACKET_SCHEMA

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    """A time so many seconds after the start of the tests' traffic."""
    return START + dt.timedelta(microseconds=round(seconds * 1_000_000))


_ids = iter(range(1_000_000_000))

TCP_SYN = dict(
    ip_version=4, src_ip="10.0.0.9", dst_ip="10.0.0.2", ip_proto=6, src_port=4000, dst_port=80,
    tcp_flags=2, urgptr=0, icmp_type=None, ip_mf=False, ip_frag=0, ip_len=40, frame_len=54, score=1.0,
)


def packet(seconds=0.0, **changes):
    """A bare SYN unless changed."""
    fields = {"packet_id": next(_ids), "ts": at(seconds), **TCP_SYN, **changes}
    return tuple(fields[f.name] for f in SCORED_PACKET_SCHEMA)


def udp(seconds=0.0, **changes):
    return packet(seconds, **{"ip_proto": 17, "tcp_flags": None, "urgptr": None, **changes})


def icmp(seconds=0.0, **changes):
    none = dict(src_port=None, dst_port=None, tcp_flags=None, urgptr=None)
    return packet(seconds, **{"ip_proto": 1, "icmp_type": 8, **none, **changes})
