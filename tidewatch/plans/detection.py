"""From packets to alerts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tidewatch.operators import learn, packets, prepare, scans
from tidewatch.session import staged
from tidewatch.sources.packets import ip_only


def score_packets(
    traffic: DataFrame,
    scaler: prepare.Scaler,
    network: learn.DenseNetwork,
    max_age: float | None = 300,
    compat: bool = False,
) -> DataFrame:
    """Add the network's logit as ``score`` to every IP packet."""
    features = packets.packet_features(ip_only(traffic), max_age, keep=traffic.columns)
    vectors = learn.encode_packets(features, scaler, compat=compat)
    scored = learn.score_dense_network(vectors, network)
    return scored.select(*traffic.columns, "score")


def detect(
    scored: DataFrame,
    threshold: float,
    trusted: DataFrame | Iterable[str] = (),
    scope: str = "anomalous",
    space: str = "logit",
    drop_normal: bool = False,
) -> DataFrame:
    """Alerts for the scored packets that pass the threshold.

    ``scope`` tells which bare SYNs count towards port scans: those of ``anomalous`` packets, as the
    live rule has it, or those of ``all`` packets.
    """
    if scope not in ("anomalous", "all"):
        raise ValueError(f"scope must be 'anomalous' or 'all', not {scope!r}")
    traffic = ip_only(scored)
    # Used twice, for scans and for the alerts: written out, so that scoring runs once.
    anomalous = staged(packets.flag_anomalies(traffic, threshold, space))
    flagged = scans.port_scan(anomalous, traffic if scope == "all" else None)
    return packets.alerts(packets.mark_trusted(flagged, trusted), drop_normal)
