"""Column expressions from packet details to alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import packets as p

# Severity by alert type; anything else is MEDIUM.
SEVERITY = {
    "PORT_SCAN": "HIGH",
    "STEALTH_SCAN": "HIGH",
    "PING_SCAN": "MEDIUM",
    "POSSIBLE_DOS": "HIGH",
    "ANOMALY": "MEDIUM",
}
DEFAULT_SEVERITY = "MEDIUM"


def attack_type(port_scan: Column, trusted: Column) -> Column:
    """Strongest rule first: size, then flags, then scan state or ping."""
    return (
        F.when(p.is_large_packet(), "POSSIBLE_DOS")
        .when(p.is_stealth_scan(), "STEALTH_SCAN")
        .when(p.is_bare_syn() & F.coalesce(port_scan, F.lit(False)), "PORT_SCAN")
        .otherwise(F.coalesce(p.ping_scan(trusted), F.lit("unknown")))
    )


def alert_type(attack: Column) -> Column:
    return F.when(attack == "unknown", "ANOMALY").otherwise(attack)


def severity(alert: Column) -> Column:
    high = [name for name, level in SEVERITY.items() if level == "HIGH"]
    return F.when(alert.isin(high), "HIGH").otherwise(DEFAULT_SEVERITY)


def alert_message(alert: Column, source: Column, destination: Column) -> Column:
    """Missing addresses print as ``None``."""
    shown = [F.coalesce(c, F.lit("None")) for c in (source, destination)]
    return F.format_string("%s detected from %s to %s", alert, *shown)
