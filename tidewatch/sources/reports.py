"""The final report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(totals: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one row of ``run_totals`` as JSON."""
    totals.coalesce(1).write.mode(mode).json(path, ignoreNullFields=False)


def report_lines(totals: DataFrame) -> DataFrame:
    """The totals as text lines; the share is left out of a run without packets."""
    lines = F.array(
        F.lit("=== Final Statistics ==="),
        F.format_string("Total runtime: %.1f seconds", F.coalesce("runtime", F.lit(0.0))),
        F.format_string("Total packets analyzed: %d", "total_packets"),
        F.format_string("Total potential attacks detected: %d", "total_attacks"),
        F.when(
            F.col("total_packets") > 0,
            F.format_string("Overall attack percentage: %.2f%%", "attack_percentage"),
        ),
    )
    return totals.select(F.posexplode(F.array_compact(lines)).alias("line", "value"))
