"""Distinct ports per source over the batches of a stream, as sketches that are carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators import scans
from tidewatch.session import staged
from tidewatch.streaming.carried import CarriedTable


class CarriedSketches:
    """``update`` is for ``foreachBatch``: it unites each batch's sketches with those of the same sources before.

    A batch reads and writes the sources that it has packets of. One that is run again replaces what it wrote.
    """

    def __init__(self, folder: str, log_size: int = scans.SKETCH):
        self.table = CarriedTable(folder, "src_ip string, first_seen timestamp, sketch binary", ["src_ip"])
        self.log_size = log_size

    def update(self, packets: DataFrame, batch: int) -> None:
        spark = packets.sparkSession
        # A source of null has no state to be found by.
        new = staged(scans.port_sketches(packets.filter("src_ip IS NOT NULL"), self.log_size))
        known = self.table.read(spark, batch, among=new)
        self.table.write(batch, scans.merge_sketches(known, new))
        self.table.forget(spark, batch)

    def summary(self, spark: SparkSession, batches: int) -> DataFrame:
        """``source_scan_summary`` of the first ``batches`` batches, the number of ports estimated."""
        return scans.sketched_summary(self.table.read(spark, batches))
