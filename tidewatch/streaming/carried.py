"""Tables that a streaming job carries from batch to batch.

A batch writes the rows of the keys that it touched, and no others. What has been written is merged in a fixed
rhythm: every ``FANOUT`` segments of a level become one of the next level, in which a key has its newest row
only. So a row is written again once per level, of which there are logarithmically many, and the bytes that a batch
writes follow the batch, however many keys are known. Which segments exist follows from the number of batches
alone, so a batch that is run again finds the state that it found before and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 8

#: Which batch wrote a row.
BATCH = "_batch"


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def segments(batches: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """(first batch, number of batches) of the segments after so many batches, in order."""
    found, first, length = [], 0, 1
    while length * fanout <= batches:
        length *= fanout
    while length:
        while first + length <= batches:
            found.append((first, length))
            first += length
        length //= fanout
    return found


class CarriedTable:
    """The newest row per key (``keys`` of ``schema``) over all batches so far."""

    def __init__(self, folder: str, schema: str | T.StructType, keys: Sequence[str], fanout: int = FANOUT):
        self.folder, self.keys, self.fanout = folder, list(keys), fanout
        own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = own.names
        self.schema = T.StructType([*own.fields, T.StructField(BATCH, T.LongType())])

    def path(self, first: int, length: int) -> str:
        return f"{self.folder}/{first}-{length}"

    def _rows(self, spark: SparkSession, found: Sequence[tuple[int, int]]) -> DataFrame:
        if not found:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[self.path(*s) for s in found])

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = F.struct(*[c for c in self.schema.names if c not in self.keys])
        newest = rows.groupBy(*self.keys).agg(F.max_by(values, BATCH).alias("_row"))
        return newest.select(*self.keys, "_row.*").select(*self.schema.names)

    def read(self, spark: SparkSession, batch: int, among: DataFrame | None = None) -> DataFrame:
        """The state before ``batch``; with ``among`` only of the keys that are rows of it (no nulls)."""
        rows = self._rows(spark, segments(batch, self.fanout))
        if among is not None:
            rows = rows.join(among.select(*self.keys).distinct(), self.keys, "left_semi")
        return self._newest(rows).select(*self.columns)

    def write(self, batch: int, changed: DataFrame, keep: Column | None = None) -> None:
        """State the new rows of the keys that ``batch`` touched; merges leave out rows without ``keep``."""
        spark = changed.sparkSession
        rows = changed.select(*self.columns).withColumn(BATCH, F.lit(batch).cast("long"))
        rows.write.mode("overwrite").parquet(self.path(batch, 1))
        length = self.fanout
        while (batch + 1) % length == 0:
            step, first = length // self.fanout, batch + 1 - length
            merged = self._newest(self._rows(spark, [(k, step) for k in range(first, batch + 1, step)]))
            if keep is not None:
                merged = merged.where(keep)
            merged.write.mode("overwrite").parquet(self.path(first, length))
            length *= self.fanout

    def forget(self, spark: SparkSession, batch: int) -> None:
        """Delete the segments that merges of batches before ``batch``, which must be finished, have replaced."""
        if batch < 1:
            return
        length = self.fanout
        while batch % length == 0:
            step = length // self.fanout
            for first in range(batch - length, batch, step):
                delete(spark, self.path(first, step))
            length *= self.fanout


def in_use(table: CarriedTable, spark: SparkSession) -> int:
    """Bytes of all segments that exist."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


