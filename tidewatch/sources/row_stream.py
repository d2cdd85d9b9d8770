"""A stream of packets that counts rows: every micro-batch has a given number of them.

Files are Parquet files of one folder, taken in the order of their names, so writers give them names that grow. An
offset is a file's name and the number of its rows that have been read.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.schemas import PACKET_SCHEMA

# Fixed value: packets in a buffer of the live job.
ROWS = 100

# Sent to the workers as code, so that workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Rows(InputPartition):
    """Rows ``start`` to ``end`` of a file."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


class RowStreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, folder: str, rows: int, progress: str | None = None):
        self.schema, self.folder, self.rows, self.progress = schema, folder, rows, progress
        self.position: dict | None = None
        self.sizes: dict[str, int] = {}

    def _store(self, path: str | None = None) -> tuple[fs.FileSystem, str]:
        path = path or self.folder
        return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    def _reached(self) -> dict:
        """Where a reader before this one was, one micro-batch back at most; Spark gives the start of the next one itself."""
        if self.progress is not None:
            store, path = self._store(self.progress)
            if store.get_file_info(path).is_file:
                with store.open_input_stream(path) as file:
                    return json.loads(file.read())
        return self.initialOffset()

    def _files(self, after: str) -> list[str]:
        """Names from ``after`` on, in order."""
        store, root = self._store()
        infos = store.get_file_info(fs.FileSelector(root))
        names = sorted(i.base_name for i in infos if i.is_file and i.base_name.endswith(".parquet"))
        return [name for name in names if name >= after and name[0] not in "._"]

    def _size(self, name: str) -> int:
        if name not in self.sizes:
            store, root = self._store()
            with store.open_input_file(f"{root}/{name}") as file:
                self.sizes[name] = pq.read_metadata(file).num_rows
        return self.sizes[name]

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def latestOffset(self) -> dict:
        if self.position is None:
            self.position = self._reached()
        left, position = self.rows, self.position
        for name in self._files(position["file"]):
            start = position["row"] if name == position["file"] else 0
            taken = min(left, self._size(name) - start)
            position = {"file": name, "row": start + taken}
            left -= taken
            if not left:
                break
        self.position = position
        return position

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        found = []
        for name in self._files(start["file"]):
            if name > end["file"]:
                break
            first = start["row"] if name == start["file"] else 0
            last = end["row"] if name == end["file"] else self._size(name)
            if last > first:
                found.append(Rows(name, first, last))
        return found

    def commit(self, end: dict) -> None:
        if self.progress is not None:
            store, path = self._store(self.progress)
            with store.open_output_stream(path) as file:
                file.write(json.dumps(end).encode())
        self.sizes = {name: size for name, size in self.sizes.items() if name >= end["file"]}

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, root = self._store()
        wanted = to_arrow_schema(self.schema)
        with store.open_input_file(f"{root}/{partition.path}") as source:
            file, before = pq.ParquetFile(source), 0
            groups, skip = [], 0
            for group in range(file.num_row_groups):
                size = file.metadata.row_group(group).num_rows
                if before + size <= partition.start:
                    skip = before + size
                elif before < partition.end:
                    groups.append(group)
                before += size
            at = skip
            for batch in file.iter_batches(row_groups=groups, columns=wanted.names, batch_size=10_000):
                first, last = max(partition.start - at, 0), min(partition.end - at, batch.num_rows)
                at += batch.num_rows
                if first < last:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(f.name).slice(first, last - first).cast(f.type) for f in wanted], schema=wanted)


class RowStream(DataSource):
    """Options: ``path``, ``rows`` per micro-batch, and ``progress``, a file."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch_rows"

    def streamReader(self, schema: StructType) -> RowStreamReader:
        return RowStreamReader(schema, self.options["path"].rstrip("/"), int(self.options.get("rows", ROWS)), self.options.get("progress"))


def stream_rows(
    spark: SparkSession, path: str, schema: StructType = PACKET_SCHEMA, rows: int = ROWS, progress: str | None = None
) -> DataFrame:
    """Packets from a folder of Parquet files, ``rows`` per micro-batch and the rest in the last one.

    The folder is read through Arrow's file systems. For a trigger by time: a trigger that takes what is there and
    ends would take one micro-batch. A job that is to go on after a restart names a file for its ``progress``, beside its
    checkpoint; the first micro-batch after a restart may be shorter.
    """
    spark.dataSource.register(RowStream)
    reader = spark.readStream.format(RowStream.name()).schema(schema).option("path", path).option("rows", str(rows))
    return (reader if progress is None else reader.option("progress", progress)).load()
