"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# The state store that operators with state per key need; it commits changes instead of snapshots.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

_local_folders: dict[str, str] = {}


def session(app_name: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library assumes; extra settings use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    given = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**STATE_STORE, **given}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets one temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="tidewatch-")
    return _local_folders[context.applicationId]


_scopes: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what ``staged`` and ``scratch`` put into the shared folder inside, at the end of the ``with`` block.

    Results that are still to be computed need these tables, so write results inside the block.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not paths]
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted at the end of the ``staging`` blocks that are open now."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def staged(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, as ``schema`` if its types are stored alike.

    This cuts lineage, so that a lost executor costs a re-read and not a re-run. It also fixes
    partition ids and other values that a second run might choose differently, and it lets Spark
    see the true size of the table, so that joins broadcast it only below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
