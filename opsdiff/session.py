"""Small helpers around the Spark session: settings, shared folder, small tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings this library is written for; pass them to spark-submit or a builder.
# Reduce partitions start fine-grained and AQE merges them to the advisory size,
# so the same settings serve megabytes and terabytes.
CLUSTER_CONF = {
    STATE_STORE: ROCKSDB,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
}

# Tables up to this many rows (some tens of megabytes) may be sent to every executor.
SMALL_TABLE_ROWS = 500_000


def small_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """Driver-side constants as a local relation, whose exact size the optimizer sees."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def broadcast_if_small(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Asks for a broadcast when the counted size allows it; else joins shuffle.

    Counts the table, so it is meant for tables of parameters: catalogs, rules,
    windows per host, pairs of snapshots.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fetched_if_small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table of parameters computed once: rows that fit the limit come back as a table to broadcast.

    More rows than that stay where they are and are joined by shuffle.
    """
    rows = df.limit(limit + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= limit else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="opsdiff-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which map states and timers need.

    A stream takes a copy of the settings as it starts, so the session's own is put back.
    """
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder wherever Spark can write."""
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
