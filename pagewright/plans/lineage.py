"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests, local mode)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    return _LOCAL_ROOTS[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        try:
            _delete(spark, path)
        except Exception:  # the session may already be closing
            return


atexit.register(_at_exit)


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once as Parquet below the shared folder and read it back: later reads survive lost executors and
    have no lineage beyond that table. The table is removed when the session's process ends, or by release()."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/pagewright-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._pagewright_path = path  # type: ignore[attr-defined]
    return back


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder below the shared one removed when the session's process ends."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)


def materialize_counted(df: DataFrame, **counted: Column) -> tuple[DataFrame, dict[str, int]]:
    """materialize() with aggregates of df's rows, taken while they are written: no job of their own."""
    watch = Observation()
    back = materialize(df.observe(watch, *[e.alias(n) for n, e in counted.items()]))
    return back, watch.get


def release(*tables: DataFrame | None) -> None:
    """Remove tables written by materialize() that no result needs any more."""
    for table in tables:
        path = getattr(table, "_pagewright_path", None)
        if path:
            _delete(table.sparkSession, path)
            _WRITTEN[table.sparkSession.sparkContext.applicationId].remove(path)
