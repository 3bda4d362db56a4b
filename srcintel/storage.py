"""Tables that cut lineage, in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, which only a local master may use: on a cluster the executors wouldn't share it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="srcintel-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def place(spark: SparkSession, name: str) -> str:
    """A new path in that folder, which release() deletes."""
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, without lineage.

    Unlike checkpoint() it doesn't compute the last stage twice; lost executors don't lose it."""
    spark = df.sparkSession
    at = place(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def mark() -> int:
    """A point in time for release()."""
    return len(_written)


def release(since: int = 0) -> None:
    """Deletes what place() and stash() made since the mark. For whoever has written the results that were read from there."""
    while len(_written) > since:
        spark, at = _written.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - a session that has ended; its folder is the owner's
            continue
