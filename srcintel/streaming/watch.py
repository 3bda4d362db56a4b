"""Live re-analysis: a stream of file changes whose micro-batches run the batch query again."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from srcintel.operators.facts import ship
from srcintel.sources.pysource import PythonSource


def changes(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """(path, change) as .py files below root come, change and go."""
    ship(spark)
    spark.dataSource.register(PythonSource)
    return spark.readStream.format("pysource").option("ignore", "\n".join(ignore)).option("stream", "1").load(os.path.abspath(root))


def rerun(stream: DataFrame, analyse: Callable[[DataFrame], None], interval: str | None = "200 milliseconds", once: bool = False) -> StreamingQuery:
    """Calls analyse(changes of the batch) for each batch that has any. Changes within an interval are one batch, which
    debounces them. A watcher outlives a bad state of the files: an error is printed and the stream goes on. once: what is there now is
    analysed, and an error is the query's."""

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        try:
            analyse(df)
        except Exception as e:  # noqa: BLE001 - as a watcher must outlive a bad state of the files
            if once:
                raise
            print(f"analysis failed: {e}", file=sys.stderr)

    return _started(stream, batch, interval, once)


def _started(stream: DataFrame, batch: Callable[[DataFrame, int], None], interval: str | None, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def keep(stream: DataFrame, shape: Callable[[DataFrame], DataFrame], to: str, interval: str | None = "200 milliseconds", once: bool = False) -> StreamingQuery:
    """Writes shape(changes of the batch) below `to`, each batch to a folder of its own number: a batch that is replayed replaces what it wrote, so
    nothing is lost or counted twice. An error ends the query, whose checkpoint then has the batch still to do."""

    def batch(df: DataFrame, number: int) -> None:
        shape(df).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return _started(stream, batch, interval, once)
