"""The fold over a stream: state is the newest version of each key, and a version counts whenever it arrives.

There is no watermark: the largest version wins in any order of arrival, so state is one row a key and is never dropped. Replays
are harmless. Micro-batches are the groups that are committed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foldlake.operators.fold import newest


def fold_stream(log: DataFrame, key: str = "key", version: str = "lsn") -> DataFrame:
    """A streaming log as its changing table of newest versions (tombstones included)."""
    return newest(log, key, version)


def run_fold(log: DataFrame, out: str, checkpoint: str, key: str = "key", version: str = "lsn") -> StreamingQuery:
    """Fold all that is there and stop. Each batch writes the keys whose newest version it changed, under its own name; a batch that
    is run again writes the same folder."""

    def write(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{out}/batch={batch:09d}")

    query = fold_stream(log, key, version).writeStream.outputMode("update").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, out: str, key: str = "key", version: str = "lsn") -> DataFrame:
    """The table that run_fold has brought about: the newest of what its batches wrote, tombstones included."""
    return newest(spark.read.parquet(out).drop("batch"), key, version)


def append_stream(log: DataFrame, store, checkpoint: str, order: list[str] | None = None, name: str = "stream") -> StreamingQuery:
    """Append a stream's rows to a store, one commit a micro-batch. The manifest remembers the last batch under the stream's name, so
    that a batch that is run again after its commit (a restart between commit and checkpoint) is left out."""

    def write(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            store.put(rows, order, stream=name, batch=batch)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
