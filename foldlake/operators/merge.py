"""Runs of sorted versions: merging, dropping what is out of date, and cutting the output into files and blocks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foldlake.operators.fold import newest
from foldlake.sources.shipping import free_name, ship, stored


def union_runs(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def merge_runs(runs: list[DataFrame], key: str = "key", version: str = "lsn") -> DataFrame:
    """All versions of all runs in the order of keys, newest version first: a range shuffle and a sort that spills."""
    return union_runs(runs).orderBy(F.col(key).asc(), F.col(version).desc())


def dedup(log: DataFrame, key: str = "key", version: str = "lsn", oldest_reader: int | None = None) -> DataFrame:
    """The newest version of each key. With oldest_reader, also what a reader at that version or later can still see."""
    if oldest_reader is None:
        return newest(log, key, version)
    above = log.where(F.col(version) > F.lit(oldest_reader))
    return above.unionByName(newest(log.where(F.col(version) <= F.lit(oldest_reader)), key, version).select(*log.columns))


def drop_tombstones(log: DataFrame, tombstone: str = "tombstone") -> DataFrame:
    """At the bottom level nothing older is left that a tombstone must hide."""
    return log.where(~F.col(tombstone))


def running_bytes(size: Column, order: list[Column], part: list[str] | None = None) -> Column:
    """Bytes before a row, in an order within a partition."""
    w = (Window.partitionBy(*part) if part else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint")


#: Bytes (as Spark estimates them) that one range of a global order takes, and bounds on the number of ranges.
SLICE_BYTES, LEAST_SLICES, MOST_SLICES = 64 << 20, 8, 1 << 16


def _slices(rows: DataFrame) -> int:
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(LEAST_SLICES, min(MOST_SLICES, -(-size // SLICE_BYTES)))


def _numbered(rows: DataFrame, order: list[str] | None, size: str | None, name: str, slices: int | None) -> DataFrame:
    """rows with `name`: the sum of size (or the number) of the rows before, in a global order or as the rows come.

    The rows are ranged and sorted by one shuffle and stored with their slice and place there. Totals and rows are read from that one
    table: two plans that each range the rows would draw other samples and so other ranges. The totals (a row a slice, MOST_SLICES at
    most) are summed up and broadcast. Places need no second shuffle; sums of sizes take a window in each slice.
    """
    part, place = free_name(rows, "slice"), free_name(rows, "place")
    at = rows
    if order is not None:
        at = rows.repartitionByRange(slices or _slices(rows), *order).sortWithinPartitions(*order)
    # the id's upper bits are the task's number, the lower 33 the row's place in it
    at = at.withColumn(part, F.monotonically_increasing_id())
    at = at.withColumn(place, F.col(part).bitwiseAND(F.lit((1 << 33) - 1))).withColumn(part, F.shiftright(part, 33))
    held = stored(at, "in-order")
    total = held.groupBy(F.col(part).alias("_of")).agg((F.count(F.lit(1)) if size is None else F.sum(size)).alias("_total"))
    w = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("_of", F.coalesce(F.sum("_total").over(w), F.lit(0)).cast("bigint").alias("_base"))
    own = F.col(place) if size is None else running_bytes(F.col(size), [F.col(place)], [part])
    out = held.withColumn(place, own).join(F.broadcast(base), F.col(part) == F.col("_of"))
    return out.select(*[held[c] for c in rows.columns if c != name], (F.col(place) + F.col("_base")).cast("bigint").alias(name))


def prefix_sums(rows: DataFrame, size: str, order: list[str], name: str = "before", slices: int | None = None) -> DataFrame:
    """rows with `before`: bytes of all rows before, in a global order, without one task that sees all rows."""
    return _numbered(rows, order, size, name, slices)


def places(rows: DataFrame, order: list[str] | None = None, name: str = "before", slices: int | None = None) -> DataFrame:
    """rows with the number of rows before, in a global order; without one, as Spark deals the rows out."""
    return _numbered(rows, order, None, name, slices)


def split_files(rows: DataFrame, target: int, size: str = "bytes", key: str = "key", version: str = "lsn") -> DataFrame:
    """rows with `file_no`: a new file begins at the first key at or after each multiple of target bytes.

    Sizes are summed by key first (combined before the shuffle), so that the versions of a key never lie in two files, and so that
    only one row a key is put in order; a key with very many versions is split by Spark in the join.
    """
    sizes = rows.groupBy(key).agg(F.sum(size).alias("key_bytes"))
    cut = prefix_sums(sizes, "key_bytes", [key]).select(key, F.expr(f"before div {int(target)}").alias("file_no"))
    return rows.join(cut, key)


def block_index(rows: DataFrame, block: int = 4096, size: str = "bytes", key: str = "key", part: str = "file_no", version: str = "lsn") -> DataFrame:
    """(file, block, least and largest key, rows, bytes): blocks of about `block` bytes by running sums."""
    before = running_bytes(F.col(size), [F.col(key), F.col(version).desc()], [part])
    at = rows.withColumn("block_no", F.floor(before / F.lit(block)).cast("bigint"))
    return at.groupBy(part, "block_no").agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes")
    )


def greedy_cuts(rows: DataFrame, limit: int, order: list[Column], part: str, size: str = "bytes", name: str = "cut_no", whole: str | None = None) -> DataFrame:
    """rows with `cut_no`, counted from 0 in each part: a cut ends with the row that brings it to limit bytes, and sums start anew.

    With `whole`, a cut ends only where that column changes, so that the versions of a key stay together. Where a part is cut depends
    on all its earlier cuts, so a part is one task's: parts are files, inputs of one compaction, or segments, all bounded. Spark sorts
    them (and spills); Python sees a batch at a time.
    """
    ship(rows.sparkSession)
    schema = T.StructType([*rows.schema, T.StructField(name, T.LongType())])

    def cut(batches):
        now, at, total, last = (), 0, 0, None
        for batch in batches:
            parts, sizes = batch.column(part).to_pylist(), batch.column(size).to_pylist()
            out = []
            for p, n, w in zip(parts, sizes, batch.column(whole).to_pylist() if whole else parts):
                if (p,) != now:
                    now, at, total = (p,), 0, 0
                elif total >= limit and (whole is None or w != last):
                    at, total = at + 1, 0
                out.append(at)
                total, last = total + n, w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, name])

    return rows.repartition(part).sortWithinPartitions(part, *order).mapInArrow(cut, schema)


def assign_lsn(rows: DataFrame, base: int, order: list[str] | None = None) -> DataFrame:
    """rows with `lsn`: base + 1, base + 2, ..., contiguous, in an order or as the rows come."""
    return places(rows, order, "lsn").withColumn("lsn", F.col("lsn") + F.lit(base) + 1)


def rotation_epochs(rows: DataFrame, limit: int, size: str = "bytes", version: str = "lsn") -> DataFrame:
    """rows with `epoch`: the table of recent writes is rotated whenever the bytes written pass another multiple of limit."""
    at = prefix_sums(rows, size, [version], "epoch")
    return at.withColumn("epoch", F.expr(f"epoch div {int(limit)}"))
