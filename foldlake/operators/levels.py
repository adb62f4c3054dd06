"""Levels of sorted files: sizes, triggers, overlap of key ranges, and the choice of what to compact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldlake.functions.codec import level_target

L0_BYTES, LEVEL_FACTOR, MAX_LOGS, MEMTABLE_BYTES, FILE_BYTES = 128 << 20, 10, 4, 4 << 20, 64 << 20


def run_metadata(rows: DataFrame, run: str = "run", key: str = "key", size: str = "bytes") -> DataFrame:
    """A row for each run: its key range, rows, distinct keys and bytes."""
    return rows.groupBy(run).agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_keys"), F.sum(size).cast("bigint").alias("file_size"),
    )


def level_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.sum("file_size").cast("bigint").alias("level_bytes"), F.count(F.lit(1)).alias("n_files"))


def triggers(files: DataFrame, base: int = L0_BYTES, factor: int = LEVEL_FACTOR) -> DataFrame:
    """level_sizes with the bytes that a level may have, and whether it is due."""
    at = level_sizes(files).withColumn("target_bytes", level_target(F.col("level"), base, factor))
    return at.withColumn("due", F.col("level_bytes") >= F.col("target_bytes"))


def flush_due(n_logs: int, limit: int = MAX_LOGS) -> bool:
    return n_logs > limit


def hull(files: DataFrame) -> DataFrame:
    """One row: the key range that the files span."""
    return files.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))


def overlapping(files: DataFrame, span: DataFrame) -> DataFrame:
    """The files whose range of keys meets that of the one-row span (key bytes only, versions don't count)."""
    one = F.broadcast(span)
    return files.join(one, (files["max_key"] >= one["lo"]) & (files["min_key"] <= one["hi"]), "left_semi")


def candidate(files: DataFrame) -> DataFrame:
    """The first file of a level by key."""
    return files.orderBy("min_key", "file_id").limit(1)


def pick_l0(files: DataFrame) -> DataFrame:
    """All of level 0, and the files of level 1 that overlap it."""
    zero = files.where("level = 0")
    return zero.unionByName(overlapping(files.where("level = 1"), hull(zero)))


def surplus(files: DataFrame, room: int) -> DataFrame:
    """The first files of a level by key, so many that those left have less than room bytes (with 0, all): what candidate() would give one by one."""
    w = Window.orderBy(F.desc("min_key"), F.desc("file_id")).rowsBetween(Window.unboundedPreceding, 0)  # metadata of one level
    return files.withColumn("_from_here", F.sum("file_size").over(w)).where(F.col("_from_here") >= F.lit(room)).drop("_from_here")


def pick_ln(files: DataFrame, level: int, room: int | None = None) -> DataFrame:
    """The first file of a level, with room its surplus(), and the files of the next that overlap them."""
    own = files.where(F.col("level") == level)
    own = candidate(own) if room is None else surplus(own, room)
    return own.unionByName(overlapping(files.where(F.col("level") == level + 1), hull(own)))


def without(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """The files that a compaction leaves."""
    return files.join(inputs.select("file_id"), "file_id", "left_anti")
