"""Reads of a change log: the newest version of each key wins, and a tombstone hides the key.

Order matters: the version bound is applied before the fold, tombstones are dropped after it. The fold is a grouped max_by, which
Spark combines before the shuffle: a key with millions of versions sends one row from each task. Results depend only on the log's
rows, never on how they are laid out in runs, levels or files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(log: DataFrame, key: str = "key", version: str = "lsn", values: list[str] | None = None) -> DataFrame:
    """One row a key: its newest version, tombstones included."""
    rest = [c for c in (values or log.columns) if c not in (key, version)]
    best = F.max_by(F.struct(*rest), F.col(version)).alias("best")
    return log.groupBy(key).agg(F.max(version).alias(version), best).select(key, version, *[F.col(f"best.{c}").alias(c) for c in rest])


def as_of(log: DataFrame, bound: int | None, version: str = "lsn") -> DataFrame:
    """The versions that a reader at bound sees; the filter reaches the scan."""
    return log if bound is None else log.where(F.col(version) <= F.lit(bound))


def latest(log: DataFrame, at: int | None = None, key: str = "key", version: str = "lsn", tombstone: str = "tombstone") -> DataFrame:
    """The live rows."""
    return newest(as_of(log, at, version), key, version).where(~F.col(tombstone))


def deleted(log: DataFrame, at: int | None = None, key: str = "key", version: str = "lsn", tombstone: str = "tombstone") -> DataFrame:
    """The keys whose newest version is a tombstone."""
    return newest(as_of(log, at, version), key, version).where(F.col(tombstone))


def get(log: DataFrame, wanted: Column, at: int | None = None, key: str = "key", version: str = "lsn", tombstone: str = "tombstone") -> DataFrame:
    """The live row of one key, or none. The key's predicate is pushed to the scan; the limit comes before the tombstone test."""
    found = as_of(log, at, version).where(F.col(key) == wanted)
    return found.orderBy(F.col(version).desc()).limit(1).where(~F.col(tombstone))


def multi_get(log: DataFrame, keys: DataFrame, at: int | None = None, key: str = "key", version: str = "lsn", tombstone: str = "tombstone") -> DataFrame:
    """The live rows of the keys in the column `key` of keys: one semi join, then the fold."""
    return latest(log.join(keys.select(key), key, "left_semi"), at, key, version, tombstone)


def history(log: DataFrame, key: str = "key", version: str = "lsn") -> DataFrame:
    """All versions with their rank within the key, newest first."""
    return log.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc())))


def tiered(log: DataFrame, tier: str, key: str = "key", version: str = "lsn", tombstone: str = "tombstone") -> DataFrame:
    """A read that goes through tiers, lower first, and stops at the first that has the key.

    It equals latest() whenever newer versions lie in lower tiers, which flushing and compaction keep true.
    """
    order = F.struct((-F.col(tier)).alias("near"), F.col(version).alias("version"))
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in rest]).where(~F.col(tombstone))


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with more versions."""
    return log.unionByName(rows)
