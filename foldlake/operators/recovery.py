"""Replay of logs, and what may be deleted: prefixes up to the first bad entry, next version, unreferenced files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.operators.fold import newest
from foldlake.sources.shipping import free_name


def valid_prefix(entries: DataFrame, ok: Column, log: str = "log_id", offset: str = "offset") -> DataFrame:
    """The entries of each log before its first bad one: one grouped minimum and a join, no ordered window over a whole log."""
    bad = entries.where(~F.coalesce(ok, F.lit(False))).groupBy(log).agg(F.min(offset).alias("first_bad"))
    kept = entries.join(bad, log, "left").where(F.col("first_bad").isNull() | (F.col(offset) < F.col("first_bad")))
    return kept.drop("first_bad")


def next_lsn(*sources: DataFrame, version: str = "lsn") -> DataFrame:
    """One row: one more than the largest version in any source; 1 if there is none."""
    tops = [s.agg(F.max(version).alias("top")) for s in sources]
    both = tops[0]
    for t in tops[1:]:
        both = both.unionByName(t)
    return both.agg((F.coalesce(F.max("top"), F.lit(0)) + 1).cast("bigint").alias("next_lsn"))


def replay(log: DataFrame, key: str = "key", version: str = "lsn") -> DataFrame:
    """The state after a replay; replaying entries twice changes nothing."""
    return newest(log, key, version)


def live_files(manifests: DataFrame, in_memory: DataFrame | None = None, keep: int = 2) -> DataFrame:
    """Ids that the newest `keep` manifests (rows of version, kind, file_id) refer to, and those held open."""
    versions = manifests.select("version").distinct().orderBy(F.desc("version")).limit(keep)
    live = manifests.join(F.broadcast(versions), "version", "left_semi").select("kind", "file_id")
    return (live if in_memory is None else live.unionByName(in_memory.select("kind", "file_id"))).distinct()


def gc_candidates(on_disk: DataFrame, live: DataFrame) -> DataFrame:
    """Files on disk that nothing refers to. Deleting them is the caller's decision."""
    return on_disk.join(live, ["kind", "file_id"], "left_anti")


def take(rows: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The first n of rows that are numbered from 0."""
    return rows.where(F.col(ordinal) < F.lit(n))


def skip(rows: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """All but the first n of rows that are numbered from 0."""
    return rows.where(F.col(ordinal) >= F.lit(n))


def pair_by_ordinal(left: DataFrame, right: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows of two lists at the same place (frozen tables and their logs); fails if one list is longer."""
    here, there = free_name(left, "here"), free_name(right, "there")
    both = left.withColumn(here, F.lit(True)).join(right.withColumn(there, F.lit(True)), ordinal, "full")
    odd = F.raise_error(F.lit("the lists have different lengths")).cast("boolean")
    paired = F.when(F.col(here) & F.col(there), True).otherwise(odd)
    return both.where(paired).drop(here, there)
