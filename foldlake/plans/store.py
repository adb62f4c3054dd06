"""A store of versioned keys on any Hadoop file system: Parquet segments and runs under a chain of manifests.

A manifest is one small JSON file, NNNNN.json, created only if it is absent: of two writers that start from the same version one wins,
the other reads the new manifest and tries again, at most TRIES times. Segments hold versions relative to a base that the manifest
gives them, so a retry changes the base and no data. Readers pin a manifest and never see files of a later one. A manifest names a
Parquet table of its files, so that millions of files never pass through the driver but where a read needs their names.

A manifest appears whole or not at all: it is written aside, then linked (local folders) or renamed without overwriting (elsewhere).
Both fail if the target exists; on object stores without an atomic rename, writers must be kept apart by other means.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldlake.functions.codec import ENTRY_HEADER, entry_size
from foldlake.operators import fold, levels, merge, recovery
from foldlake.operators.model import LOG, VALUE, checked, tombstone_
from foldlake.sources.binary import CorruptData
from foldlake.sources.shipping import drop_stored, stored

TRIES = 3
MAX_LEVEL = 4
FILES = "level int, file_id long, file_size long, min_key binary, max_key binary, name string"


class StoreNotFound(Exception):
    """The folder holds no store."""


class CommitConflict(Exception):
    """Other writers won every try."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_id: int = 1
    next_lsn: int = 1
    epoch: int = 0  # of the table of recent writes; it is rotated when its segments have memtable_bytes
    segments: list = field(default_factory=list)  # {name, base, rows, bytes, epoch}
    files: str | None = None  # the table of files
    applied: dict = field(default_factory=dict)  # the last micro-batch of each stream

    def dumps(self) -> str:
        body = json.dumps(self.__dict__, sort_keys=True)
        return json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})

    @staticmethod
    def loads(text: str) -> Manifest:
        try:
            held = json.loads(text)
            if hashlib.sha256(held["body"].encode()).hexdigest() != held["sha256"]:
                raise ValueError
            return Manifest(**json.loads(held["body"]))
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptData("Failed to open manifest") from e


class Store:
    def __init__(self, spark: SparkSession, folder: str, memtable_bytes: int = levels.MEMTABLE_BYTES) -> None:
        self.spark, self.folder, self.memtable_bytes = spark, folder.rstrip("/"), memtable_bytes
        self._jvm = spark._jvm
        self._path = lambda *p: self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *p]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, folder: str, **how) -> Store:
        store = cls(spark, folder, **how)
        if not store.versions():
            store._write_manifest(Manifest())
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **how) -> Store:
        store = cls(spark, folder, **how)
        if not store.versions():
            raise StoreNotFound(folder)
        store.manifest()
        return store

    # manifests

    def _names(self, *below: str) -> list[str]:
        at = self._path(*below)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            raise StoreNotFound(self.folder)
        stream = self._fs.open(self._path("manifests", f"{version:05d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest.loads(text)

    def _write_manifest(self, m: Manifest) -> bool:
        """False if the version exists."""
        aside = self._path("manifests", f"{m.version:05d}.{self._new_name()}.tmp")
        target = self._path("manifests", f"{m.version:05d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(m.dumps().encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = [self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, aside)]
                self._jvm.java.nio.file.Files.createLink(*local)
            else:
                options = self._jvm.org.apache.hadoop.fs.Options
                none = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(aside, False)
        return True

    def commit(self, change: Callable[[Manifest], Manifest | None]) -> Manifest:
        """Apply change(manifest) -> manifest to the newest one; it sees ids and versions that nobody else has. None: nothing to do."""
        for _ in range(TRIES):
            now = self.manifest()
            then = change(now)
            if then is None:
                return now
            then = replace(then, version=now.version + 1)
            if self._write_manifest(then):
                return then
        raise CommitConflict(f"after version {now.version}")

    # writes

    def _new_name(self) -> str:
        return self._jvm.java.util.UUID.randomUUID().toString()

    def put(self, rows: DataFrame, order: list[str] | None = None, stream: str | None = None, batch: int = 0) -> int:
        """Append versions: rows have key and the columns of a value. Returns the last version given.

        Versions follow order, or without one the order in which the rows come (of a file: as they lie there). With a stream's name,
        a batch that is not above the last one applied is left out: replays after a commit change nothing.
        """
        seen = lambda m: stream is not None and m.applied.get(stream, -1) >= batch
        if seen(now := self.manifest()):
            return now.next_lsn - 1
        name = self._new_name()
        numbered = merge.assign_lsn(rows, 0, order).select(*[F.col(c).cast(LOG[c].dataType).alias(c) for c in LOG.names])
        path = f"{self.folder}/segments/{name}"
        checked(numbered).write.parquet(path)
        n, size = self.spark.read.schema(LOG).parquet(path).agg(F.count(F.lit(1)), F.coalesce(F.sum(entry_size()), F.lit(0))).first()

        def change(m: Manifest) -> Manifest | None:
            if seen(m):
                return None
            segments = [*m.segments, {"name": name, "base": m.next_lsn - 1, "rows": n, "bytes": size, "epoch": m.epoch}]
            full = sum(s["bytes"] for s in segments if s["epoch"] == m.epoch) >= self.memtable_bytes
            applied = m.applied if stream is None else m.applied | {stream: batch}
            return replace(m, next_lsn=m.next_lsn + n, segments=segments, epoch=m.epoch + full, applied=applied)

        return self.commit(change).next_lsn - 1

    def delete(self, keys: DataFrame) -> int:
        return self.put(keys.select("key", *tombstone_()))

    # reads

    def files(self, m: Manifest | None = None) -> DataFrame:
        """The files of a manifest (FILES)."""
        m = self.manifest() if m is None else m
        reader = self.spark.read.schema(FILES)
        return reader.parquet(f"{self.folder}/files/{m.files}") if m.files else self.spark.createDataFrame([], FILES)

    def _segments(self, segments: list[dict]) -> list[DataFrame]:
        of = lambda s: self.spark.read.schema(LOG).parquet(f"{self.folder}/segments/{s['name']}")
        return [of(s).withColumn("lsn", F.col("lsn") + F.lit(s["base"])).withColumn("tier", F.lit(-1)) for s in segments]

    def _runs(self, files: DataFrame) -> list[DataFrame]:
        names: dict[int, list[str]] = {}
        for r in files.select("level", "name").toLocalIterator():  # what a scan lists anyway
            names.setdefault(r["level"], []).append(f"{self.folder}/runs/{r['name']}")
        return [self.spark.read.schema(LOG).parquet(*names[k]).withColumn("tier", F.lit(k)) for k in sorted(names)]

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        return merge.union_runs(parts) if parts else self.spark.createDataFrame([], LOG).withColumn("tier", F.lit(-1))

    def log(self, m: Manifest | None = None, key: bytes | None = None) -> DataFrame:
        """All versions, with `tier`: -1 for segments, else the level. With key, files whose range excludes it aren't opened."""
        m = self.manifest() if m is None else m
        files = self.files(m)
        if key is not None:
            files = files.where((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))
        return self._union(self._segments(m.segments) + self._runs(files))

    def read(self, as_of: int | None = None, version: int | None = None) -> DataFrame:
        return fold.latest(self.log(self.manifest(version)).drop("tier"), as_of)

    def get(self, key: bytes, as_of: int | None = None) -> DataFrame:
        return fold.get(self.log(key=key).drop("tier"), F.lit(key), as_of).select("key", "lsn", *VALUE)

    def multi_get(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        return fold.multi_get(self.log().drop("tier"), keys, as_of)

    # maintenance

    def _write_run(self, rows: DataFrame, size: int, level: int, target: int) -> DataFrame:
        """Sorted Parquet files, no key in two of them, each about target of size bytes; returns their metadata."""
        name = self._new_name()
        path = f"{self.folder}/runs/{name}"
        ranged = rows.select(*LOG.names).repartitionByRange(max(1, math.ceil(size / target)), "key")
        most = max(1, min(size, target) // ENTRY_HEADER)  # keys of a file; without it, each has a bloom filter of 1 MB, however small it is
        bloom = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(most)}
        ranged.sortWithinPartitions("key", F.desc("lsn")).write.options(**bloom).parquet(path)
        held = self.spark.read.schema(LOG).parquet(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"[^/]+$", 0))
        meta = held.groupBy("file").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(entry_size()).alias("file_size"))
        return meta.select(F.lit(level).alias("level"), "file_size", "min_key", "max_key", F.concat(F.lit(f"{name}/"), "file").alias("name"))

    def _with_files(self, m: Manifest, new: DataFrame, without: DataFrame | None = None) -> Manifest:
        """m with a new table of files: its own but for those of `without`, and the new ones under ids of their own."""
        kept = self.files(m) if without is None else levels.without(self.files(m), without)
        ids = (F.row_number().over(Window.orderBy("level", "min_key", "name")) + F.lit(m.next_id - 1)).cast("bigint")  # metadata of one run
        table = self._new_name()
        both = kept.unionByName(new.withColumn("file_id", ids)).select(*self.spark.createDataFrame([], FILES).columns)
        at = f"{self.folder}/files/{table}"
        both.repartitionByRange(max(1, both.count() // 100_000), "level", "min_key").sortWithinPartitions("level", "min_key").write.parquet(at)
        top = self.spark.read.schema(FILES).parquet(at).agg(F.max("file_id")).first()[0]
        return replace(m, files=table, next_id=max(m.next_id, (top or 0) + 1))

    def flush(self, target: int = levels.FILE_BYTES, frozen: bool = False) -> Manifest:
        """Segments (with frozen, those of rotated tables only) become a run of level 0; all versions stay."""
        m = self.manifest()
        taken = [s for s in m.segments if not frozen or s["epoch"] < m.epoch]
        if not taken:
            return m
        names = {s["name"] for s in taken}
        new = self._write_run(self._union(self._segments(taken)), sum(s["bytes"] for s in taken), 0, target)

        def change(now: Manifest) -> Manifest:
            if not names <= {s["name"] for s in now.segments}:
                raise CommitConflict("another flush took the segments")
            return replace(self._with_files(now, new), segments=[s for s in now.segments if s["name"] not in names])

        return self.commit(change)

    def compact(self, level: int = 0, target: int = levels.FILE_BYTES, oldest_reader: int | None = None, room: int | None = None) -> Manifest:
        """Merge a level's files with those they overlap one level down; where nothing lies deeper, tombstones go.

        Of level 0 all files go, of others the first one, or with room all but the last ones that have less than room bytes: 0 empties it.
        """
        m = self.manifest()
        files = self.files(m)
        picked = levels.pick_l0(files) if level == 0 else levels.pick_ln(files, level, room)
        n = picked.count()
        if not n:
            return m
        rows = merge.dedup(self._union(self._runs(picked)).drop("tier"), oldest_reader=oldest_reader)
        if oldest_reader is None and files.where(F.col("level") > level + 1).isEmpty():
            rows = merge.drop_tombstones(rows)
        rows = stored(rows, "merged")  # files are cut by what is left of the inputs; ranging them reads the rows twice as well
        size = rows.agg(F.coalesce(F.sum(entry_size()), F.lit(0))).first()[0]
        new = self._write_run(rows, size, min(level + 1, MAX_LEVEL), target)
        drop_stored(rows)

        def change(now: Manifest) -> Manifest:
            if self.files(now).join(picked.select("file_id"), "file_id", "left_semi").count() != n:
                raise CommitConflict("inputs of the compaction are gone")
            return self._with_files(now, new, picked)

        return self.commit(change)

    def maintain(self, target: int = levels.FILE_BYTES, base: int = levels.L0_BYTES) -> Manifest:
        """Flush and compact for as long as something is due: more than MAX_LOGS tables, or a level above its bytes."""
        m = self.manifest()
        if levels.flush_due(len({s["epoch"] for s in m.segments} | {m.epoch})):
            self.flush(target, frozen=True)
        # a level goes down at once as far as it is above its bytes: file by file, a job each, small files would take thousands of jobs
        while due := [(r["level"], r["target_bytes"]) for r in levels.triggers(self.files(), base).where("due").collect() if r["level"] < MAX_LEVEL]:
            level, room = min(due)
            self.compact(level, target, room=room)
        return self.manifest()

    def gc_candidates(self, keep: int = 2) -> DataFrame:
        """(kind, file_id) of folders that the newest manifests don't refer to; nothing is deleted."""
        rows, live = [], []
        for version in self.versions()[-keep:]:
            m = self.manifest(version)
            rows += [(version, "segments", s["name"]) for s in m.segments] + ([(version, "files", m.files)] if m.files else [])
            run = self.files(m).select(F.lit(version).alias("version"), F.lit("runs").alias("kind"), F.split("name", "/")[0].alias("file_id"))
            live.append(run.distinct())
        held = [(kind, name) for kind in ("segments", "runs", "files") for name in self._names(kind)]
        on_disk = self.spark.createDataFrame(held, "kind string, file_id string")
        live.append(self.spark.createDataFrame(rows, "version int, kind string, file_id string"))
        return recovery.gc_candidates(on_disk, recovery.live_files(merge.union_runs(live), keep=keep))
