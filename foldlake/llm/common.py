"""Helpers that the training-data operators share: tables, shared storage, tokenisation and hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.sources.shipping import shared_dir, shared_path, ship  # noqa: F401

#: Rows in an Arrow batch that goes to Python; long texts make larger batches costly.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before work in Python: ship the package, and bound the rows of a batch, so that a run of long texts fits in memory."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bytes_of(text: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def words(data: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at \\x20 and \\x09-\\x0D, which is what bytes.lower() and bytes.split() do."""
    return data.lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words met most recently."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores before it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def field(name: str, kind: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind, nullable)
