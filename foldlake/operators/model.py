"""The change log: one row for each version of a key.

key BINARY, lsn BIGINT (larger is newer), value_type (bytes, str, int or tombstone), and the value in the column of its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.functions.codec import MAX_KEY, TOMBSTONE

LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("value_type", T.StringType()),
        T.StructField("v_bytes", T.BinaryType()),
        T.StructField("v_str", T.StringType()),
        T.StructField("v_int", T.LongType()),
        T.StructField("tombstone", T.BooleanType()),
    ]
)
VALUE = ["value_type", "v_bytes", "v_str", "v_int", "tombstone"]


class InvalidRow(ValueError):
    """A key or version that the model can't hold."""


def _value(kind: str, **own: Column) -> list[Column]:
    types = {"v_bytes": "binary", "v_str": "string", "v_int": "bigint"}
    return [
        F.lit(kind).alias("value_type"),
        *[own.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()],
        F.lit(kind == TOMBSTONE).alias("tombstone"),
    ]


def bytes_(value: Column) -> list[Column]:
    return _value("bytes", v_bytes=value)


def str_(value: Column) -> list[Column]:
    return _value("str", v_str=value)


def int_(value: Column) -> list[Column]:
    return _value("int", v_int=value)


def tombstone_() -> list[Column]:
    return _value(TOMBSTONE)


def checked(log: DataFrame) -> DataFrame:
    """log, failing at run time on a null or overlong key, a negative version, or a value without its payload."""
    payload = F.coalesce(F.col("v_bytes"), F.encode("v_str", "UTF-8"), F.encode(F.col("v_int").cast("string"), "UTF-8"))
    wrong = (
        F.when(F.col("key").isNull(), "key is null")
        .when(F.octet_length("key") > MAX_KEY, f"key is longer than {MAX_KEY} bytes")
        .when(F.col("lsn").isNull() | (F.col("lsn") < 0), "version is null or negative")
        .when(F.col("tombstone") != (F.col("value_type") == TOMBSTONE), "tombstone flag and type disagree")
        .when(~F.col("tombstone") & payload.isNull(), "value is null")
    )
    return log.withColumn("key", F.when(wrong.isNull(), F.col("key")).otherwise(F.raise_error(wrong)))
