"""Column functions for versioned key-value rows: typed values, sizes, checksums, little-endian integers, file names, bloom sizing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the on-disk formats.
KEY_HEADER = 10  # version (8 bytes) and key length (2 bytes)
VALUE_HEADER = 5  # type byte and payload length (4 bytes)
ENTRY_HEADER = KEY_HEADER + VALUE_HEADER
MAX_KEY = 65_535
TYPE_CODES = {"bytes": 0, "int": 2, "str": 1}
TOMBSTONE = "tombstone"


def payload_length(value_type: str = "value_type", v_bytes: str = "v_bytes", v_str: str = "v_str") -> Column:
    """Bytes of a value's payload: its own length for bytes and str, 8 for int, none for a tombstone."""
    kind = F.col(value_type)
    length = F.when(kind == "bytes", F.octet_length(v_bytes)).when(kind == "str", F.octet_length(v_str)).when(kind == "int", 8)
    return F.coalesce(length, F.lit(0)).cast("bigint")


def entry_size(key: str = "key", **columns: str) -> Column:
    """Bytes that a version takes in a log or run."""
    return F.lit(ENTRY_HEADER) + F.octet_length(key).cast("bigint") + payload_length(**columns)


def little_endian(number: Column, width: int) -> Column:
    """An integer as width bytes, least significant first."""
    digits = F.lpad(F.hex(number), 2 * width, "0") if width < 8 else F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.concat(*[F.unhex(F.substring(digits, 2 * i + 1, 2)) for i in reversed(range(width))])


def encoded_key(key: str = "key", lsn: str = "lsn") -> Column:
    return F.concat(little_endian(F.col(lsn), 8), little_endian(F.octet_length(key), 2), F.col(key))


def encoded_value(value_type: str = "value_type", v_bytes: str = "v_bytes", v_str: str = "v_str", v_int: str = "v_int") -> Column:
    """Type byte (bit 0: tombstone; above it the type), length, payload."""
    kind = F.col(value_type)
    code = F.when(kind == TOMBSTONE, 1)
    for name, number in TYPE_CODES.items():
        code = code.when(kind == name, 2 * number)
    payload = F.when(kind == "bytes", F.col(v_bytes)).when(kind == "str", F.encode(v_str, "UTF-8"))
    payload = F.coalesce(payload.when(kind == "int", little_endian(F.col(v_int), 8)), F.lit(b""))
    return F.concat(little_endian(code, 1), little_endian(F.octet_length(payload), 4), payload)


def encoded_entry() -> Column:
    """A log entry: CRC-32 of key and value, key, value."""
    body = F.concat(encoded_key(), encoded_value())
    return F.concat(little_endian(F.crc32(body), 4), body)


def checksum_holds(body: str = "body", stored: str = "crc") -> Column:
    return F.crc32(F.col(body)) == F.col(stored)


def file_name(number: Column, suffix: str) -> Column:
    """Number with at least five digits, and a suffix."""
    return F.concat(F.format_string("%05d", number.cast("bigint")), F.lit(f".{suffix}"))


def file_number(path: Column, suffix: str) -> Column:
    """The number in a file name, null if the path names no such file."""
    digits = F.regexp_extract(path, rf"(?:^|/)(\d+)\.{suffix}$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a bloom filter for so many items at a rate of false positives."""
    bits = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
    return bits, math.ceil(math.log(2) * bits / items)


def bloom_columns(items: Column, rate: float) -> tuple[Column, Column]:
    """bloom_size() for a column of numbers of items."""
    bits = F.ceil(-items * F.lit(math.log(rate)) / F.lit(math.log(2) ** 2))
    return bits.cast("bigint"), F.ceil(F.lit(math.log(2)) * bits / items).cast("bigint")


def level_target(level: Column, base: int, factor: int = 10) -> Column:
    """Bytes at which a level is compacted: base * factor ** level."""
    return F.lit(base).cast("bigint") * F.pow(F.lit(factor), level).cast("bigint")
