"""Readers of the binary log, run and manifest formats (all integers little-endian).

Files are read whole by Spark's binaryFile source, so any file system that Spark knows will do, and are decoded where they land: one
task can hold one log, whose size is bounded by rotation, or one run, whose size is bounded by the file target.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from foldlake.sources.shipping import ship

# Fixed values of the formats.
LOG_MAGIC = 0xCAFEBABE
RUN_MAGIC = b"\x41\x42\x43\x44"
RUN_FOOTER = 24
MANIFEST_MAGIC = b"ELSM"
MANIFEST_HEADER = 24
BLOCK_BYTES = 4096
VALUE_TYPES = {0: "bytes", 1: "str", 2: "int"}

ENTRY_SCHEMA = (
    "file string, offset long, key binary, lsn long, value_type string, v_bytes binary, v_str string, v_int long, tombstone boolean"
)


class CorruptData(Exception):
    """A checksum, a magic number or a length doesn't hold."""


class Torn(Exception):
    """The data end within an entry."""


class Cursor:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise Torn
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "little")

    def key(self) -> tuple[bytes, int]:
        lsn = self.number(8)
        return self.take(self.number(2)), lsn

    def value(self) -> dict:
        meta = self.number(1)
        payload = self.take(self.number(4))
        out = {"value_type": "tombstone", "v_bytes": None, "v_str": None, "v_int": None, "tombstone": bool(meta & 1)}
        if out["tombstone"]:
            return out
        kind = VALUE_TYPES.get(meta >> 1)
        if kind == "bytes":
            out["v_bytes"] = payload
        elif kind == "str":
            try:
                out["v_str"] = payload.decode("utf-8")
            except UnicodeDecodeError as e:
                raise CorruptData("a string value isn't UTF-8") from e
        elif kind == "int" and len(payload) == 8:
            (out["v_int"],) = struct.unpack("<q", payload)
        else:
            raise CorruptData(f"value type {meta >> 1} with {len(payload)} bytes")
        return out | {"value_type": kind}


def decode_log(data: bytes) -> Iterator[dict]:
    """Entries of a log. A torn tail ends it; a wrong checksum is an error."""
    if not data:
        return
    if len(data) < 4 or int.from_bytes(data[:4], "little") != LOG_MAGIC:
        raise CorruptData("not a log")
    at = Cursor(data, 4)
    while at.at < at.end:
        start = at.at
        try:
            crc = at.number(4)
            key, lsn = at.key()
            value = at.value()
        except Torn:
            return
        if zlib.crc32(data[start + 4 : at.at]) != crc:
            raise CorruptData(f"checksum at {start}")
        yield {"offset": start, "key": key, "lsn": lsn, **value}


def _section(data: bytes, offset: int) -> bytes:
    at = Cursor(data, offset)
    try:
        size, crc = at.number(4), at.number(4)
        body = at.take(size)
    except Torn as e:
        raise CorruptData(f"section at {offset} is cut off") from e
    if zlib.crc32(body) != crc:
        raise CorruptData(f"checksum of the section at {offset}")
    return body


def decode_run(data: bytes) -> Iterator[dict]:
    """Entries of a sorted run, block by block as its index lists them. Tombstones are returned."""
    if len(data) < RUN_FOOTER or data[-4:] != RUN_MAGIC:
        raise CorruptData("not a run")
    footer = data[-RUN_FOOTER:]
    if zlib.crc32(footer[:16]) != int.from_bytes(footer[16:20], "little"):
        raise CorruptData("checksum of the footer")
    index = Cursor(_section(data, int.from_bytes(footer[:8], "little")))
    index.key(), index.key()
    while index.at < index.end:
        index.key(), index.key()
        offset = index.number(8)
        block = Cursor(_section(data, offset))
        while block.at < block.end:
            start = block.at
            key, lsn = block.key()
            yield {"offset": offset + 8 + start, "key": key, "lsn": lsn, **block.value()}


def decode_manifest(data: bytes) -> dict:
    """{wals, levels: [[file]]} of a manifest; a file has file_id, file_size, and its least and largest (key, lsn)."""
    if len(data) < MANIFEST_HEADER or data[:4] != MANIFEST_MAGIC:
        raise CorruptData("not a manifest")
    crc, size, form, n_wals, n_levels = struct.unpack("<5I", data[4:MANIFEST_HEADER])
    body = data[MANIFEST_HEADER : MANIFEST_HEADER + size]
    if form != 0:
        raise CorruptData(f"format {form}")
    if len(body) != size or zlib.crc32(body) != crc:
        raise CorruptData("checksum of the manifest")
    at = Cursor(body)
    try:
        wals = [at.number(4) for _ in range(at.number(4))]
        levels = []
        for _ in range(at.number(4)):
            files = []
            for _ in range(at.number(4)):
                file_id, file_size = at.number(4), at.number(4)
                files.append({"file_id": file_id, "file_size": file_size, "min": at.key(), "max": at.key()})
            levels.append(files)
    except Torn as e:
        raise CorruptData("the manifest is cut off") from e
    if (len(wals), len(levels)) != (n_wals, n_levels):
        raise CorruptData("counts of the manifest")
    return {"wals": wals, "levels": levels}


def _number(n: int, width: int) -> bytes:
    return n.to_bytes(width, "little")


def encode_key(key: bytes, lsn: int) -> bytes:
    return _number(lsn, 8) + _number(len(key), 2) + key


def encode_value(row: dict) -> bytes:
    kind = row["value_type"]
    if row["tombstone"]:
        return _number(1, 1) + _number(0, 4)
    code = next(k for k, name in VALUE_TYPES.items() if name == kind)
    payload = {"bytes": lambda: bytes(row["v_bytes"]), "str": lambda: row["v_str"].encode(), "int": lambda: struct.pack("<q", row["v_int"])}[kind]()
    return _number(code << 1, 1) + _number(len(payload), 4) + payload


def _sectioned(body: bytes) -> bytes:
    return _number(len(body), 4) + _number(zlib.crc32(body), 4) + body


def encode_run(rows: Iterable[dict], block_bytes: int = BLOCK_BYTES) -> bytes:
    """The file of a sorted run: blocks, the index over them, a section for a filter (left empty: ours is Parquet's), the footer.

    rows come in the order of keys, newest version first; a block ends with the row that brings it to block_bytes.
    """
    out, index, block, first, last = bytearray(), bytearray(), bytearray(), None, None
    least = most = None

    def close() -> None:
        nonlocal block, first
        index.extend(first + last + _number(len(out), 8))
        out.extend(_sectioned(bytes(block)))
        block, first = bytearray(), None

    for r in rows:
        last = encode_key(bytes(r["key"]), r["lsn"])
        first = first or last
        least, most = least or last, last
        block += last + encode_value(r)
        if len(block) >= block_bytes:
            close()
    if block:
        close()
    where = len(out)
    none = encode_key(b"", 0)
    out += _sectioned((least or none) + (most or none) + bytes(index))
    tail = _number(where, 8) + _number(len(out), 8)
    return bytes(out) + _sectioned(b"") + tail + _number(zlib.crc32(tail), 4) + RUN_MAGIC


def encode_manifest(manifest: dict) -> bytes:
    """The file of {wals, levels}, as decode_manifest gives it."""
    body = bytearray(_number(len(manifest["wals"]), 4))
    for w in manifest["wals"]:
        body += _number(w, 4)
    body += _number(len(manifest["levels"]), 4)
    for files in manifest["levels"]:
        body += _number(len(files), 4)
        for f in files:
            body += _number(f["file_id"], 4) + _number(f["file_size"], 4) + encode_key(*f["min"]) + encode_key(*f["max"])
    numbers = (zlib.crc32(bytes(body)), len(body), 0, len(manifest["wals"]), len(manifest["levels"]))
    return MANIFEST_MAGIC + struct.pack("<5I", *numbers) + bytes(body)


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows (name, content) as files of any file system that Spark knows, one at a time by the driver: an export of bounded files."""
    spark = files.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in files.select("name", "content").toLocalIterator():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}"), True)
        out.write(bytearray(r["content"]))
        out.close()


def run_files(rows: DataFrame, run: str = "run", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(name, content) of the runs that rows of the log lie in; a run is bounded by the file target."""
    ship(rows.sparkSession)

    def build(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["key", "lsn"], ascending=[True, False])
        ints = pdf["v_int"].astype("Int64")
        own = (r | {"v_int": None if pd.isna(i) else int(i)} for r, i in zip(pdf.to_dict("records"), ints))
        return pd.DataFrame({"name": [f"{key[0]:05d}.sst"], "content": [encode_run(own, block_bytes)]})

    return rows.groupBy(run).applyInPandas(build, "name string, content binary")


def _read(spark: SparkSession, path: str, pattern: str, decode) -> DataFrame:
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def entries(batches):
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                rows = pd.DataFrame(list(decode(bytes(data))), columns=["offset", "key", "lsn", "value_type", "v_bytes", "v_str", "v_int", "tombstone"])
                rows["v_int"] = rows["v_int"].astype("Int64")
                rows.insert(0, "file", name)
                yield rows

    return files.mapInPandas(entries, ENTRY_SCHEMA)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all *.wal files under path, one task a file."""
    return _read(spark, path, "*.wal", decode_log)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all *.sst files under path."""
    return _read(spark, path, "*.sst", decode_run)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(kind, file_id, path, length) of the logs, runs and manifests in a folder, empty ones too, without opening them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = []
    for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
        if m := re.fullmatch(r"(\d+)\.(wal|sst|mf)", f.getPath().getName()):
            found.append((m[2], int(m[1]), f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(found, "kind string, file_id int, path string, length long")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(manifest, wals, level, file_id, file_size, min_key, min_lsn, max_key, max_lsn): a row for each file of all *.mf under path."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mf").load(path).select("path", "content")

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                m = decode_manifest(bytes(data))
                own = [(name, m["wals"], k, f["file_id"], f["file_size"], *f["min"], *f["max"]) for k, files in enumerate(m["levels"]) for f in files]
                yield pd.DataFrame(own, columns=["manifest", "wals", "level", "file_id", "file_size", "min_key", "min_lsn", "max_key", "max_lsn"])

    return files.mapInPandas(rows, "manifest string, wals array<int>, level int, file_id int, file_size long, min_key binary, min_lsn long, max_key binary, max_lsn long")
