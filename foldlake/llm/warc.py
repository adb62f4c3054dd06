"""Web archives and a two-level capture index over them.

Writing. Pages are dealt to shards by size; a shard is one compressed WARC/1.1 file, each record a gzip member of its own. A member's
bytes are a text row and the row separator is an empty member, so Spark's text writer produces the archive on any file system and any
gzip reader reads it; offsets are running sums of member lengths within a shard. Of pages with equal payloads (at least LEAST_REVISIT bytes) the one with the smallest id is stored as a
response, and the others are revisit records that refer to it.

Index. An entry is (key, page id, shard, offset, length, payload digest), its key the url with its host reversed by labels. Entries
are sorted by key across the whole index by a range partitioning, and cut into blocks of BLOCK_ENTRIES lines or more, each compressed
with zlib. The directory keeps the first (key, page id) of each block. The number of lines in a block grows with the index so that
the directory has at most DIRECTORY_ENTRIES blocks and one short block a partition; keys are cut to KEY_CHARS (a digest stands for the
rest), so the directory has a proven bound of about 20 MB and can be broadcast or held by a client.

Reading. A lookup binary-searches the directory, opens one block, binary-searches its lines, and reads the record's range of bytes.
`lookup` and `read_range` do so for a few urls from the driver with seeks; `locate` and `read_ranges` do it for a table of captures: a
join by block number brings queries to blocks, and one by shard brings the ranges found to the files, where each is decoded by itself.
Payload digests are verified; a record that is damaged, cut off or not where the index says fails the job, as does a missing shard.

Defined results: null html is an empty payload; a null url has the key '' ; rows with a null id are written, never refer to others
nor are referred to, and come back with a null id; repeated ids are separate records; an empty table gives empty archives. Columns
other than the three that are named aren't read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.llm.common import bytes_of, shared_path, small_batches, stored

LEAST_REVISIT = 100
SHARD_BYTES = 16 << 20
BLOCK_ENTRIES, DIRECTORY_ENTRIES, KEY_CHARS = 1000, 1 << 16, 256
END = b"\r\n\r\n"
GZIP = 31  # zlib's number for gzip framing
#: A gzip member without content: what the text writer puts after each record.
SEPARATOR = zlib.compressobj(9, zlib.DEFLATED, GZIP).flush()

ENTRY = "key string, page_id long, shard int, offset long, length long, digest string"
RECORD = (
    "shard int, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, stored_bytes long, intact boolean"
)


def reversed_key(url: str) -> Column:
    """`com,example,www)/path?query`: the host's labels from the last to the first, in lower case, without scheme and port."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#:]*(?::\d*)?([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), tail)
    key = F.when(u == "", "").otherwise(key)
    return F.when(F.length(key) <= KEY_CHARS, key).otherwise(F.concat(F.substring(key, 1, KEY_CHARS - 40), F.sha1(key.cast("binary"))))


def with_decisions(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to): narrow rows decide, the payloads meet their decision by page.

    Equal payloads are a grouped minimum by digest (combined before the shuffle), and only groups of several pages are joined back.
    """
    data = bytes_of(html)
    base = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    able = base.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = able.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    revisits = stored(first.select("digest", "first"), "equal-payloads")
    out = base.join(revisits, "digest", "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first")


def _header(date: str) -> Column:
    """The header block of a record, with the blank line after it."""
    revisit = F.col("refers_to").isNotNull()
    # a url may hold line ends, which a header can't; only these, and the sign that escapes them, are escaped
    safe = F.coalesce(F.col("url"), F.lit(""))
    for sign, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        safe = F.replace(safe, F.lit(sign), F.lit(code))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END.decode()))


@F.pandas_udf(T.BinaryType())
def _member(records: pd.Series) -> pd.Series:
    def gzip(record: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, GZIP)
        return c.compress(record) + c.flush()

    return records.map(gzip)


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, date: str = "2024-01-01T00:00:00Z", **names) -> DataFrame:
    """Write folder/shard=N/part-*, one file of WARC records a shard; returns the index's entries (a stored table).

    The records are compressed and shuffled once. The entries are taken from the files as they were written.
    """
    spark = pages.sparkSession
    small_batches(spark)
    decided = with_decisions(pages, **names)
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    record = _member(F.concat(_header(date).cast("binary"), payload, F.lit(END)))
    records = decided.select("page_id", "digest", record.alias("record"))
    total = pages.agg(F.sum(F.octet_length(F.col(names.get("html", "html"))))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    shard = F.pmod(F.xxhash64("page_id", "digest", F.xxhash64("record")), F.lit(shards)).cast("int")
    files = records.select(shard.alias("shard"), "page_id", "digest", F.col("record").cast("string").alias("record")).repartition(shards, "shard")
    files = files.sortWithinPartitions("shard", "page_id", "digest").select("shard", "record")
    files.write.partitionBy("shard").option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(folder)
    found = read_archives(spark, folder).select(reversed_key("url").alias("key"), "page_id", "shard", "offset", "length", F.col("payload_digest").alias("digest"))
    return stored(found, "warc-entries")


def member(data: bytes, offset: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at offset, fed in pieces so that what follows isn't copied."""
    c, at, out = zlib.decompressobj(GZIP), offset, []
    while not c.eof:
        if at >= len(data):
            raise ValueError(f"the record at {offset} is cut off")
        out.append(c.decompress(data[at : at + 65536]))
        at += 65536
    return b"".join(out), min(at, len(data)) - len(c.unused_data)


def parse(record: bytes) -> tuple[dict, bytes]:
    """(headers in lower case, payload) of a record."""
    end = record.index(END)
    lines = record[:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    headers = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in lines[1:]))
    start = end + len(END)
    stop = start + int(headers["content-length"])
    if record[stop:] != END:
        raise ValueError("content and length disagree")
    return headers, record[start:stop]


def described(headers: dict, payload: bytes) -> dict:
    page = lambda k: int(v) if (v := headers.get(k, "").removeprefix("<urn:page:").rstrip(">")) else None
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
    intact = kind == "revisit" or hashlib.sha256(payload).hexdigest() == digest
    return {
        "page_id": page("warc-record-id"), "url": unquote(headers["warc-target-uri"]), "record_type": kind,
        "refers_to": page("warc-refers-to"), "payload_bytes": int(headers["x-payload-length"]), "payload_digest": digest,
        "stored_bytes": len(payload), "intact": intact,
    }


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, content) of all files under folder; a row holds a whole shard."""
    small_batches(spark)  # spark.sql.files.maxPartitionBytes bounds how many meet in a batch
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_extract("path", r"shard=(\d+)/[^/]*$", 1).cast("int").alias("shard"), "content")


def _record(shard: int, offset: int, data: bytes, at: int) -> tuple[dict, int]:
    """RECORD and end of the member at a place of data, which is verified."""
    try:
        content, end = member(data, at)
        out = described(*parse(content))
    except (ValueError, KeyError, zlib.error) as e:
        raise ValueError(f"shard {shard}: the record at {offset} is damaged") from e
    if not out["intact"]:
        raise ValueError(f"shard {shard}: the payload at {offset} hasn't the digest of its header")
    return {"shard": shard, "offset": offset, "length": end - at, **out}, end


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """RECORD rows of all archives under folder, one record after the other."""

    def decode(batches):
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist()):
                at, rows = 0, []
                while at < len(data):
                    row, end = _record(shard, at, data, at)
                    rows.append(row)
                    at = end + len(SEPARATOR)
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)

    return _archives(spark, folder).mapInArrow(decode, RECORD)


def read_ranges(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """RECORD rows of entries (shard, offset, length): each range of a shard by itself, whatever lies between them."""
    wanted = entries.groupBy("shard").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))  # as many as a shard has records
    met = wanted.join(_archives(spark, folder), "shard", "left")

    def decode(batches):
        for batch in batches:
            for shard, ranges, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "ranges", "content"))):
                if data is None:
                    raise ValueError(f"shard {shard} is missing")
                rows = []
                for r in ranges:
                    row, end = _record(shard, r["offset"], data[r["offset"] : r["offset"] + r["length"]], 0)
                    if end != r["length"]:
                        raise ValueError(f"shard {shard}: the record at {r['offset']} isn't as long as its entry says")
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)

    return met.mapInArrow(decode, RECORD)


RECORD_ARROW = pa.schema(
    [("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("stored_bytes", pa.int64()), ("intact", pa.bool_())]
)


class CaptureIndex:
    """Compressed blocks of sorted entries (a stored table: block, first_key, first_page, n, data) and the directory over them."""

    def __init__(self, blocks: DataFrame) -> None:
        self.blocks = blocks
        # at most DIRECTORY_ENTRIES and one a partition, each of at most KEY_CHARS characters and two numbers
        rows = blocks.select("first_key", "first_page", "block").collect()
        self.directory = sorted((r[0], r[1], r[2]) for r in rows)

    @classmethod
    def build(cls, entries: DataFrame, block_entries: int = BLOCK_ENTRIES, directory_entries: int = DIRECTORY_ENTRIES) -> CaptureIndex:
        spark = entries.sparkSession
        n = entries.count()
        lines = max(block_entries, math.ceil(n / directory_entries))
        parts = max(1, min(4096, n // (4 * lines)))
        ready = entries.withColumn("page", F.coalesce("page_id", F.lit(-1)))
        ranged = ready.repartitionByRange(parts, "key", "page", "shard", "offset").sortWithinPartitions("key", "page", "shard", "offset")
        ranged = ranged.withColumn("part", F.spark_partition_id()).select("key", "page", "shard", "offset", "length", "digest", "part")
        small_batches(spark)

        def pack(batches):
            held, no, part = [], 0, None

            def block():
                lines_ = ("\t".join([quote(r[0], safe=""), *map(str, r[1:])]) for r in held)
                data = zlib.compress("\n".join(lines_).encode(), 6)
                return pa.RecordBatch.from_pydict(
                    {"block": [part << 32 | no], "first_key": [held[0][0]], "first_page": [held[0][1]], "n": [len(held)], "data": [data]},
                    schema=BLOCK_ARROW,
                )

            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in batch.schema.names]
                for *row, part in zip(*columns):
                    held.append(tuple(row))
                    if len(held) >= lines:
                        yield block()
                        held, no = [], no + 1
            if held:
                yield block()

        return cls(stored(ranged.mapInArrow(pack, BLOCK), "capture-index"))

    @staticmethod
    def unpack(data: bytes) -> list[tuple]:
        """Entries (key, page, shard, offset, length, digest) of a block."""
        rows = (line.split("\t") for line in zlib.decompress(data).decode().split("\n"))
        return [(unquote(r[0]), int(r[1]), int(r[2]), int(r[3]), int(r[4]), r[5]) for r in rows]

    @staticmethod
    def candidates(directory: list[tuple], key: str, page: int | None = None) -> list[int]:
        """Blocks that can hold the key (and page): from the last that begins before it to the last that begins at it."""
        low = (key, -2) if page is None else (key, page)
        high = (key, math.inf) if page is None else (key, page, math.inf)
        at = max(0, bisect_left(directory, low) - 1)
        return [directory[i][2] for i in range(at, bisect_right(directory, high))]

    def locate(self, captures: DataFrame) -> DataFrame:
        """ENTRY rows for captures (key, page_id): each query goes to its block by a binary search in the directory."""
        spark = captures.sparkSession
        small_batches(spark)
        directory = spark.sparkContext.broadcast(self.directory)

        def route(batches):
            held = directory.value
            for batch in batches:
                keys, pages, blocks = [], [], []
                for key, page in zip(batch.column("key").to_pylist(), batch.column("page").to_pylist()):
                    for block in CaptureIndex.candidates(held, key, page):
                        keys.append(key), pages.append(page), blocks.append(block)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pages, pa.int64()), pa.array(blocks, pa.int64())], names=["key", "page", "block"])

        wanted = captures.select("key", F.coalesce("page_id", F.lit(-1)).alias("page")).distinct()
        routed = wanted.mapInArrow(route, "key string, page long, block long")

        def search(queries, blocks):
            import pandas as pd

            found = []
            for data in blocks["data"]:
                lines = CaptureIndex.unpack(bytes(data))
                marks = [(r[0], r[1]) for r in lines]
                for q in zip(queries["key"], queries["page"]):
                    found += lines[bisect_left(marks, q) : bisect_right(marks, q)]
            out = pd.DataFrame(found, columns=["key", "page_id", "shard", "offset", "length", "digest"])
            out["page_id"] = out["page_id"].astype("Int64").mask(out["page_id"] < 0)
            return out

        return routed.groupBy("block").cogroup(self.blocks.select("block", "data").groupBy("block")).applyInPandas(search, ENTRY)

    def lookup(self, url_key: str) -> list[tuple]:
        """Entries of one key, reading only the blocks that can hold it."""
        wanted = self.candidates(self.directory, url_key)
        rows = self.blocks.where(F.col("block").isin(wanted)).select("data").collect()  # the blocks of one key
        return [e for r in rows for e in self.unpack(bytes(r[0])) if e[0] == url_key]


BLOCK = "block long, first_key string, first_page long, n long, data binary"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("first_key", pa.string()), ("first_page", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def read_range(spark: SparkSession, folder: str, shard: int, offset: int, length: int) -> tuple[dict, bytes]:
    """(headers, payload) of one record by a positioned read on any file system that Spark knows."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    file = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    stream = fs.open(file)
    try:
        stream.seek(offset)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()
    return parse(member(data, 0)[0])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives, then the index, then every capture looked up in the index, and the range of bytes read that lies there."""
    from foldlake.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_path(spark, "warc")
    entries = write_archives(pages, folder)
    index = CaptureIndex.build(entries)
    found = stored(index.locate(pages.select(reversed_key("url").alias("key"), "page_id")).select("shard", "offset", "length"), "captures-found")
    if (n := found.count()) != (all_ := pages.count()):
        raise ValueError(f"the index has {n} of {all_} captures")
    return read_ranges(spark, folder, found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
