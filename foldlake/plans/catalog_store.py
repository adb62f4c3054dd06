"""Registered queries of the store, the binary formats, the codecs and the streaming append, and the SQL that must give the same rows.

The log is that of catalog.py, with keys and values as the store holds them (binary). Stores and files lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.functions import codec
from foldlake.operators import levels, merge, model, recovery
from foldlake.plans import catalog
from foldlake.plans.catalog import BYTES_SQL, COLUMNS, FILES_SQL, LOG_SQL, RANKED_SQL, RUNS_SQL, log, query, runs
from foldlake.plans.store import CommitConflict, Manifest, Store, StoreNotFound
from foldlake.sources import binary
from foldlake.sources.shipping import shared_path
from foldlake.streaming import stream


def as_model(df: DataFrame) -> DataFrame:
    """Rows of the catalog's log as rows of the store's."""
    return df.withColumns({
        "key": F.encode("k", "UTF-8"), "value_type": F.col("vt"), "v_bytes": F.unhex("v_hex"), "tombstone": F.col("tomb"),
    }).drop("k", "vt", "v_hex", "tomb")


def from_model(df: DataFrame) -> DataFrame:
    shown = {"k": F.decode("key", "UTF-8"), "tomb": F.col("tombstone"), "vt": F.col("value_type"), "v_hex": F.hex("v_bytes")}
    return df.withColumns(shown).drop("key", "tombstone", "value_type", "v_bytes")


def store_of(spark: SparkSession, d: str, parts: int = 4, **how) -> Store:
    """A store into which the log was put in `parts` batches of consecutive versions, which are those of the log."""
    store = Store.create(spark, shared_path(spark, "store"), **how)
    df = log(spark, d)
    top = df.agg(F.max("lsn")).first()[0] or 0
    for i in range(parts):
        store.put(as_model(df.where(f"lsn > {top * i // parts} and lsn <= {top * (i + 1) // parts}")), ["lsn"])
    return store


LIVE_SQL = f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb"


# the store


@query("SELECT * FROM (VALUES (0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)) m(version, next_id, n_segments)")
def store_manifests(spark, d):
    """An opened store finds the newest manifest of those that its writes left."""
    store = Store.open(spark, store_of(spark, d).folder)
    found = [store.manifest(v) for v in store.versions()]
    return spark.createDataFrame([(m.version, m.next_id, len(m.segments)) for m in found], "version int, next_id int, n_segments int")


@query(LIVE_SQL)
def store_roundtrip(spark, d):
    return from_model(Store.open(spark, store_of(spark, d).folder).read())


@query(f"WITH {LOG_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lsn DESC) AS rn FROM log WHERE lsn <= 5000) SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb")
def store_as_of(spark, d):
    store = store_of(spark, d)
    store.flush()
    return from_model(store.read(as_of=5000))


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE k = '11' AND rn = 1 AND NOT tomb")
def store_point_get(spark, d):
    store = store_of(spark, d)
    store.flush(target=50_000)
    return from_model(store.get(b"11"))


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb AND k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)")
def store_multi_get(spark, d):
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("key"))
    return from_model(store_of(spark, d).multi_get(keys))


@query(
    f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb AND k NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)"
)
def store_delete(spark, d):
    """A delete in a newer segment hides what lies in an older run."""
    store = store_of(spark, d, 1)
    store.flush()
    poor = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0")
    store.delete(poor.select(F.encode(F.col("c_custkey").cast("string"), "UTF-8").alias("key")))
    return from_model(store.read())


@query(f"WITH {RUNS_SQL} SELECT 0 AS tier, count(*) AS n_rows, count(DISTINCT k) AS n_keys, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM runs")
def store_flush(spark, d):
    """All versions lie in level 0 after a flush, and files don't share keys."""
    store = store_of(spark, d)
    store.flush(target=50_000)
    rows = store.log().groupBy("tier").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("key").alias("n_keys"), F.sum(codec.entry_size()).alias("n_bytes"))
    files = store.files()
    apart = files.alias("a").join(files.alias("b"), (F.col("a.file_id") < F.col("b.file_id")) & (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("b.min_key") <= F.col("a.max_key")))
    return rows if apart.isEmpty() else rows.where("false")


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS}, 1 AS tier FROM ranked WHERE rn = 1 AND NOT tomb")
def store_compact_l0(spark, d):
    store = store_of(spark, d)
    store.flush(target=50_000)
    store.compact(0, target=50_000)
    return from_model(store.log())


@query(
    f"WITH {LOG_SQL}, half AS (SELECT max(lsn) // 2 AS h FROM log), ranked AS (SELECT *, row_number() OVER (PARTITION BY k, lsn > h ORDER BY lsn DESC) AS rn FROM log, half)"
    f" SELECT {COLUMNS}, CASE WHEN lsn > h THEN 1 ELSE 2 END AS tier FROM ranked WHERE rn = 1 AND (lsn > h OR NOT tomb)"
)
def store_levels(spark, d):
    """The older half of the log at level 2, without tombstones; the newer at level 1, with those that hide keys below."""
    store = Store.create(spark, shared_path(spark, "store"))
    df = log(spark, d)
    half = (df.agg(F.max("lsn")).first()[0] or 0) // 2
    for part, depth in ((df.where(f"lsn <= {half}"), 2), (df.where(f"lsn > {half}"), 1)):
        store.put(as_model(part), ["lsn"])
        store.flush()
        for level in range(depth):
            store.compact(level, room=0)
    return from_model(store.log())


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS}, 2 AS tier FROM ranked WHERE rn = 1 AND NOT tomb")
def store_compact_ln(spark, d):
    """Both halves merged from level 1 into level 2, the lowest."""
    store = Store.create(spark, shared_path(spark, "store"))
    df = log(spark, d)
    half = (df.agg(F.max("lsn")).first()[0] or 0) // 2
    for part in (df.where(f"lsn <= {half}"), df.where(f"lsn > {half}")):
        store.put(as_model(part), ["lsn"])
        store.flush()
        store.compact(0)
        store.compact(1, room=0)
    return from_model(store.log())


@query(LIVE_SQL)
def store_maintain(spark, d):
    """Rotated tables are flushed and due levels compacted; reads don't change."""
    store = store_of(spark, d, 6, memtable_bytes=1)
    store.maintain(target=50_000, base=1000)
    return from_model(store.read())


@query("SELECT * FROM (VALUES ('runs', 1), ('segments', 4), ('files', 1)) g(kind, n)")
def store_gc(spark, d):
    """Four segments, the first run and its table of files: not referred to any more once they are merged and another manifest has followed."""
    store = store_of(spark, d)
    store.flush()
    store.compact(0)
    store.delete(spark.createDataFrame([(b"none",)], "key binary"))
    return store.gc_candidates().groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(
    f"WITH RECURSIVE {RUNS_SQL}, b AS (SELECT 4 - run AS version, CAST(sum(bytes) AS BIGINT) AS bytes FROM runs GROUP BY run), t(version, epoch, held) AS ("
    "SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT t.version + 1, t.epoch + CASE WHEN held + bytes >= 100000 THEN 1 ELSE 0 END,"
    " CASE WHEN held + bytes >= 100000 THEN 0 ELSE held + bytes END FROM t JOIN b ON b.version = t.version + 1) SELECT version, epoch FROM t"
)
def store_rotation(spark, d):
    """The table of recent writes is rotated by the write that brings it to its bytes."""
    store = store_of(spark, d, memtable_bytes=100_000)
    return spark.createDataFrame([(v, store.manifest(v).epoch) for v in store.versions()], "version long, epoch long")


@query(
    "SELECT * FROM (VALUES ('no store', 'StoreNotFound'), ('manifest is garbage', 'CorruptData'), ('rivals win', 'CommitConflict'),"
    " ('key is too long', 'longer than'), ('log is garbage', 'CorruptData'), ('checksum', 'CorruptData'), ('missing key', 'no row')) e(what, found)"
)
def error_surface(spark, d):
    store = Store.create(spark, shared_path(spark, "store"))
    store.put(spark.createDataFrame([(b"a",)], "key binary").select("key", *model.str_(F.lit("x"))))

    def rivals(m):
        store._write_manifest(Manifest(version=m.version + 1, next_lsn=m.next_lsn))
        return m

    def garbage():
        binary.write_files(spark.createDataFrame([("00009.json", b"not a manifest")], "name string, content binary"), f"{other.folder}/manifests")
        other.manifest()

    other = Store.create(spark, shared_path(spark, "store"))
    long = spark.createDataFrame([("k" * 65_536,)], "k string").select(F.encode("k", "UTF-8").alias("key"), *model.str_(F.lit("x")))
    entry = bytes(spark.range(1).select(F.lit(b"k").alias("key"), F.lit(1).cast("bigint").alias("lsn"), *model.str_(F.lit("v"))).select(codec.encoded_entry()).first()[0])
    cases = {
        "no store": lambda: Store.open(spark, shared_path(spark, "nothing")),
        "manifest is garbage": garbage,
        "rivals win": lambda: store.commit(rivals),
        "key is too long": lambda: store.put(long),
        "log is garbage": lambda: list(binary.decode_log(b"not a log")),
        "checksum": lambda: list(binary.decode_log(binary.LOG_MAGIC.to_bytes(4, "little") + entry[:-1] + b"w")),
        "missing key": lambda: store.get(b"b").collect(),
    }
    out = []
    for name, case in cases.items():
        try:
            got = "no row" if case() == [] else "nothing"
        except (StoreNotFound, CommitConflict, binary.CorruptData) as e:
            got = type(e).__name__
        except Exception as e:  # of a task, as Spark reports it
            got = "longer than" if "longer than" in str(e) else "another error"
        out.append((name, got))
    return spark.createDataFrame(out, "what string, found string")


# binary formats and codecs


def logs_of(spark: SparkSession, d: str, torn: int = 0) -> str:
    """A folder of binary logs, one for each remainder of keys, each with `torn` bytes cut off."""
    folder = shared_path(spark, "logs")
    df = as_model(log(spark, d)).withColumn("log_id", (F.decode("key", "UTF-8").cast("int") % 4))
    entries = df.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("lsn", F.hex(codec.encoded_entry()).alias("entry")))).alias("entries"))  # a log is bounded
    body = F.unhex(F.concat(F.lit("BEBAFECA"), F.array_join("entries.entry", "")))
    content = F.expr(f"substring(body, 1, length(body) - {torn})")
    files = entries.withColumn("body", body).select(codec.file_name(F.col("log_id"), "wal").alias("name"), content.alias("content"))
    binary.write_files(files, folder)
    return folder


@query(f"WITH {LOG_SQL} SELECT {COLUMNS}, CAST(k AS BIGINT) % 4 AS log_id FROM log")
def wal_roundtrip(spark, d):
    rows = binary.read_logs(spark, logs_of(spark, d))
    return from_model(rows.withColumn("log_id", codec.file_number(F.col("file"), "wal")).drop("file", "offset"))


@query(f"WITH {LOG_SQL}, t AS (SELECT *, max(lsn) OVER (PARTITION BY CAST(k AS BIGINT) % 4) AS top FROM log) SELECT {COLUMNS} FROM t WHERE lsn < top")
def wal_torn_tail(spark, d):
    """Without its last byte, a log ends before its last entry."""
    return from_model(binary.read_logs(spark, logs_of(spark, d, 1)).drop("file", "offset"))


@query(f"WITH {LOG_SQL}, t AS (SELECT CAST(k AS BIGINT) % 4 AS id, sum({BYTES_SQL} + 4) + 4 AS n FROM log GROUP BY 1) SELECT 'wal' AS kind, id AS file_id, CAST(n AS BIGINT) AS length FROM t")
def folder_listing(spark, d):
    return binary.listing(spark, logs_of(spark, d)).select("kind", F.col("file_id").cast("bigint").alias("file_id"), "length")


@query(f"WITH {LOG_SQL} SELECT lsn FROM log WHERE (lsn - 1) % 10 <> 0")
def checksums_hold(spark, d):
    """Of entries with a stored checksum, those that it fits; every tenth has another byte."""
    df = as_model(log(spark, d))
    body = F.concat(codec.encoded_key(), codec.encoded_value())
    held = df.select("lsn", body.alias("body"), F.crc32(body).alias("crc"))
    held = held.withColumn("body", F.when((F.col("lsn") - 1) % 10 == 0, F.concat("body", F.lit(b"\x00"))).otherwise(F.col("body")))
    return held.where(codec.checksum_holds()).select("lsn")


def _le(n: str, width: int) -> str:
    """SQL for the hex digits of a number's bytes, least significant first."""
    return f"array_to_string([printf('%02X', ({n} >> (8 * i)) & 255) for i in range({width})], '')"


_CRC_TABLE = "list_transform(range(256), lambda n: {})".format("list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)")
_PAYLOAD = "CASE vt WHEN 'int' THEN {} WHEN 'str' THEN hex(encode(v_str)) WHEN 'bytes' THEN v_hex ELSE '' END".format(_le("v_int", 8))


@query(
    f"WITH {LOG_SQL}, crc AS (SELECT {_CRC_TABLE} AS t), p AS (SELECT *, {_PAYLOAD} AS payload FROM log),"
    f" e AS (SELECT k, lsn, {_le('lsn', 8)} || {_le('length(k)', 2)} || hex(encode(k)) || CASE vt WHEN 'tombstone' THEN '01' WHEN 'str' THEN '02' WHEN 'int' THEN '04' ELSE '00' END"
    f" || {_le('length(payload) // 2', 4)} || payload AS body FROM p),"
    " c AS (SELECT k, lsn, body, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || substr(body, 2 * i + 1, 2) AS BIGINT) for i in range(length(body) // 2)]),"
    " lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS sum FROM e, crc)"
    f" SELECT k, lsn, {_le('sum', 4)} || body AS entry FROM c"
)
def encode_entry_hex(spark, d):
    df = log(spark, d)
    return as_model(df).select(F.decode("key", "UTF-8").alias("k"), "lsn", F.hex(codec.encoded_entry()).alias("entry"))


@query(f"WITH {RUNS_SQL} SELECT {COLUMNS}, run FROM runs")
def run_roundtrip(spark, d):
    """Sorted runs written in the binary format, with their blocks, index and footer, and read back."""
    folder = shared_path(spark, "runs")
    binary.write_files(binary.run_files(as_model(runs(spark, d))), folder)
    rows = binary.read_runs(spark, folder)
    return from_model(rows.withColumn("run", codec.file_number(F.col("file"), "sst")).drop("file", "offset"))


@query(f"WITH {FILES_SQL} SELECT level, file_id, file_size, min_key, max_key, 3 AS n_wals FROM files")
def manifest_roundtrip(spark, d):
    folder = shared_path(spark, "manifests")
    held: list[list[dict]] = [[], []]
    for r in catalog.as_files(spark, d).orderBy("level", "min_key").collect():  # metadata of four runs
        held[r.level].append({"file_id": r.file_id, "file_size": r.file_size, "min": (r.min_key.encode(), 0), "max": (r.max_key.encode(), 0)})
    content = binary.encode_manifest({"wals": [1, 2, 3], "levels": held})
    binary.write_files(spark.createDataFrame([("00001.mf", content)], "name string, content binary"), folder)
    keys = {c: F.decode(c, "UTF-8").alias(c) for c in ("min_key", "max_key")}
    return binary.read_manifests(spark, folder).select("level", F.col("file_id").cast("bigint").alias("file_id"), "file_size", *keys.values(), F.size("wals").alias("n_wals"))


@query(
    "SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') || CASE WHEN p_size % 2 = 0 THEN '.sst' ELSE '.wal' END AS name,"
    " CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS BIGINT) END AS sst FROM part"
)
def file_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    name = F.when(F.col("p_size") % 2 == 0, codec.file_name(F.col("p_partkey"), "sst")).otherwise(codec.file_name(F.col("p_partkey"), "wal"))
    return part.select("p_partkey", name.alias("name"), codec.file_number(F.concat(F.lit("some/folder/"), name), "sst").alias("sst"))


@query("SELECT DISTINCT p_size * 1000 AS items, CAST(ceil(-(p_size * 1000) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(ceil(ln(2) * ceil(-(p_size * 1000) * ln(0.01) / (ln(2) * ln(2))) / (p_size * 1000)) AS BIGINT) AS hashes FROM part")
def bloom_sizes(spark, d):
    items = (F.col("p_size") * 1000).alias("items")
    sizes = spark.read.parquet(f"{d}/part.parquet").select(items).distinct()
    bits, hashes = codec.bloom_columns(F.col("items"), 0.01)
    return sizes.select("items", bits.alias("bits"), hashes.alias("hashes"))


@query(
    "SELECT kind, count(*) AS n, CAST(sum(15 + length(p_name) + payload) AS BIGINT) AS bytes FROM (SELECT p_name, unnest(['bytes', 'str', 'int', 'tombstone']) AS kind,"
    " unnest([length(p_brand), length(p_type), 8, 0]) AS payload FROM part) GROUP BY kind"
)
def value_encoders(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("key", F.encode("p_name", "UTF-8"))
    kinds = (model.bytes_(F.encode("p_brand", "UTF-8")), model.str_(F.col("p_type")), model.int_(F.col("p_size")), model.tombstone_())
    rows = merge.union_runs([part.select("key", F.lit(1).cast("bigint").alias("lsn"), *k) for k in kinds])
    return model.checked(rows).groupBy(F.col("value_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(codec.entry_size()).alias("bytes"))


# order, cuts, positions


@query("SELECT p_partkey, row_number() OVER (ORDER BY md5(p_name || p_partkey)) - 1 AS place FROM part")
def binary_key_order(spark, d):
    """Binary keys are ordered by their bytes, which count from 0 to 255."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.unhex(F.md5(F.concat("p_name", F.col("p_partkey").cast("string")))).alias("key"))
    return merge.places(part, ["key"], "place").select("p_partkey", "place")


def _greedy_sql(source: str, part: str, order: str, limit: int) -> str:
    """SQL for cuts that end with the row that brings them to limit, as jumps from cut to cut."""
    return f"""WITH RECURSIVE {source}, s AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS i,
  CAST(sum(bytes) OVER (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM src),
cuts(p, cut_no, first, last, done) AS (
  SELECT p, CAST(0 AS BIGINT), CAST(1 AS BIGINT), coalesce(min(i) FILTER (upto >= {limit}), max(i)), coalesce(min(upto) FILTER (upto >= {limit}), max(upto))
  FROM (SELECT {part} AS p, i, upto FROM s) GROUP BY p
  UNION ALL
  SELECT p, cut_no + 1, last + 1, l, (SELECT max(upto) FROM s WHERE s.{part} = n.p AND s.i = n.l) FROM (
    SELECT c.p, c.cut_no, c.last, (SELECT coalesce(min(i) FILTER (upto - c.done >= {limit}), max(i)) FROM s WHERE s.{part} = c.p AND s.i > c.last) AS l FROM cuts c) n
  WHERE l IS NOT NULL)
SELECT s.{part} AS part, cut_no, min({{key}}) AS min_key, max({{key}}) AS max_key, count(*) AS n_rows, CAST(sum(bytes) AS BIGINT) AS n_bytes
FROM s JOIN cuts ON s.{part} = cuts.p AND s.i BETWEEN first AND last GROUP BY 1, 2"""


def _summed(cut: DataFrame, part: str, key: str) -> DataFrame:
    return cut.groupBy(F.col(part).alias("part"), "cut_no").agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("n_rows"), F.sum("bytes").alias("n_bytes")
    )


@query(_greedy_sql(f"{RUNS_SQL}, src AS (SELECT * FROM runs)", "run", "k, lsn DESC", 4096).format(key="k"))
def greedy_blocks_4k(spark, d):
    """Blocks of runs, each closed by the entry that fills it."""
    return _summed(merge.greedy_cuts(runs(spark, d), 4096, [F.col("k"), F.desc("lsn")], "run"), "run", "k")


@query(_greedy_sql(f"{RUNS_SQL}, src AS (SELECT run, k, CAST(sum(bytes) AS BIGINT) AS bytes FROM runs GROUP BY run, k)", "run", "k", 16384).format(key="k"))
def greedy_files_16k(spark, d):
    """Files of runs, each closed by the key that fills it; sums by key, so that no key is split."""
    keys = runs(spark, d).groupBy("run", "k").agg(F.sum("bytes").alias("bytes"))
    return _summed(merge.greedy_cuts(keys, 16384, [F.col("k")], "run"), "run", "k")


@query(_greedy_sql(f"{RUNS_SQL}, src AS (SELECT * FROM runs)", "run", "lsn", 10_000).format(key="lsn"))
def greedy_rotation(spark, d):
    """Tables of recent writes, each rotated by the write that fills it; a segment is what one writer has."""
    return _summed(merge.greedy_cuts(runs(spark, d), 10_000, [F.col("lsn")], "run"), "run", "lsn")


def _listed(df: DataFrame, order: str) -> DataFrame:
    return merge.places(df, [order], "ordinal")


@query(
    "WITH t AS (SELECT n_name AS frozen, row_number() OVER (ORDER BY n_name) - 1 AS ordinal FROM nation), l AS (SELECT n_nationkey AS log_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal FROM nation)"
    " SELECT ordinal, frozen, log_id FROM t JOIN l USING (ordinal)"
)
def pair_by_place(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    tables, logs = nation.select(F.col("n_name").alias("frozen")), nation.select(F.col("n_nationkey").alias("log_id"))
    return recovery.pair_by_ordinal(_listed(tables, "frozen"), _listed(logs, "log_id"))


@query(
    "WITH t AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal FROM supplier) SELECT 'taken' AS part, s_suppkey, ordinal FROM t WHERE ordinal < 4"
    " UNION ALL SELECT 'left', s_suppkey, ordinal FROM t WHERE ordinal >= 4"
)
def take_and_skip(spark, d):
    """The first logs of a list, which a flush takes, and the ones it leaves."""
    at = _listed(spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey"), "s_suppkey")
    taken, left = (f(at, 4).withColumn("part", F.lit(name)) for f, name in ((recovery.take, "taken"), (recovery.skip, "left")))
    return taken.unionByName(left)


@query(f"WITH {catalog.RANGES_SQL} SELECT level, file_id, row_number() OVER (ORDER BY level, min_key) - 1 AS place FROM files")
def level_order(spark, d):
    """Files by level, and within a level by their least key."""
    return merge.places(catalog.key_ranges(spark, d), ["level", "min_key"], "place").select("level", "file_id", "place")


@query(
    "WITH m AS (SELECT o_custkey AS file_id, year(o_orderdate) AS version FROM orders) SELECT 'sst' AS kind, file_id FROM m WHERE version IN (SELECT DISTINCT version FROM m ORDER BY version DESC LIMIT 2)"
    " UNION SELECT 'sst', c_custkey FROM customer WHERE c_acctbal < 0"
)
def live_files(spark, d):
    """What the newest two manifests refer to, and what is held open."""
    manifests = spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").alias("version"), F.lit("sst").alias("kind"), F.col("o_custkey").alias("file_id"))
    held = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0").select(F.lit("sst").alias("kind"), F.col("c_custkey").alias("file_id"))
    return recovery.live_files(manifests, held)


@query(f"WITH {RUNS_SQL}, m AS (SELECT count(DISTINCT run) AS many FROM runs) SELECT u.k AS limit_, many > u.k AS due FROM m, (SELECT unnest(range(0, 8)) AS k) u")
def flush_due(spark, d):
    n = runs(spark, d).select("run").distinct().count()
    return spark.createDataFrame([(k, levels.flush_due(n, k)) for k in range(8)], "limit_ long, due boolean")


# streams


@query(LIVE_SQL)
def append_stream_replay(spark, d):
    """A stream appended to a store; its checkpoint is lost, and the batches that were committed aren't applied again."""
    rows = as_model(log(spark, d))
    source = shared_path(spark, "stream-source")
    rows.coalesce(1).sortWithinPartitions("lsn").drop("lsn").write.parquet(source)
    store = Store.create(spark, shared_path(spark, "store"))
    for _ in range(2):
        read = spark.readStream.schema(rows.drop("lsn").schema).parquet(source)
        stream.append_stream(read, store, shared_path(spark, "checkpoint"), name="events").awaitTermination()
    return from_model(store.read())


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb")
def stream_restart(spark, d):
    """A fold that stops between two files of its source goes on from its checkpoint; the newer rows come first."""
    df = log(spark, d)
    half = (df.agg(F.max("lsn")).first()[0] or 0) // 2
    source, out, checkpoint = (shared_path(spark, f"stream-{k}") for k in ("source", "out", "checkpoint"))
    for part in (df.where(f"lsn > {half}"), df.where(f"lsn <= {half}")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream.run_fold(spark.readStream.schema(df.schema).parquet(source), out, checkpoint, "k").awaitTermination()
    return stream.folded(spark, out, "k").where("not tomb")
