"""Registered queries over the driver's tables, and the SQL that must give the same rows.

`events` is read as a change log: event_id + 1 is the version, the user the key, an error deletes. `orders`, `conversations` and
`lineitem` are logs too. Results avoid binary columns, so keys are strings and byte values are in hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.functions import codec
from foldlake.operators import fold, levels, merge, recovery
from foldlake.sources.shipping import shared_path
from foldlake.streaming import stream

VALUE = ["tomb", "vt", "v_str", "v_int", "v_hex"]


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def as_log(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    vt = F.when(kind == "error", "tombstone").when(kind == "signup", "str").when(kind == "purchase", "int").otherwise("bytes")
    return e.select(
        F.col("user_id").cast("string").alias("k"),
        (F.col("event_id") + 1).alias("lsn"),
        (kind == "error").alias("tomb"),
        vt.alias("vt"),
        F.when(kind == "signup", F.col("props")).alias("v_str"),
        F.when(kind == "purchase", F.round(F.col("value") * 100).cast("bigint")).alias("v_int"),
        F.when(kind.isin("click", "view"), F.hex(F.encode("props", "UTF-8"))).alias("v_hex"),
    )


def log(spark: SparkSession, d: str) -> DataFrame:
    return as_log(events(spark, d))


LOG_SQL = """log AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id + 1 AS lsn, event_type = 'error' AS tomb,
  CASE event_type WHEN 'error' THEN 'tombstone' WHEN 'signup' THEN 'str' WHEN 'purchase' THEN 'int' ELSE 'bytes' END AS vt,
  CASE WHEN event_type = 'signup' THEN props END AS v_str,
  CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END AS v_int,
  CASE WHEN event_type IN ('click', 'view') THEN hex(encode(props)) END AS v_hex FROM events)"""
RANKED_SQL = f"{LOG_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lsn DESC) AS rn FROM log)"
COLUMNS = "k, lsn, tomb, vt, v_str, v_int, v_hex"
BYTES_SQL = "15 + length(k) + CASE vt WHEN 'int' THEN 8 WHEN 'str' THEN length(v_str) WHEN 'bytes' THEN length(v_hex) // 2 ELSE 0 END"
#: The log as four runs of equal length, 0 the newest.
RUNS_SQL = f"""{LOG_SQL}, n AS (SELECT max(lsn) AS top FROM log),
runs AS (SELECT *, CAST({BYTES_SQL} AS BIGINT) AS bytes, CAST(3 - ((lsn - 1) * 4) // top AS BIGINT) AS run FROM log, n)"""
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def latest(df: DataFrame, at: int | None = None) -> DataFrame:
    return fold.latest(df, at, "k", "lsn", "tomb")


def sized(df: DataFrame) -> DataFrame:
    length = F.when(F.col("vt") == "int", 8).when(F.col("vt") == "str", F.octet_length("v_str")).when(F.col("vt") == "bytes", F.length("v_hex") / 2)
    return df.withColumn("bytes", (F.lit(codec.ENTRY_HEADER) + F.octet_length("k") + F.coalesce(length, F.lit(0))).cast("bigint"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    df = sized(log(spark, d))
    top = df.agg(F.max("lsn")).first()[0] or 1
    return df.withColumn("run", F.expr(f"3 - ((lsn - 1) * 4) div {top}"))


def as_files(spark: SparkSession, d: str) -> DataFrame:
    """The runs as the file metadata of a store: the two newest are files of level 0, the others of level 1."""
    meta = levels.run_metadata(runs(spark, d), "run", "k")
    return meta.select(
        F.when(F.col("run") < 2, 0).otherwise(1).alias("level"), F.col("run").alias("file_id"), "file_size", "min_key", "max_key"
    )


FILES_SQL = f"""{RUNS_SQL}, files AS (SELECT CASE WHEN run < 2 THEN 0 ELSE 1 END AS level, run AS file_id, CAST(sum(bytes) AS BIGINT) AS file_size,
  min(k) AS min_key, max(k) AS max_key FROM runs GROUP BY run)"""


def key_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Files with narrow ranges of keys: orders by customer, a file for each hundred customers. Some of one year are level 0."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    level = F.when((F.year("o_orderdate") == 1995) & (F.expr("o_custkey div 100") % 4 == 1), 0).otherwise(1)
    at = o.select(level.alias("level"), F.expr("o_custkey div 100").alias("slot"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("k"))
    files = at.groupBy("level", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))
    return files.select("level", (F.col("slot") * 2 + F.col("level")).alias("file_id"), (F.col("n") * 100).alias("file_size"), "min_key", "max_key")


RANGES_SQL = """files AS (SELECT level, slot * 2 + level AS file_id, count(*) * 100 AS file_size, min(k) AS min_key, max(k) AS max_key FROM
  (SELECT CASE WHEN year(o_orderdate) = 1995 AND (o_custkey // 100) % 4 = 1 THEN 0 ELSE 1 END AS level, o_custkey // 100 AS slot,
    lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS k FROM orders) GROUP BY level, slot)"""


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb")
def latest_live(spark, d):
    return latest(log(spark, d))


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND tomb")
def latest_deleted(spark, d):
    return fold.deleted(log(spark, d), None, "k", "lsn", "tomb")


@query(
    f"WITH {LOG_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lsn DESC) AS rn FROM log WHERE lsn <= 5000)"
    f" SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb"
)
def as_of_snapshot(spark, d):
    # the bound is set on the stored column, so that it reaches the scan
    return latest(as_log(fold.as_of(events(spark, d), 4999, "event_id")))


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE k = '11' AND rn = 1 AND NOT tomb")
def point_get(spark, d):
    # the key is looked for in the stored column, so that the predicate reaches the scan
    return fold.get(as_log(events(spark, d).where("user_id = 11")), F.lit("11"), None, "k", "lsn", "tomb")


@query(
    f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb"
    " AND k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)"
)
def multi_get(spark, d):
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("k"))
    return fold.multi_get(log(spark, d), keys, None, "k", "lsn", "tomb")


@query(f"WITH {RANKED_SQL} SELECT k, lsn, tomb, vt, rn AS rank FROM ranked")
def version_history(spark, d):
    return fold.history(log(spark, d).select("k", "lsn", "tomb", "vt"), "k").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {RUNS_SQL} SELECT k, lsn, run, row_number() OVER (ORDER BY k, lsn DESC) AS place FROM runs")
def merge_runs(spark, d):
    df = runs(spark, d).select("k", "lsn", "run")
    merged = merge.union_runs([df.where(F.col("run") == i) for i in range(4)])  # as many scans as there are runs
    at = merge.places(merged.withColumn("down", -F.col("lsn")), ["k", "down"])
    return at.select("k", "lsn", "run", (F.col("before") + 1).alias("place"))


@query(f"WITH {RUNS_SQL} SELECT CAST(sum(bytes) AS BIGINT) AS memtable_bytes, count(*) AS n_entries FROM runs")
def memtable_bytes(spark, d):
    return sized(log(spark, d)).agg(F.sum("bytes").alias("memtable_bytes"), F.count(F.lit(1)).alias("n_entries"))


@query(f"WITH {RANKED_SQL} SELECT vt, count(*) AS n FROM ranked WHERE rn = 1 GROUP BY vt")
def value_type_census(spark, d):
    return fold.newest(log(spark, d), "k").groupBy("vt").agg(F.count(F.lit(1)).alias("n"))


MORE_SQL = "SELECT k, lsn + 1000000000 AS lsn, false AS tomb, 'str' AS vt, 'over ' || k AS v_str, NULL AS v_int, NULL AS v_hex FROM log WHERE vt = 'int'"


@query(
    f"WITH {LOG_SQL}, more AS ({MORE_SQL}), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lsn DESC) AS rn FROM"
    f" (SELECT * FROM log UNION ALL SELECT * FROM more)) SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb"
)
def put_overwrite(spark, d):
    df = log(spark, d)
    more = df.where("vt = 'int'").select(
        "k", (F.col("lsn") + 1_000_000_000).alias("lsn"), F.lit(False).alias("tomb"), F.lit("str").alias("vt"),
        F.concat(F.lit("over "), "k").alias("v_str"), F.lit(None).cast("bigint").alias("v_int"), F.lit(None).cast("string").alias("v_hex"),
    )
    return latest(fold.put(df, more))


@query(
    f"WITH {LOG_SQL}, gone AS (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE c_acctbal < 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY"
    f" lsn DESC) AS rn FROM log) SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb AND k NOT IN (SELECT k FROM gone)"
)
def delete_hides_older_run(spark, d):
    df = log(spark, d)
    poor = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0")
    tomb = poor.select(
        F.col("c_custkey").cast("string").alias("k"), F.lit(2_000_000_000).cast("bigint").alias("lsn"), F.lit(True).alias("tomb"), F.lit("tombstone").alias("vt"),
        F.lit(None).cast("string").alias("v_str"), F.lit(None).cast("bigint").alias("v_int"), F.lit(None).cast("string").alias("v_hex"),
        F.lit(-1).alias("tier"),
    )
    return fold.tiered(df.withColumn("tier", F.lit(0)).unionByName(tomb), "tier", "k", "lsn", "tomb").select("k", "lsn", *VALUE)


@query(
    f"WITH {RUNS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run, lsn DESC) AS rn FROM runs)"
    f" SELECT {COLUMNS}, run FROM ranked WHERE rn = 1 AND NOT tomb"
)
def l0_newest_wins(spark, d):
    return fold.tiered(runs(spark, d).drop("bytes"), "run", "k", "lsn", "tomb").select("k", "lsn", *VALUE, "run")


@query(f"WITH {RANKED_SQL} SELECT CAST(0 AS BIGINT) AS n_different, count(*) AS n_same FROM ranked WHERE rn = 1 AND NOT tomb")
def tiered_equals_fold(spark, d):
    one = fold.tiered(runs(spark, d).drop("bytes"), "run", "k", "lsn", "tomb").select("k", "lsn")
    two = latest(log(spark, d)).select("k", "lsn")
    both = one.withColumn("a", F.lit(1)).join(two.withColumn("b", F.lit(1)), ["k", "lsn"], "full")
    differ = F.col("a").isNull() | F.col("b").isNull()
    return both.agg(F.count_if(differ).alias("n_different"), F.count_if(~differ).alias("n_same"))


@query(
    f"WITH {RUNS_SQL} SELECT run, min(k) AS min_key, max(k) AS max_key, count(*) AS n_rows, count(DISTINCT k) AS n_keys,"
    " CAST(sum(bytes) AS BIGINT) AS file_size FROM runs GROUP BY run"
)
def run_metadata(spark, d):
    return levels.run_metadata(runs(spark, d), "run", "k")


@query(f"WITH {FILES_SQL} SELECT min(min_key) AS lo, max(max_key) AS hi FROM files WHERE level = 0")
def l0_hull(spark, d):
    return levels.hull(as_files(spark, d).where("level = 0"))


@query(
    f"WITH {RANGES_SQL}, hull AS (SELECT min(min_key) AS lo, max(max_key) AS hi FROM files WHERE level = 0) SELECT level, file_id, min_key, max_key"
    " FROM files, hull WHERE level = 0 OR (level = 1 AND max_key >= lo AND min_key <= hi)"
)
def overlap_l0_l1(spark, d):
    return levels.pick_l0(key_ranges(spark, d)).select("level", "file_id", "min_key", "max_key")


@query(
    f"WITH {RANGES_SQL}, one AS (SELECT * FROM files WHERE level = 0 ORDER BY min_key, file_id LIMIT 1) SELECT level, file_id, min_key, max_key FROM one"
    " UNION ALL SELECT f.level, f.file_id, f.min_key, f.max_key FROM files f, one WHERE f.level = 1 AND f.max_key >= one.min_key AND f.min_key <= one.max_key"
)
def overlap_ln_candidate(spark, d):
    return levels.pick_ln(key_ranges(spark, d), 0).select("level", "file_id", "min_key", "max_key")


@query(
    f"WITH {RANGES_SQL}, one AS (SELECT * FROM files WHERE level = 0 ORDER BY min_key, file_id LIMIT 1), gone AS (SELECT file_id FROM one UNION ALL SELECT"
    " f.file_id FROM files f, one WHERE f.level = 1 AND f.max_key >= one.min_key AND f.min_key <= one.max_key)"
    " SELECT level, file_id FROM files WHERE file_id NOT IN (SELECT file_id FROM gone)"
)
def compaction_drop_inputs(spark, d):
    files = key_ranges(spark, d)
    return levels.without(files, levels.pick_ln(files, 0)).select("level", "file_id")


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1")
def compact_dedup(spark, d):
    return merge.dedup(log(spark, d), "k")


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb")
def compact_bottom_gc(spark, d):
    return merge.drop_tombstones(merge.dedup(log(spark, d), "k"), "tomb")


KEYS_SQL = "keys AS (SELECT k, sum(bytes) AS kb, count(*) AS n FROM runs GROUP BY k), cut AS (SELECT *, CAST(coalesce(sum(kb) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 65536 AS file_no FROM keys)"


@query(
    f"WITH {RUNS_SQL}, {KEYS_SQL} SELECT file_no, min(k) AS min_key, max(k) AS max_key, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(kb) AS BIGINT) AS n_bytes"
    " FROM cut GROUP BY file_no"
)
def split_files_64k(spark, d):
    cut = merge.split_files(runs(spark, d), 65536, key="k")
    return cut.groupBy("file_no").agg(
        F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.count(F.lit(1)).alias("n_rows"), F.sum("bytes").alias("n_bytes")
    )


@query(
    f"WITH {RUNS_SQL}, {KEYS_SQL}, cut_rows AS (SELECT r.*, file_no FROM runs r JOIN cut USING (k)), b AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY"
    " file_no ORDER BY k, lsn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 4096 AS block_no FROM cut_rows) SELECT file_no, block_no,"
    " min(k) AS min_key, max(k) AS max_key, count(*) AS n_rows, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM b GROUP BY file_no, block_no"
)
def block_index_4k(spark, d):
    return merge.block_index(merge.split_files(runs(spark, d), 65536, key="k"), 4096, key="k")


@query(
    f"WITH {FILES_SQL} SELECT level, CAST(sum(file_size) AS BIGINT) AS level_bytes, count(*) AS n_files, CAST(100000 * 10 ** level AS BIGINT) AS target_bytes,"
    " sum(file_size) >= 100000 * 10 ** level AS due FROM files GROUP BY level"
)
def level_triggers(spark, d):
    return levels.triggers(as_files(spark, d), 100_000)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 500 AS lsn FROM orders")
def lsn_assign(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    return merge.assign_lsn(rows, 500, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "lsn")


@query(
    f"WITH {RUNS_SQL}, e AS (SELECT lsn, bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"
    " // 50000 AS epoch FROM runs) SELECT epoch, min(lsn) AS first_lsn, max(lsn) AS last_lsn, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM e GROUP BY epoch"
)
def rotation_epochs(spark, d):
    at = merge.rotation_epochs(sized(log(spark, d)).select("lsn", "bytes"), 50_000)
    return at.groupBy("epoch").agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.sum("bytes").alias("n_bytes"))


@query(
    "WITH m AS (SELECT o_orderpriority AS p, o_custkey AS file_id, CAST(year(o_orderdate) AS BIGINT) AS version FROM orders),"
    " live AS (SELECT DISTINCT file_id FROM m WHERE version IN (SELECT DISTINCT version FROM m ORDER BY version DESC LIMIT 2))"
    " SELECT 'sst' AS kind, c_custkey AS file_id FROM customer WHERE c_custkey NOT IN (SELECT file_id FROM live)"
)
def gc_candidates(spark, d):
    """Customers are files on disk; the orders of a year are the manifest of that version."""
    manifests = spark.read.parquet(f"{d}/orders.parquet").select(
        F.year("o_orderdate").cast("bigint").alias("version"), F.lit("sst").alias("kind"), F.col("o_custkey").alias("file_id")
    )
    on_disk = spark.read.parquet(f"{d}/customer.parquet").select(F.lit("sst").alias("kind"), F.col("c_custkey").alias("file_id"))
    return recovery.gc_candidates(on_disk, recovery.live_files(manifests))


@query("SELECT CAST(greatest((SELECT max(event_id) + 1 FROM events), (SELECT max(turn) + 1 FROM conversations)) + 1 AS BIGINT) AS next_lsn")
def next_lsn(spark, d):
    talk = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("turn") + 1).alias("lsn"))
    return recovery.next_lsn(log(spark, d), talk)


@query(
    "WITH e AS (SELECT user_id % 8 AS log_id, event_id, event_id % 997 <> 996 AS ok FROM events), b AS (SELECT log_id, min(event_id) AS bad FROM e WHERE NOT ok"
    " GROUP BY log_id) SELECT e.log_id, e.event_id FROM e LEFT JOIN b ON e.log_id = b.log_id WHERE bad IS NULL OR event_id < bad"
)
def replay_valid_prefix(spark, d):
    e = events(spark, d).select((F.col("user_id") % 8).alias("log_id"), "event_id")
    return recovery.valid_prefix(e, F.col("event_id") % 997 != 996, offset="event_id")


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb")
def replay_idempotent(spark, d):
    df = log(spark, d)
    return recovery.replay(df.unionByName(df), "k").where("not tomb")


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey + 1 AS lsn,"
    " o_orderstatus, o_totalprice, o_orderpriority FROM r WHERE rn = 1"
)
def orders_latest_by_customer(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select("o_custkey", (F.col("o_orderkey") + 1).alias("lsn"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    return fold.newest(rows, "o_custkey")


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)"
    " SELECT conv_id, turn + 1 AS lsn, role, text FROM r WHERE rn = 1"
)
def conversation_last_turn(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", (F.col("turn") + 1).alias("lsn"), "role", "text")
    return fold.newest(rows, "conv_id")


LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) AS rn"
    " FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice FROM r WHERE rn = 1"
)
def lineitem_latest_by_order(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", *LINE, "l_quantity", "l_extendedprice")
    best = rows.groupBy("l_orderkey").agg(F.max(F.struct(*LINE, "l_quantity", "l_extendedprice")).alias("best"))
    return best.select("l_orderkey", "best.*")


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE k = '11' AND rn = 1 AND NOT tomb")
def pruned_read(spark, d):
    """A point read of files sorted by key: row groups without the key are skipped by their ranges and bloom filters."""
    path = shared_path(spark, "sorted-run")
    rows = log(spark, d).repartitionByRange(8, "k").sortWithinPartitions("k", F.desc("lsn"))
    rows.write.option("parquet.bloom.filter.enabled#k", "true").parquet(path)
    return fold.get(spark.read.parquet(path), F.lit("11"), None, "k", "lsn", "tomb")


@query(f"WITH {RANKED_SQL} SELECT {COLUMNS} FROM ranked WHERE rn = 1 AND NOT tomb")
def stream_fold(spark, d):
    src = events(spark, d)
    out, checkpoint = shared_path(spark, "stream-out"), shared_path(spark, "stream-checkpoint")
    stream.run_fold(as_log(spark.readStream.schema(src.schema).parquet(f"{d}/events.parquet*")), out, checkpoint, "k").awaitTermination()
    return stream.folded(spark, out, "k").where("not tomb")
