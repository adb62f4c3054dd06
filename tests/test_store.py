"""Binary formats, the store, and the streaming fold."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from foldlake.functions import codec
from foldlake.operators import fold, levels, model
from foldlake.plans import catalog, catalog_store  # noqa: F401
from foldlake.plans.store import CommitConflict, Manifest, Store, StoreNotFound
from foldlake.sources import binary
from foldlake.streaming import stream

#: Fixed bytes of entries, from the format's rules.
GOLDEN = [
    ((b"key1", 1, "bytes", b"value1", None, None, False), "ae0abc07" "010000000000000004006b657931" "000600000076616c756531"),
    ((b"key2", 2, "str", None, "value2", None, False), "7686aa84" "020000000000000004006b657932" "020600000076616c756532"),
    ((b"n", 3, "int", None, None, -5, False), "d73a6814" "030000000000000001006e" "0408000000fbffffffffffffff"),
    ((b"keyX", 101, "tombstone", None, None, None, True), "1f2aa7dd" "650000000000000004006b657958" "0100000000"),
    ((b"", 100, "bytes", b"", None, None, False), "6723911f" "64000000000000000000" "0000000000"),
]
MAGIC = bytes.fromhex("bebafeca")
SMALL = "/root/testdata/sf0.001"


def test_entries_encode_to_the_golden_bytes(spark):
    df = spark.createDataFrame([g[0] for g in GOLDEN], model.LOG)
    got = {bytes(r.key): bytes(r.e).hex() for r in df.select("key", codec.encoded_entry().alias("e"), codec.entry_size().alias("n")).collect()}
    assert got == {g[0][0]: g[1] for g in GOLDEN}
    assert df.agg(F.sum(codec.entry_size())).first()[0] == sum(len(g[1]) // 2 - 4 for g in GOLDEN)


def test_logs_read_back(spark, tmp_path):
    data = MAGIC + b"".join(bytes.fromhex(g[1]) for g in GOLDEN)
    (tmp_path / "00001.wal").write_bytes(data)
    (tmp_path / "00002.wal").write_bytes(data[:-1])  # a torn tail
    (tmp_path / "00003.wal").write_bytes(b"")
    rows = binary.read_logs(spark, str(tmp_path)).collect()
    assert len(rows) == 5 + 4
    assert {(bytes(r.key), r.lsn, r.value_type, r.v_int) for r in rows} == {(g[0][0], g[0][1], g[0][2], g[0][5]) for g in GOLDEN}
    assert [r.file_id for r in binary.listing(spark, str(tmp_path)).orderBy("file_id").collect()] == [1, 2, 3]


def test_a_changed_byte_is_found():
    data = bytearray(MAGIC + bytes.fromhex(GOLDEN[0][1]))
    data[4] ^= 1
    with pytest.raises(binary.CorruptData):
        list(binary.decode_log(bytes(data)))
    with pytest.raises(binary.CorruptData):
        list(binary.decode_log(b"abcdefgh"))


def test_runs_read_back():
    def section(body):
        return struct.pack("<II", len(body), zlib.crc32(body)) + body

    def key(k, lsn):
        return struct.pack("<QH", lsn, len(k)) + k

    block = section(key(b"key1", 100) + bytes.fromhex("00040000007661" "6c31") + key(b"key2", 90) + bytes.fromhex("0100000000"))
    index = section(key(b"key1", 100) + key(b"key2", 90) + key(b"key1", 100) + key(b"key2", 90) + struct.pack("<Q", 0))
    bloom = section(b"")
    tail = struct.pack("<QQ", len(block), len(block) + len(index))
    data = block + index + bloom + tail + struct.pack("<I", zlib.crc32(tail)) + binary.RUN_MAGIC
    got = list(binary.decode_run(data))
    assert [(r["key"], r["lsn"], r["v_bytes"], r["tombstone"]) for r in got] == [(b"key1", 100, b"val1", False), (b"key2", 90, None, True)]
    with pytest.raises(binary.CorruptData):
        list(binary.decode_run(data[:-1]))


def test_manifest_bytes():
    data = bytes.fromhex("454c534d008a70e00c000000000000000100000000000000010000000000000000000000")
    assert binary.decode_manifest(data) == {"wals": [0], "levels": []}
    with pytest.raises(binary.CorruptData):
        binary.decode_manifest(data[:-1] + b"\x01")


def test_bloom_size():
    assert codec.bloom_size(1000, 0.01) == (9586, 7)


def test_file_names(spark):
    df = spark.createDataFrame([("a/00012.wal",), ("00007.sst",), ("x.wal",)], "p string")
    assert [r[0] for r in df.select(codec.file_number(F.col("p"), "wal")).collect()] == [12, None, None]
    assert df.select(codec.file_name(F.lit(7), "wal")).first()[0] == "00007.wal"


def keys_of(df):
    return {bytes(r.key).decode(): r.v_int for r in df.collect()}


def ints(spark, pairs):
    return spark.createDataFrame([(k.encode(), v) for k, v in pairs], "key binary, v long").select("key", *model.int_(F.col("v")))


def test_store_lifecycle(spark, tmp_path):
    folder = str(tmp_path / "store")
    with pytest.raises(StoreNotFound):
        Store.open(spark, folder)
    store = Store.create(spark, folder)
    assert store.put(ints(spark, [(f"k{i:03d}", i) for i in range(50)])) == 50
    store.flush(target=600)
    assert store.files().count() > 1
    store.delete(spark.createDataFrame([(b"k003",)], "key binary"))
    top = store.put(ints(spark, [("k004", 400)]))
    want = {f"k{i:03d}": i for i in range(50) if i != 3} | {"k004": 400}
    assert keys_of(store.read()) == want and keys_of(store.read(as_of=50))["k003"] == 3
    assert keys_of(store.get(b"k004")) == {"k004": 400} and keys_of(store.get(b"k003")) == {}
    store.flush()
    before = store.manifest().version
    store.compact(0, target=600)
    m = store.manifest()
    files = store.files().collect()
    assert {f.level for f in files} == {1} and not m.segments and len({f.file_id for f in files}) == len(files)
    assert keys_of(Store.open(spark, folder).read()) == want
    assert keys_of(store.read(version=before)) == want
    assert store.log().where("tombstone").count() == 0  # nothing lies below
    assert store.gc_candidates().where("kind = 'segments'").count() >= 2
    assert m.next_lsn == top + 1
    small = Store.open(spark, folder, memtable_bytes=1)  # every segment fills a table
    for i in range(6):
        small.put(ints(spark, [("n", i)]))
    assert small.manifest().epoch == 6
    small.maintain(base=1)
    assert not small.manifest().segments
    assert keys_of(store.read()) == want | {"n": 5}


def test_commit_conflict(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))

    def rival(m):
        store._write_manifest(Manifest(version=m.version + 1))
        return m

    with pytest.raises(CommitConflict):
        store.commit(rival)


def test_corrupt_manifest(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    store.put(ints(spark, [("a", 1)]))
    newest = tmp_path / "s/manifests/00001.json"
    newest.write_bytes(b"garbage data")
    (tmp_path / "s/manifests/.00001.json.crc").unlink(missing_ok=True)
    with pytest.raises(binary.CorruptData, match="Failed to open manifest"):
        Store.open(spark, str(tmp_path / "s"))
    assert store.manifest(0).version == 0


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    df = catalog.log(spark, "/root/testdata/sf0.001")
    df.repartition(3).write.parquet(str(src))
    q = stream.run_fold(spark.readStream.schema(df.schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), "k")
    q.awaitTermination()
    got = stream.folded(spark, str(tmp_path / "out"), "k").where("not tomb")
    want = catalog.latest(df)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_stream_into_store(spark, tmp_path):
    src = tmp_path / "in"
    ints(spark, [("a", 1), ("b", 2)]).write.parquet(str(src))
    store = Store.create(spark, str(tmp_path / "s"))
    rows = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    stream.append_stream(rows, store, str(tmp_path / "cp")).awaitTermination()
    assert keys_of(store.read()) == {"a": 1, "b": 2}


def test_a_batch_is_applied_once(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    assert store.put(ints(spark, [("a", 1)]), stream="q", batch=0) == 1
    assert store.put(ints(spark, [("a", 2)])) == 2
    assert store.put(ints(spark, [("a", 1)]), stream="q", batch=0) == 2  # run again after its commit
    assert store.put(ints(spark, [("b", 3)]), stream="q", batch=1) == 3
    assert keys_of(store.read()) == {"a": 2, "b": 3} and store.log().count() == 3


def test_versions_follow_arrival_and_are_distinct(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    assert store.put(ints(spark, [("a", 1), ("b", 2), ("a", 3)]).coalesce(1)) == 3
    assert keys_of(store.read()) == {"a": 3, "b": 2}
    rows = spark.range(300_000).select(F.encode(F.concat(F.lit("key"), F.col("id") * 7919 % 300_000), "UTF-8").alias("key"), *model.str_(F.repeat(F.lit("x"), 60)))
    assert store.put(rows, ["key"]) == 300_003
    top = store.log().agg(F.count_distinct("lsn").alias("n"), F.max("lsn").alias("top"), F.count("*").alias("all")).first()
    assert tuple(top) == (300_003, 300_003, 300_003) and store.manifest().next_lsn == 300_004


def test_manifests_are_created_once(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    assert store._write_manifest(Manifest(version=1)) and not store._write_manifest(Manifest(version=1, next_id=9))
    assert store.manifest(1).next_id == 1 and not [n for n in store._names("manifests") if n.endswith(".tmp")]


def of_many_files(monkeypatch, target=600):
    """Runs of stores have files of about target bytes, whatever their callers want."""
    write = Store._write_run
    monkeypatch.setattr(Store, "_write_run", lambda self, rows, size, level, _: write(self, rows, size, level, target))


def test_maintenance_takes_a_job_a_level(spark, tmp_path, monkeypatch):
    store = Store.create(spark, str(tmp_path / "s"), memtable_bytes=1)
    for i in range(5):
        store.put(ints(spark, [(f"k{j:03d}", i) for j in range(150)]), ["key"])
    jobs, compact = [], Store.compact
    monkeypatch.setattr(Store, "compact", lambda self, level, *a, **how: jobs.append(level) or compact(self, level, *a, **how))
    store.maintain(target=300, base=30)
    sizes = {r.level: r.level_bytes for r in levels.level_sizes(store.files()).collect()}
    assert jobs == [0, 1, 2] and sizes.get(1, 0) < 300 and sizes.get(2, 0) < 3000  # one file at a time took 20 jobs and more
    assert sizes[3] + sizes.get(2, 0) + sizes.get(1, 0) == 150 * 27  # the newest versions alone
    assert keys_of(store.read()) == {f"k{j:03d}": 4 for j in range(150)}
    files = [p for p in (tmp_path / "s/runs").rglob("*.parquet") if p.stat().st_size > 100_000]
    assert not files  # a bloom filter fits its file
    assert store.files().where("level = 3").count() < 16  # files have about target bytes after the merge


def test_levels_of_many_files(spark, monkeypatch):
    of_many_files(monkeypatch)
    df = catalog.log(spark, SMALL)
    half = df.agg(F.max("lsn")).first()[0] // 2
    older = {(r.k, r.lsn, 2) for r in catalog.latest(df.where(f"lsn <= {half}")).collect()}
    newer = {(r.k, r.lsn, 1) for r in fold.newest(df.where(f"lsn > {half}"), "k", "lsn").collect()}
    assert {(r.k, r.lsn, r.tier) for r in catalog.QUERIES["store_levels"](spark, SMALL).collect()} == older | newer


def test_the_lowest_level_of_many_files(spark, monkeypatch):
    of_many_files(monkeypatch)
    want = {(r.k, r.lsn, 2) for r in catalog.latest(catalog.log(spark, SMALL)).collect()}
    assert {(r.k, r.lsn, r.tier) for r in catalog.QUERIES["store_compact_ln"](spark, SMALL).collect()} == want
