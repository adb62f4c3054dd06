"""Scenarios, layout independence and metamorphic properties of the fold."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldlake.operators import fold, levels, merge, model, recovery

ROW = "key binary, lsn long, value_type string, v_bytes binary, v_str string, v_int long, tombstone boolean"


def row(key, lsn, value=None):
    kind = "tombstone" if value is None else {bytes: "bytes", str: "str", int: "int"}[type(value)]
    own = {"bytes": (value, None, None), "str": (None, value, None), "int": (None, None, value)}.get(kind, (None, None, None))
    return (key.encode(), lsn, kind, *own, kind == "tombstone")


def log(spark, rows):
    return spark.createDataFrame(rows, ROW)


def state(df):
    return {bytes(r.key).decode(): next((v for v in (r.v_bytes, r.v_str, r.v_int) if v is not None), None) for r in df.collect()}


def test_overwrite_changes_type(spark):
    df = log(spark, [row("plum", 4, b"\x00"), row("plum", 9, 17), row("plum", 11, "ripe")])
    assert state(fold.latest(df, 4)) == {"plum": b"\x00"}
    assert state(fold.latest(df, 10)) == {"plum": 17}
    assert state(fold.latest(df)) == {"plum": "ripe"}


def test_tombstone_hides_only_later_readers(spark):
    df = log(spark, [row("pear", 6, "here"), row("pear", 8)])
    assert state(fold.latest(df, 7)) == {"pear": "here"}
    assert state(fold.latest(df)) == {}
    assert state(fold.get(df, F.lit(b"pear"))) == {}
    assert [bytes(r.key) for r in fold.deleted(df).collect()] == [b"pear"]


def test_missing_and_empty_keys_differ(spark):
    df = log(spark, [row("", 1, b"")])
    assert state(fold.get(df, F.lit(b""))) == {"": b""}
    assert state(fold.get(df, F.lit(b"a"))) == {}


def test_merge_order(spark):
    """Keys ascend, and versions of a key descend, whichever runs they come from."""
    runs = [log(spark, [row(k, lsn, lsn) for k, lsn in own]) for own in ([("d", 7), ("b", 3)], [("b", 8), ("a", 2), ("d", 1)], [("c", 5)])]
    got = [(bytes(r.key).decode(), r.lsn) for r in merge.merge_runs(runs).collect()]
    assert got == [("a", 2), ("b", 8), ("b", 3), ("c", 5), ("d", 7), ("d", 1)]


def test_delete_in_newer_run_hides_older_run(spark):
    df = log(spark, [row("a", 1, b"old"), row("a", 2), row("b", 1, b"b")]).withColumn("tier", F.when(F.col("lsn") == 2, 0).otherwise(1))
    assert state(fold.tiered(df, "tier")) == {"b": b"b"}


def test_dedup_keeps_what_an_old_reader_sees(spark):
    df = log(spark, [row("a", i, i) for i in range(1, 7)])
    kept = merge.dedup(df, oldest_reader=3)
    assert sorted(r.lsn for r in kept.collect()) == [3, 4, 5, 6]
    assert state(fold.latest(kept, 3)) == {"a": 3}


def test_files_never_split_a_key(spark):
    df = log(spark, [row(f"k{i % 7}", i, "x" * 50) for i in range(200)]).withColumn("bytes", F.lit(100).cast("bigint"))
    cut = merge.split_files(df, 1000)
    assert cut.count() == 200
    assert cut.groupBy("key").agg(F.count_distinct("file_no").alias("n")).where("n > 1").count() == 0
    blocks = merge.greedy_cuts(cut, 300, [F.col("key"), F.desc("lsn")], "file_no")
    assert blocks.groupBy("file_no", "cut_no").count().where("count > 3").count() == 0
    one = merge.greedy_cuts(df.withColumn("part", F.lit(0)), 5000, [F.col("key"), F.desc("lsn")], "part", whole="key")
    assert {r["cut_no"]: r["n"] for r in one.groupBy("cut_no").agg(F.count("*").alias("n")).collect()} == {0: 58, 1: 58, 2: 56, 3: 28}


def test_sums_are_right_beyond_the_sample(spark):
    """More rows than range boundaries are drawn from, and a wide column that only some plans need."""
    rows = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("x"), (F.col("id") % 7).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    own = rows.withColumn("slice", F.lit(1))
    at = merge.prefix_sums(own, "n", ["x"], slices=16)
    assert at.columns == [*own.columns, "before"]
    want = {x: n for x, n in at.select("x", "n").collect()}
    got, total = {r.x: r.before for r in at.select("x", "before").collect()}, 0
    for x in sorted(want):
        assert got[x] == total
        total += want[x]
    lsn = merge.assign_lsn(rows, 5, ["x"]).select("x", "lsn", "wide")
    assert lsn.where("lsn <> x + 6 or wide is null").count() == 0 and lsn.count() == 400_000


def test_lsn_is_contiguous(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = sorted((r.x, r.lsn) for r in merge.assign_lsn(rows, 40, ["x"]).collect())
    assert got == [(i, 41 + i) for i in range(1000)]


def test_levels(spark):
    files = spark.createDataFrame([(0, 1, 100, "c", "f"), (0, 2, 50, "h", "k"), (1, 3, 10, "a", "b"), (1, 4, 10, "k", "m"), (1, 5, 10, "n", "z")],
                                  "level int, file_id int, file_size long, min_key string, max_key string")
    assert sorted(r.file_id for r in levels.pick_l0(files).collect()) == [1, 2, 4]
    assert sorted(r.file_id for r in levels.pick_ln(files, 1).collect()) == [3]
    assert {r.level: r.due for r in levels.triggers(files, 120).collect()} == {0: True, 1: False}
    assert sorted(r.file_id for r in levels.without(files, levels.pick_l0(files)).collect()) == [3, 5]


def test_replay_stops_at_first_bad_entry(spark):
    e = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True), (2, 0, True)], "log_id int, offset int, ok boolean")
    assert sorted(tuple(r)[:2] for r in recovery.valid_prefix(e, F.col("ok")).collect()) == [(1, 0), (2, 0)]
    assert recovery.next_lsn(e.where("false").select(F.col("offset").alias("lsn"))).first()[0] == 1


def test_rows_that_the_model_cannot_hold(spark):
    with pytest.raises(Exception, match="longer than"):
        model.checked(log(spark, [row("k" * 65_536, 1, b"")])).collect()
    assert model.checked(log(spark, [row("k" * 65_535, 1, b"")])).count() == 1


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.one_of(st.none(), st.binary(max_size=3), st.text(max_size=3), st.integers(-9, 9))), min_size=1, max_size=20), st.randoms())
def test_layout_does_not_matter(spark, writes, rnd):
    rows, want = [], {}
    for i, (k, v) in enumerate(writes):
        rows.append(row(k, i + 1, v))
        want[k] = v
    want = {k: v for k, v in want.items() if v is not None}
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    df = log(spark, shuffled)
    assert state(fold.latest(df)) == want
    assert state(fold.latest(df.unionByName(df))) == want
    once = merge.dedup(df)
    assert state(fold.latest(once)) == want and sorted(merge.dedup(once).collect()) == sorted(once.select(*merge.dedup(once).columns).collect())
    cut = len(rows) // 2
    at = df.withColumn("tier", F.when(F.col("lsn") > cut, 0).otherwise(1))
    assert state(fold.tiered(at, "tier")) == want
