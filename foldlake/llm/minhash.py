"""Near-duplicate texts: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

1. Every text becomes its set of word shingles, as 64-bit hashes. One hash of a shingle serves for all BINS bins (its top bits pick
   the bin); an empty bin takes the value of the first filled bin in an order of its own (optimal densification). BANDS runs of
   ROWS bins make the bucket keys.
2. Texts with equal sets are one class. Only the classes' representatives go on, so copies never meet in pairs.
3. In each bucket the representatives are joined to the smallest id of the bucket: a star, as many edges as members. The edges are
   checked on the full sets by exact integer arithmetic, and the links give components.
4. A link can exist between two members of a bucket neither of which links to its centre. So buckets whose members still lie in
   different components are finished. First the members go of which too many shingles occur in no other set of such a bucket:
   they can't link with any. Then small buckets are finished by their own pairs (at most SMALL_BUCKET members), larger ones by blocks of
   about BLOCK members, of which only those outside the bucket's main component are held against all others. Nothing is dropped.
   This last step is quadratic in the left-over members of one bucket, but in blocks spread over tasks, and only links come out.

A pair at similarity s shares a bucket with probability 1 - (1 - s^ROWS)^BANDS: with 4 and 32, 1 - 5e-11 at s = 0.85.

Defined results: null texts and texts without words have an empty set and link with nothing; texts with fewer words than a shingle
are one shingle; rows with a null id link with nothing and have a null component; rows that repeat an id share its component; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.llm import urlfilter
from foldlake.llm.common import WordHashes, bytes_of, drop_stored, mix, small_batches, stored, words
from foldlake.llm.components import components

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
BIN_SHIFT = np.uint64(64 - 7)
SMALL_BUCKET, BLOCK = 8, 256

SHINGLE, THRESHOLD = 5, 80  # of the operator, unless a contract says otherwise
STEP = np.uint64(0x9E3779B97F4A7C15)

#: For each bin, the order in which it looks for a filled one: fixed by a seed, so that it is the same for all texts.
_LOOK = np.random.default_rng(20240229).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
_PLACES = np.random.default_rng(7).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * STEP


def shingle_set(data: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    found = words(data)
    if not found:
        return np.zeros(0, np.uint64)
    h = hashes.of(found)
    k = min(size, len(h))
    acc = np.full(len(h) - k + 1, np.uint64(k) * STEP)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = mix(acc) if i else acc
            acc = acc + h[i : len(h) - k + 1 + i] * (STEP + np.uint64(2 * i))
        acc = mix(acc)
    return np.unique(acc)


def bucket_keys(own: np.ndarray) -> np.ndarray:
    """The keys of the BANDS buckets of a set that isn't empty."""
    bins = (own >> BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # own is sorted, so a bin's first value is its least
    sketch, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sketch[bins[first]], filled[bins[first]] = own[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        look = _LOOK[empty]
        sketch[empty] = sketch[look[np.arange(len(empty)), filled[look].argmax(axis=1)]]
    with np.errstate(over="ignore"):
        return mix((sketch.reshape(BANDS, ROWS) * _PLACES).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def mark_of(text: str = "text") -> Column:
    """A hash of the text, which tells rows apart that share an id."""
    return F.xxhash64(bytes_of(text))


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, mark, n_shingles, set_a, set_b, buckets): mark is a hash of the text; set_a and set_b are 128 bits that stand for the set."""
    small_batches(docs.sparkSession)

    def answer(batches):
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            n, a, b, buckets = [], [], [], []
            for data in batch.column("data").to_pylist():
                own = shingle_set(data, hashes, size)
                n.append(len(own))
                mark = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                a.append(int(mark[0]))
                b.append(int(mark[1]))
                buckets.append(bucket_keys(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(buckets, pa.list_(pa.int64()))],
                names=["id", "mark", "n_shingles", "set_a", "set_b", "buckets"],
            )

    marked = docs.select(F.col(key).cast("bigint").alias("id"), mark_of(text).alias("mark"), bytes_of(text).alias("data"))
    return marked.mapInArrow(
        answer, "id long, mark long, n_shingles long, set_a long, set_b long, buckets array<long>"
    )


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, own): the sorted set of each text whose id is in ids, and of the few others that pass a Bloom filter of ids.

    No text is shuffled: a join with ids would move all of them once ids is too long to be broadcast.
    """

    def answer(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(data, hashes, size).view(np.int64) for data in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "own"])

    listed = urlfilter.level_for(ids.select(F.col("id").alias("key")))
    chosen = docs.select(F.col(key).cast("bigint").alias("id"), bytes_of(text).alias("data")).where(listed.passes(F.col("id"), 0))
    return chosen.mapInArrow(answer, "id long, own array<long>")


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("own_b"))
    # sizes alone rule most unequal pairs out before the sets are compared
    small, big = F.least(F.size("own_a"), F.size("own_b")), F.greatest(F.size("own_a"), F.size("own_b"))
    near = pairs.join(left, "a").join(right, "b").where(100 * small >= percent * big)
    near = near.withColumn("both", F.size(F.array_intersect("own_a", "own_b")))
    return near.where(100 * F.col("both") >= percent * (F.size("own_a") + F.size("own_b") - F.col("both"))).select("a", "b")


def _block_links(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Links between the members of paired blocks: exact intersections as products of incidence matrices."""

    def links(one, other):
        import pandas as pd

        out = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(one) or not len(other):
            return out
        n1, n2 = one["own"].map(len).to_numpy(), other["own"].map(len).to_numpy()
        v1, v2 = np.concatenate(one["own"].to_list()), np.concatenate(other["own"].to_list())
        shared = np.intersect1d(v1, v2)
        r1, r2 = np.repeat(np.arange(len(one)), n1), np.repeat(np.arange(len(other)), n2)
        both = np.zeros((len(one), len(other)))
        for at in range(0, len(shared), 8192):  # columns of a bounded matrix
            part = shared[at : at + 8192]
            sides = []
            for v, r, n in ((v1, r1, len(one)), (v2, r2, len(other))):
                k = np.searchsorted(part, v)
                hit = (k < len(part)) & (part[np.minimum(k, len(part) - 1)] == v)
                m = np.zeros((n, len(part)), np.float32)
                m[r[hit], k[hit]] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
        ok = 100 * both >= percent * (n1[:, None] + n2[None, :] - both)
        ok &= one["component"].to_numpy()[:, None] != other["component"].to_numpy()[None, :]
        i, j = np.nonzero(ok)
        return pd.DataFrame({"a": one["id"].to_numpy()[i], "b": other["id"].to_numpy()[j]})

    by = ["bucket", "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(links, "a long, b long")


def _open(at: DataFrame) -> DataFrame:
    """The members of buckets that lie in more than one component, with the bucket's counts and its largest component."""
    parts = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("main"),
        F.max("n").alias("most"),
    )
    # stored: a join with a plain table is one that Spark can split where a bucket is large
    return at.join(stored(main.where("parts > 1"), "main-components"), "bucket")


def _may_link(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ids that could link with another of ids: enough of their shingles occur in some other set as well."""
    shingles = sets.join(ids, "id", "left_semi").select("id", F.explode("own").alias("h"))
    alone = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    n = sets.join(ids, "id", "left_semi").select("id", F.size("own").alias("size")).join(alone, "id", "left")
    return n.where(100 * (F.col("size") - F.coalesce("alone", F.lit(0))) >= percent * F.col("size")).select("id")


def _left_over(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that still lie in different components, none of them the bucket's centre."""
    at = members.join(known.withColumnRenamed("node", "id"), "id", "left")
    at = at.withColumn("component", F.coalesce("component", "id")).where("id <> centre")
    at = stored(_open(at).select("bucket", "id", "component"), "open-buckets")
    able = stored(_may_link(stored(at.select("id").distinct(), "open-ids"), sets, percent), "able-ids")
    open_ = stored(_open(at.join(able, "id", "left_semi")), "open-able-buckets")
    few = open_.where(F.col("n") <= SMALL_BUCKET)
    one, two = few.select("bucket", F.col("id").alias("a"), F.col("component").alias("p")), few.select(
        "bucket", F.col("id").alias("b"), F.col("component").alias("q")
    )
    pairs = one.join(two, "bucket").where("a < b and p <> q").select("a", "b").distinct()
    found = stored(_checked(pairs, sets, percent), "links-of-small-buckets")
    many = open_.where(F.col("n") > SMALL_BUCKET)
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    rest = F.col("n") - F.col("most")
    left = many.where("component <> main").withColumns({"i": own(rest), "j": F.explode(F.sequence(F.lit(0), blocks(F.col("n")) - 1))})
    right = many.withColumn("j", own(F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), blocks(rest) - 1)))
    cut = lambda side: side.join(sets, "id").select("bucket", "i", "j", "id", "component", "own")
    right = cut(right)
    return found.unionByName(_block_links(cut(left), right.toDF(*right.columns), percent))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    percent: int = THRESHOLD, marks: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs: 100 * intersection >= percent * union links two texts.

    With marks, `mark` too, which is mark_of() the row's text.
    """
    held = stored(sketches(docs, key, text, size), "sketches")
    usable = held.where("n_shingles > 0 and id is not null")
    sets = stored(usable.groupBy("set_a", "set_b").agg(F.min("id").alias("rep")), "set-classes")
    chosen = sets.withColumnRenamed("rep", "id")
    reps = usable.join(chosen, ["id", "set_a", "set_b"], "left_semi")
    rows = reps.select("id", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").drop("last")
    members = stored(rows.join(stored(shared, "shared-buckets"), "bucket"), "bucket-members")
    stars = stored(members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    ids = stored(members.select("id").distinct(), "ids-in-buckets")
    own = stored(full_sets(docs, ids, key, text, size), "sets-in-buckets")
    links = stored(_checked(stars, own, percent), "links")
    known = components(links)
    more = stored(_left_over(members, known, own, percent), "more-links")
    if not more.isEmpty():
        known = components(links.unionByName(more))
    of_set = sets.join(known, sets["rep"] == known["node"], "left").select(
        F.col("set_a").alias("of_a"), F.col("set_b").alias("of_b"), F.coalesce("component", "rep").alias("of_component")
    )
    out = held.drop("buckets").join(of_set, (F.col("set_a") == F.col("of_a")) & (F.col("set_b") == F.col("of_b")), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("of_component", "id")).otherwise(F.col("id"))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), component))
    return out.select("id", *(["mark"] if marks else []), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")
