"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

1. For each length of vectors, a rotation is learned that makes the signs of the rotated principal components balanced and close to the
   components (iterative quantisation, Gong & Lazebnik 2011), on a bounded sample of SAMPLE vectors. A code longer than the vectors
   takes further rotations from other starting points. Lengths out of the LENGTHS most frequent, shorter than SHORTEST, or with fewer
   than FEWEST vectors in the sample, take random hyperplanes, whose agreement follows from the angle alone.
2. The code is cut into substrings of at most about log2(n) - 3 bits; each is a table, and vectors that agree in a substring meet in a
   bucket of it. The number of tables is what pairs at the threshold, made from the sample and coded like it, need to meet with
   probability RECALL: subtracting a mean widens their angle. What is dealt to the buckets are ids and the first FILTER bits of the
   codes, packed; pairs near in Hamming distance are candidates.
3. Each candidate pair is taken once, meets its two original vectors, and is a link if their cosine in double precision says so. It
   counts in the first table that it meets in.

Equal vectors are one class from the start, so copies never meet. A bucket with more than DENSE candidates a member, or a deal of more
than HELD entries, doesn't list pairs: its members go with their vectors, dealt as pairs of blocks of BLOCK, to tasks that return one row
for each class that has links there (the number of vectors linked and a representative of its connected part). Nothing is dropped or
capped. The work in one bucket is quadratic in its different vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths don't link. Rows with a null id count as links of others but never name a component; rows that repeat an id and a vector count
as copies. An empty table gives an empty result. Only the id and the vector are read; extra columns don't matter.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import mix, small_batches, stored
from foldlake.llm.components import components

SAMPLE, STEPS, WORD = 8192, 30, 64
LENGTHS, SHORTEST, FEWEST = 8, 16, 64
THRESHOLD, RECALL = 0.9, 0.985
FILTER = 2 * WORD  # bits of a code that candidates are chosen by
BLOCK, CHUNK, HELD, DENSE = 512, 20_000, 4_000_000, 64
ENTRIES = 250_000  # entries of tables that are dealt to one group of buckets
PAIRS = 4096  # least number of pairs that the tables are measured on
ROW_PAIRS = 64  # pairs compared at the cost of a row in a table
MOST_TABLES = 2048
SPREAD = 5.0  # standard deviations of the Hamming distance that the filter leaves room for


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors in double precision, divided by their largest component, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


@dataclass(frozen=True)
class Quantiser:
    mean: np.ndarray
    rotations: np.ndarray  # dimensions x bits
    bits: int  # of a table
    tables: int
    most: int  # of the first FILTER bits that may differ

    def signs(self, x: np.ndarray) -> np.ndarray:
        x = scaled(x)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (unit - self.mean) @ self.rotations > 0

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first FILTER bits as words, substrings) of each vector."""
        s = self.signs(x)
        words = np.packbits(s[:, :FILTER], axis=1, bitorder="little").view(np.uint64)
        parts = s[:, : self.bits * self.tables].reshape(len(x), self.tables, self.bits)
        return words, (parts.astype(np.int64) << np.arange(self.bits)).sum(axis=2)


def _pairs_at(unit: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold: unit vectors moved in any direction, and towards others of the sample."""
    rnd = np.random.default_rng(0)
    one, out = np.resize(unit, (max(PAIRS, len(unit)), unit.shape[1])), []
    for other in (rnd.normal(size=one.shape), one[rnd.permutation(len(one))] + 1e-3 * rnd.normal(size=one.shape)):
        other = other - (other * one).sum(axis=1, keepdims=True) * one
        norm = np.linalg.norm(other, axis=1, keepdims=True)
        out.append((one, threshold * one + math.sqrt(1 - threshold**2) * other / np.where(norm > 0, norm, 1)))
    return out


def learn(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Quantiser:
    """Rotations for n vectors, from a sample of them. What pairs at the threshold need is measured behind the mean and the rotations."""
    unit = scaled(sample)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov((unit - mean).T) if len(unit) > 1 else np.eye(unit.shape[1]))
    width = min(WORD, unit.shape[1])
    axes = axes[:, np.argsort(-values)[:width]]
    v = (unit - mean) @ axes
    halves = len(unit) >= 1024  # rotations fit the vectors they are learned from better than others: measure on others
    pairs = [((a - mean) @ axes, (b - mean) @ axes) for a, b in _pairs_at(unit[1::2] if halves else unit, threshold)]
    v = v[::2] if halves else v
    rotations, agreed = [], []

    def rotate() -> None:
        r, _ = np.linalg.qr(np.random.default_rng(len(rotations)).normal(size=(width, width)))
        for _ in range(STEPS):
            b = np.where(v @ r > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(b.T @ v)
            r = right.T @ left.T
        rotations.append(axes @ r)
        agreed.append(np.stack([(a @ r > 0) == (b @ r > 0) for a, b in pairs]))

    rotate()
    bits = _bits(n, min(agreed[0].mean(axis=(1, 2)).min(), 1 - 1e-6), recall)
    met, tables = np.zeros(agreed[0].shape[:2], bool), 0
    left = agreed[0]
    while met.mean(axis=1).min() < recall:
        if tables == MOST_TABLES:
            warnings.warn(f"{tables} tables find {met.mean(axis=1).min():.3f} of pairs at the threshold (wanted {recall})", stacklevel=2)
            break
        while left.shape[2] < bits:
            rotate()
            left = np.concatenate([left, agreed[-1]], axis=2)
        met |= left[:, :, :bits].all(axis=2)
        left, tables = left[:, :, bits:], tables + 1
    while len(rotations) * width < FILTER:
        rotate()
    apart = FILTER - np.concatenate(agreed, axis=2)[:, :, :FILTER].sum(axis=2)
    most = min(FILTER, math.ceil((apart.mean(axis=1) + SPREAD * apart.std(axis=1)).max()))
    return Quantiser(mean, np.concatenate(rotations, axis=1), bits, tables, most)


def _bits(n: int, agree: float, recall: float) -> int:
    """Shorter substrings need fewer tables, but their buckets hold more pairs to compare."""
    full = int(np.clip(round(math.log2(max(n, 2))) - 3, 4, 24))
    return min(range(4, full + 1), key=lambda k: math.log(1 - recall) / math.log(1 - agree**k) * (1 + n / 2**k / ROW_PAIRS))


def hyperplanes(length: int, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Quantiser:
    """Random hyperplanes through the origin for n vectors: two signs agree with a probability that the angle gives."""
    apart = math.acos(threshold) / math.pi
    bits = _bits(n, 1 - apart, recall)
    tables = min(MOST_TABLES, math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** bits)))
    planes = np.random.default_rng(length).normal(size=(length, max(FILTER, bits * tables)))
    most = min(FILTER, math.ceil(FILTER * apart + SPREAD * math.sqrt(FILTER * apart * (1 - apart))))
    return Quantiser(np.zeros(length), planes, bits, tables, most)


class Quantisers(dict):
    """length -> Quantiser: the learned ones, and hyperplanes for any other length."""

    def __init__(self, learned: dict[int, Quantiser], n: int, threshold: float) -> None:
        super().__init__(learned)
        self.n, self.threshold = n, threshold

    def __missing__(self, length: int) -> Quantiser:
        own = self[length] = hyperplanes(length, self.n, self.threshold)
        return own

    def __reduce__(self):
        return Quantisers, (dict(self), self.n, self.threshold)


def by_length(lists) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of an Arrow list column."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out.append((int(n), at, flat[start[at][:, None] + np.arange(n)]))
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def first_table(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first table in which rows of substrings agree, -1 if none."""
    same = p == q
    return np.where(same.any(axis=1), same.argmax(axis=1), -1)


def _part_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the smallest index that the pairs (a, b) connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_in_buckets(bucket: np.ndarray, words: np.ndarray, most: np.ndarray):
    """(candidates, dense): pairs of rows of a bucket at most `most` bits apart as two arrays; whether each row's bucket has too many.

    Rows lie sorted by bucket. Pairs at a distance of 1, 2, ... rows are compared at once; only dense buckets keep no pairs.
    """
    n = len(bucket)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    last = np.repeat(first + size, size)  # where each row's bucket ends
    group = np.repeat(np.arange(len(first)), size)
    room, dense = DENSE * size, np.zeros(len(first), bool)
    found, step, at = [np.zeros((2, 0), np.int64)], 1, np.arange(n)
    while len(at := at[(at + step < last[at]) & ~dense[group[at]]]):
        apart = np.bitwise_count(words[at] ^ words[at + step]).sum(axis=1, dtype=np.int64)
        near = at[apart <= most[at]]
        if len(near):
            own = group[near]
            np.subtract.at(room, own, 1)
            dense[own] = room[own] < 0
            found.append(np.stack([near, near + step]))
        step += 1
    a, b = np.concatenate(found, axis=1)
    kept = ~dense[group[a]] if len(a) else np.zeros(0, bool)
    return a[kept], b[kept], dense[group] if n else np.zeros(0, bool)


ENTRY = "deal int, bucket binary, id binary, word binary, most binary"
MET = "a long, b long, tab int, dense boolean"
NARROW = {"bucket": np.uint64, "id": np.int64, "word": np.uint64, "most": np.uint8}


def _tables(classes: DataFrame, model, deals: int) -> DataFrame:
    """Packed entries of all tables; a bucket's number has its table in the lowest 12 bits and its length mixed in."""

    def enter(batches):
        quantisers = model.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for n, at, x in by_length(batch.column("vec")):
                q = quantisers[n]
                words, parts = q.codes(x)
                table = np.arange(q.tables, dtype=np.uint64)
                key = mix(parts.astype(np.uint64) * np.uint64(4096) + table + np.uint64(n << 40))
                key = (key & ~np.uint64(0xFFF) | table).ravel()
                deal = ((key >> np.uint64(12)) % np.uint64(deals)).astype(np.int64)
                order = np.argsort(deal, kind="stable")
                cuts = np.searchsorted(deal[order], np.arange(deals + 1))
                row = order // q.tables
                columns = {"bucket": key[order], "id": ids[at][row], "word": words[row], "most": np.full(len(row), q.most, np.uint8)}
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({"deal": pa.array(some.astype(np.int32)), **{
                    k: pa.array([c[cuts[d] : cuts[d + 1]].astype(NARROW[k]).tobytes() for d in some], pa.binary()) for k, c in columns.items()}})

    return classes.select("id", "vec").mapInArrow(enter, ENTRY)


def _met(entries: DataFrame, deals: int) -> DataFrame:
    """Candidate pairs (a < b) with the first table they were found in here; or members (a) of a dense bucket (b)."""

    def members(c: dict[str, np.ndarray]):
        return pa.RecordBatch.from_arrays(
            [pa.array(c["id"]), pa.array(c["bucket"].view(np.int64)), pa.array((c["bucket"] & np.uint64(0xFFF)).astype(np.int32)), pa.array(np.ones(len(c["id"]), bool))],
            names=["a", "b", "tab", "dense"],
        )

    def judge(c: dict[str, np.ndarray]):
        order = np.argsort(c["bucket"], kind="stable")
        c = {k: v[order] for k, v in c.items()}
        i, j, dense = near_in_buckets(c["bucket"], c["word"], c["most"])
        a, b = c["id"][i], c["id"][j]
        table = (c["bucket"][i] & np.uint64(0xFFF)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(table), pa.array(np.zeros(len(a), bool))], names=["a", "b", "tab", "dense"])
        if dense.any():
            yield members({k: v[dense] for k, v in c.items()})

    def unpack(held: dict[str, list[bytes]]):
        c = {k: np.frombuffer(b"".join(v), NARROW[k]) for k, v in held.items()}
        return c | {"word": c["word"].reshape(len(c["id"]), -1)}

    def meet(batches):
        now, held, n, full = None, {k: [] for k in NARROW}, 0, False
        for batch in batches:
            columns = {k: batch.column(k).to_pylist() for k in ("deal", *NARROW)}
            for i, deal in enumerate(columns["deal"]):
                if deal != now:
                    if n and not full:
                        yield from judge(unpack(held))
                    now, held, n, full = deal, {k: [] for k in NARROW}, 0, False
                for k in NARROW:
                    held[k].append(columns[k][i])
                n += len(columns["id"][i]) // 8
                if n > HELD:  # too many to hold: all go on as members
                    full = True
                    yield members(unpack(held))
                    held = {k: [] for k in NARROW}
        if n and not full:
            yield from judge(unpack(held))

    dealt = entries.repartition(min(deals, 4096), "deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(meet, MET)


def _confirmed(pairs: DataFrame, classes: DataFrame, model, threshold: float) -> DataFrame:
    """The pairs (a, b, many_a, many_b) that are links, and that no dense bucket of an earlier table holds."""
    one = classes.select(F.col("id").alias("a"), F.col("many").alias("many_a"), F.col("vec").alias("vec_a"))
    two = classes.select(F.col("id").alias("b"), F.col("many").alias("many_b"), F.col("vec").alias("vec_b"))

    def confirm(batches):
        quantisers = model.value
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            table = batch.column("tab").to_numpy()
            other = {n: (at, y) for n, at, y in by_length(batch.column("vec_b"))}
            for n, at, x in by_length(batch.column("vec_a")):
                if n not in other:
                    continue
                at, i, j = np.intersect1d(at, other[n][0], return_indices=True)  # a hash may have brought two lengths together
                x, y = x[i], other[n][1][j]
                near = np.flatnonzero(cosines(x, y) >= threshold)
                if len(near):
                    q = quantisers[n]
                    kept[at[near]] = first_table(q.codes(x[near])[1], q.codes(y[near])[1]) == table[at[near]]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(kept)) for k in ("a", "b", "many_a", "many_b")], names=["a", "b", "many_a", "many_b"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(confirm, "a long, b long, many_a long, many_b long")


def _linked(group: np.ndarray, side: np.ndarray, table: int | np.ndarray, x: np.ndarray, words: np.ndarray, parts: np.ndarray,
            most: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are links and belong to this table. Rows lie sorted by group and side."""
    found = [np.zeros((2, 0), np.int64)]

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= most
        a, b = a[near], b[near]
        if len(a):
            ok = cosines(x[a], x[b]) >= threshold
            a, b = a[ok], b[ok]
            first = first_table(parts[a], parts[b]) == table[a]
            found.append(np.stack([a[first], b[first]]))

    whole = np.flatnonzero(side == 0)
    last = np.searchsorted(group, group, "right")  # where each row's group ends
    step, at = 1, whole
    while len(at := at[at + step < last[at]]):
        keep(at, at + step)
        step += 1
    for g in np.unique(group[side > 0]):
        begin, end = np.searchsorted(group, [g, g + 1])
        cut = begin + int((side[begin:end] == 1).sum())
        for i in range(begin, cut, 64):
            a = np.arange(i, min(i + 64, cut))
            keep(np.repeat(a, end - cut), np.tile(np.arange(cut, end), len(a)))
    return tuple(np.concatenate(found, axis=1))


def _dense_links(members: DataFrame, classes: DataFrame, model, threshold: float) -> DataFrame:
    """(id, linked, part): for each dense bucket in which a class has links, how many vectors they are and a member of its connected part."""
    spark = classes.sparkSession
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "bucket-sizes")
    met = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block b meets itself (side 0), the blocks after it (side 1), and those before it (side 2)
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"),
        F.when(k == F.col("block"), 0).when(k > F.col("block"), 1).otherwise(2).alias("side")))
    dealt = met.withColumn("task", F.explode(tasks)).select("bucket", "task.*", "tab", "id").join(classes.select("id", "many", "vec"), "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")

    def compare(batches):
        quantisers, held = model.value, []

        def answer(batch: pa.Table):
            at = batch.column("bucket").to_numpy(), batch.column("i").to_numpy(), batch.column("j").to_numpy()
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in at], axis=0)
            group, side, table = np.cumsum(new), batch.column("side").to_numpy(), batch.column("tab").to_numpy()
            many, ids = batch.column("many").to_numpy(), batch.column("id").to_numpy()
            found = [np.zeros((2, 0), np.int64)]
            for n, own, x in by_length(batch.column("vec").combine_chunks()):
                q = quantisers[n]
                words, parts_ = q.codes(x)
                a, b = _linked(group[own], side[own], table[own], x, words, parts_, q.most, threshold)
                found.append(np.stack([own[a], own[b]]))
            a, b = np.concatenate(found, axis=1)
            linked = np.bincount(a, many[b], len(group)) + np.bincount(b, many[a], len(group))
            some = np.flatnonzero(linked)
            part = ids[_part_of(len(group), a, b)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(linked[some].astype(np.int64)), pa.array(part[some])], names=["id", "linked", "part"]
            )

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                whole = pa.Table.from_batches(held)
                at = [whole.column(c).to_numpy() for c in ("bucket", "i", "j")]
                ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in at], axis=0)) + 1
                if len(ends):  # the last group may go on in the next batch
                    yield answer(whole.slice(0, int(ends[-1])))
                    held = whole.slice(int(ends[-1])).to_batches()
        if held:
            yield answer(pa.Table.from_batches(held))

    return dealt.mapInArrow(compare, "id long, linked long, part long")


def _quantisers(classes: DataFrame, n: int, threshold: float) -> Quantisers:
    """Learned for the most frequent lengths, each from its share of a sample of SAMPLE vectors or so."""
    sizes = classes.groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "length").limit(LENGTHS).collect()
    learned = {}
    for r in sizes:
        if r["length"] < SHORTEST:
            continue
        own = classes.where(F.size("vec") == r["length"]).orderBy(F.xxhash64("h1", "h2"), "id").limit(SAMPLE).select("vec").collect()  # SAMPLE vectors
        if len(own) >= FEWEST:
            learned[r["length"]] = learn(np.array([x[0] for x in own], np.float64), r["n"], threshold)
    return Quantisers(learned, n, threshold)


def _links(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, linked, part), several rows an id: the vectors that it links to, and a node that it is connected to."""
    spark = classes.sparkSession
    quantisers = _quantisers(classes, n, threshold)
    model = spark.sparkContext.broadcast(quantisers)
    tables = max([q.tables for q in quantisers.values()], default=16)
    deals = max(1, min(1 << 20, n * tables // ENTRIES))
    deals = max(deals, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = stored(_met(_tables(classes, model, deals), deals), "embeddings-met")
    pairs = met.where("not dense").groupBy("a", "b").agg(F.min("tab").alias("tab"))
    links = stored(_confirmed(pairs, classes, model, threshold), "embedding-links")
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("many_b").alias("linked"), F.col("b").alias("part")), F.struct(F.col("b").alias("id"), F.col("many_a").alias("linked"), F.col("a").alias("part")))
    out = links.select(F.inline(ends))
    members = met.where("dense").select(F.col("b").alias("bucket"), F.col("a").alias("id"), "tab")
    if not members.isEmpty():
        out = out.unionByName(stored(_dense_links(members, classes, model, threshold), "dense-links"))
    return out


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    base = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    if base.schema["vec"].dataType.elementType.typeName() != "float":
        base = base.withColumn("vec", F.col("vec").cast("array<double>"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    base = base.withColumns({"usable": F.coalesce(fine, F.lit(False)), "h1": F.xxhash64("vec"), "h2": F.xxhash64(F.reverse("vec"), F.lit(1))})
    classes = base.where("usable").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("many"), F.first("vec").alias("vec"))
    # vectors that lie under no id but null still count for others: they get numbers above all ids
    classes = classes.withColumn("id", F.coalesce("id", F.lit(1 << 62) + F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 61))))
    classes = stored(classes, "vector-classes")
    n = classes.count()
    if n:
        links = _links(classes, n, threshold)
        counts = links.groupBy("id").agg(F.sum("linked").alias("linked"))
        known = components(links.select(F.col("id").alias("a"), F.col("part").alias("b")).where("a <> b").distinct())
        of = classes.drop("vec").join(counts, "id", "left").join(known.withColumnRenamed("node", "id"), "id", "left")
        of = of.select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), (F.col("many") - 1 + F.coalesce("linked", F.lit(0))).alias("n"),
                       F.coalesce("component", "id").alias("component"))
        out = base.join(of, (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")) & F.col("usable"), "left")
    else:
        out = base.withColumns({"n": F.lit(0).cast("bigint"), "component": F.lit(None).cast("bigint")})
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")
