"""Removal of repeated passages: merged Burrows-Wheeler transforms over the stretches that can repeat.

A byte goes if a string of SPAN bytes covers it that also starts in a document with a smaller id.

1. Anchors. Each window of SPAN bytes has a least hash among the GRAM-byte grams in it (leftmost on ties). Consecutive windows with the
   same anchor form a stretch of at most 2 * SPAN - GRAM bytes. Equal windows have equal anchors, so whatever repeats meets at its
   anchor. Anchors (4 bytes of hash, 8 of the stretch's hash, id, start, length) are dealt by hash as packed arrays.
2. Pre-aggregation. Of stretches that are equal as a whole, the one in the smallest document stays and the others are removed whole: first
   within each batch, so that a line in all documents sends a stretch a batch, then where they are dealt to. Anchors that a sample of
   documents shows to be frequent are dealt by their stretches instead of to one bucket. An anchor that lies in one document alone is
   done. What is left are different stretches around one anchor.
3. Merged transforms. Those stretches are cut from the texts and dealt by anchor. In each task they are split into two shards; a
   shard's suffixes are sorted and its Burrows-Wheeler transform is kept. The transforms are merged by interleave refinement (Holt &
   McMillan 2014): an array says from which shard each suffix comes; stably sorting it by the symbols that it reads off the transforms,
   two at a time, h times, orders all suffixes by their first 2h symbols without comparing them again. The boundaries that appear in a
   round are common prefixes of less than 2h symbols (Egidi & Manzini's Gap), so that after SPAN / 2 rounds the intervals left are
   exactly the suffixes that share SPAN bytes. Each interval's smallest document decides for its members.
   An anchor with more than HOT stretches is dealt to several tasks by document. Each merges its own transforms and settles their
   intervals; each interval then sends its smallest document, under 128 bits of hash of its string and packed like the anchors, to
   where the intervals of all tasks meet, and the smallest of all decides.
4. The removed spans of a document are joined to its text, merged, and cut out.

Nothing is capped. Stretches that share an anchor are told apart by 64 bits of hash beside the anchor (a polynomial that a crafted text of
at most 2 * SPAN - GRAM bytes could meet; chance does so once in 2 ** 64 pairs around one anchor).

Defined results: null texts are empty; texts shorter than SPAN keep all bytes; rows with a null id, and rows that share an id but not
a text, keep all bytes and remove none elsewhere; rows that repeat an id and a text are cut alike; an empty table gives an empty result.
Matches of equal texts under different ids leave the smallest id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import bytes_of, mix, small_batches, stored

SPAN, GRAM = 50, 20
REACH = SPAN - GRAM  # grams of a window, less one
CHUNK = 200_000  # bytes of stretches merged at once, beyond which a chunk ends with its anchor
HOT = 2000  # stretches of one anchor that one task merges, about as many as a chunk has
ACROSS = 500_000  # windows that are settled together across tasks
SAMPLE, FREQUENT = 8192, 64  # documents of the sample that tells frequent anchors: those in one of FREQUENT or more
BUCKET_BYTES = 48 << 20  # bytes of text for each bucket of anchors

_MULT = 0x9E3779B97F4A7C15 | 1
_M = [np.uint64(pow(_MULT, k, 1 << 64)) for k in range(32)]
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_INVERSE = np.uint64(pow(_MULT, -1, 1 << 64))


class Powers:
    """Powers of a multiplier modulo 2**64, as far as they were needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.held = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            full = np.full(max(n, 2 * len(self.held)), self.base)
            full[0] = 1
            self.held = np.cumprod(full)
        return self.held[:n]


UP, DOWN = Powers(np.uint64(_MULT)), Powers(_INVERSE)


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (n - width)], h[n - width :]) if width < n else h


def stretches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash of the stretch, start, length) of each stretch of a text."""
    if len(data) < SPAN:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    v = _BYTE[np.frombuffer(data, np.uint8)]
    h2 = v[:-1] * _M[1] + v[1:]
    h4 = h2[:-2] * _M[2] + h2[2:]
    h8 = h4[:-4] * _M[4] + h4[4:]
    h16 = h8[:-8] * _M[8] + h8[8:]
    h = h16[:-4] * _M[4] + h4[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = _least(h, REACH + 1)
    ends = h[: len(least)] == least  # the anchor is the window's first gram: the next window has another
    ends[:-1] |= least[1:] != least[:-1]
    ends[-1] = True
    last = np.flatnonzero(ends)
    start = np.concatenate([[0], last[:-1] + 1])
    length = last + SPAN - start
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * UP.upto(len(v)))])
    own = (total[start + length] - total[start]) * DOWN.upto(len(v))[start]
    return mix(least[start]), mix(own + length.astype(np.uint64)), start, length


ANCHORS = "bucket int, anchor binary, own binary, id binary, start binary, length binary"
KINDS = {"anchor": np.uint32, "own": np.uint64, "id": np.int64, "start": np.uint32, "length": np.uint8}


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted anchors of one in FREQUENT documents of a sample, or more. They only decide where stretches are dealt to."""

    def find(batches):
        for batch in batches:
            parts = [np.unique(stretches(t)[0]) for t in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))], names=["anchor"])

    share = max(1, n // SAMPLE)
    chosen = docs.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("data").mapInArrow(find, "anchor long")
    least = max(2, min(n, SAMPLE) // FREQUENT)
    rows = chosen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("anchor").collect()  # FREQUENT times a document's anchors at most
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _anchors(docs: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Packed arrays of anchors by bucket; docs has id and data.

    Buckets from `buckets` on hold stretches of frequent anchors, with all 64 bits of these; negative ones hold what a batch has
    settled, with id, start and length only.
    """

    def pack(columns: dict[str, np.ndarray], bucket: np.ndarray, kinds: dict):
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(first[1:], len(bucket))
        packed = {}
        for k in KINDS:
            if k in kinds:
                c = columns[k][order].astype(kinds[k])
                packed[k] = pa.array([c[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())
            else:
                packed[k] = pa.array([b""] * len(first), pa.binary())
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[first].astype(np.int32)), **packed})

    def find(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("data").to_pylist()
            parts = [stretches(t) for t in texts]
            n = [len(p[0]) for p in parts]
            if not sum(n):
                continue
            anchor, own, start, length = (np.concatenate(c) for c in zip(*parts))
            columns = {"anchor": anchor, "own": own, "id": np.repeat(np.array(ids, np.int64), n), "start": start, "length": length}
            bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            later = _later_copies(anchor, own, columns["id"])
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, anchor), len(frequent) - 1)
                hot = (frequent[at] == anchor) & ~later
                if hot.any():
                    yield pack({k: c[hot] for k, c in columns.items()}, buckets + (own[hot] % np.uint64(buckets)).astype(np.int64), WIDE)
            else:
                hot = np.zeros(len(later), bool)
            if later.any():
                salt = -1 - int(own[0] % np.uint64(buckets))
                yield pack({k: c[later] for k, c in columns.items()}, np.full(int(later.sum()), salt), SETTLED)
            rest = ~(later | hot)
            if rest.any():
                yield pack({k: c[rest] for k, c in columns.items()}, bucket[rest], KINDS)

    return docs.select("id", "data").mapInArrow(find, ANCHORS)


WIDE = KINDS | {"anchor": np.uint64}
SETTLED = {k: KINDS[k] for k in ("id", "start", "length")}


def _later_copies(anchor: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an equal stretch lies in a smaller document."""
    order = np.argsort(own, kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    if (~new & (np.diff(anchor[order], prepend=np.uint64(0)) != 0)).any():  # equal by chance, under another anchor
        order = np.lexsort((own, anchor))
        new[1:] = (own[order][1:] != own[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(own))))
    out = np.zeros(len(own), bool)
    out[order] = ids[order] > least
    return out


MET = "bucket int, anchor long, id long, start int, length int, open boolean"


def _met(anchors: DataFrame, buckets: int) -> DataFrame:
    """Stretches to remove whole (not open), and those whose anchor has different stretches in several documents (open)."""

    def rows(bucket, anchor, a, at, is_open):
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array(bucket.astype(np.int32)), "anchor": pa.array(anchor.astype(np.int64)), "id": a["id"][at],
             "start": a["start"][at].astype(np.int32), "length": a["length"][at].astype(np.int32), "open": is_open}
        )

    def judge(bucket: int, a: dict[str, np.ndarray]):
        if bucket < 0:
            n = len(a["id"])
            return rows(np.full(n, bucket), np.zeros(n), a, slice(None), np.zeros(n, bool))
        key = (a["anchor"].astype(np.uint64) & np.uint64(0xFFFFFFFF)) << np.uint64(32) | a["own"] >> np.uint64(32)
        order = np.argsort(key, kind="stable")
        if ((np.diff(key[order]) == 0) & (np.diff(a["own"][order]) != 0)).any():  # equal in the upper half of the hash only
            order = np.lexsort((a["own"], key))
        key, own, ids = key[order], a["own"][order], a["id"][order]
        classes = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]))
        least, most = np.minimum.reduceat(ids, classes), np.maximum.reduceat(ids, classes)
        anchor = key[classes] >> np.uint64(32)
        groups = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        n = np.diff(np.append(groups, len(classes)))
        several = (n > 1) & (np.minimum.reduceat(least, groups) < np.maximum.reduceat(most, groups))
        if bucket >= buckets:  # other stretches of a frequent anchor lie elsewhere
            several[:] = True
        size = np.diff(np.append(classes, len(key)))
        first = np.repeat(least, size)
        is_open = np.repeat(np.repeat(several, n), size) & (ids == first)
        keep = np.flatnonzero((ids > first) | is_open)
        at = order[keep]
        of = (a["anchor"][at] >> np.uint64(32)) % np.uint64(buckets) if bucket >= buckets else np.full(len(at), bucket)
        return rows(of, a["anchor"][at].astype(np.uint64) & np.uint64(0xFFFFFFFF), a, at, is_open[keep])

    def unpacked(bucket: int, held: dict[str, list[bytes]]):
        kinds = SETTLED if bucket < 0 else WIDE if bucket >= buckets else KINDS
        return {k: np.frombuffer(b"".join(held[k]), kind) for k, kind in kinds.items()}

    def meet(batches):
        # rows lie sorted by bucket: one bucket is held at a time
        now, held = None, {k: [] for k in KINDS}
        for batch in batches:
            columns = {k: batch.column(k).to_pylist() for k in ("bucket", *KINDS)}
            for i, bucket in enumerate(columns["bucket"]):
                if now is not None and (bucket != now or now < 0):
                    yield judge(now, unpacked(now, held))
                    held = {k: [] for k in KINDS}
                now = bucket
                for k in KINDS:
                    held[k].append(columns[k][i])
        if now is not None:
            yield judge(now, unpacked(now, held))

    return anchors.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, MET)


def shard_transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the two symbols before each sorted suffix, string of each, offset of each): suffixes with an end that is less than any byte.

    What comes before the start of a string is its end, and before that its last byte.
    """
    n = np.array([len(s) + 1 for s in strings])
    symbols = np.zeros(int(n.sum()), np.int64)
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(len(symbols)) - begin[owner]
    size = n[owner]
    symbols[offset < size - 1] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    end = begin[owner] + size - 1  # an end is followed by nothing; what lies beyond counts as an end
    at = np.arange(len(symbols))
    key = np.zeros(len(symbols), np.int64)
    for k in range(6):
        key = (key << 9) | symbols[np.minimum(at + k, end)]
    width, longest = 6, int(n.max())
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if width >= longest:
            break
        key = rank * (len(key) + 1) + rank[np.minimum(at + width, end)]
        width *= 2
    before = [symbols[(begin[owner] + (offset - k) % size)[order]] for k in (1, 2)]
    return np.stack(before), owner[order], offset[order]


def merge_transforms(one: np.ndarray, other: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a suffix is the other shard's, its interval) in the order of the first `length` (even) symbols of all suffixes.

    A round reads two symbols at once off both transforms.
    """
    source = np.repeat([False, True], [one.shape[1], other.shape[1]])
    used = np.unique(np.concatenate([one[0], other[0], [0]]))
    kind = np.uint16 if len(used) <= 256 else np.int32
    codes = [(np.searchsorted(used, t[1]) * len(used) + np.searchsorted(used, t[0])).astype(kind) for t in (one, other)]
    interval, count = np.zeros(len(source), np.int32), 1
    read = np.empty(len(source), kind)
    for _ in range(length // 2):
        read[~source], read[source] = codes  # each shard's symbols are read off in its own order
        order = np.argsort(read, kind="stable")
        symbols, source, was = read[order], source[order], interval[order]
        new = symbols[1:] != symbols[:-1]
        new[: max(0, int(np.searchsorted(symbols, len(used))) - 1)] = False  # ends are alike, whatever comes after them
        new |= (was[1:] != was[:-1]) & (symbols[1:] >= len(used)) & (symbols[1:] % len(used) != 0)
        interval = np.concatenate([np.zeros(1, np.int32), np.cumsum(new, dtype=np.int32)])
        if (now := int(interval[-1]) + 1) == count:
            break  # a partition that a round doesn't refine is final
        count = now
    return source, interval


def windows_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, interval) of each window of SPAN bytes, in the order of intervals; equal windows share an interval."""
    if len(strings) < 2:
        strings = [*strings, b""]
    shards = [np.arange(0, len(strings), 2), np.arange(1, len(strings), 2)]
    built = [shard_transform([strings[i] for i in own]) for own in shards]
    source, interval = merge_transforms(built[0][0], built[1][0], SPAN)
    at = np.argsort(source, kind="stable")
    string, offset = np.empty(len(source), np.int64), np.empty(len(source), np.int64)
    string[at] = np.concatenate([own[b[1]] for own, b in zip(shards, built)])
    offset[at] = np.concatenate([b[2] for b in built])
    lengths = np.array([len(s) for s in strings])
    whole = np.flatnonzero(offset + SPAN <= lengths[string])
    return string[whole], offset[whole], interval[whole]


def least_of(ids: np.ndarray, interval: np.ndarray) -> np.ndarray:
    """For each row the smallest id in its interval; rows lie in the order of intervals."""
    if not len(ids):
        return ids
    first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    return np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(interval))))


def repeated_windows(strings: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each window of SPAN bytes that a string of a smaller id holds as well."""
    string, offset, interval = windows_of(strings)
    gone = ids[string] > least_of(ids[string], interval)
    return string[gone], offset[gone]


def runs_of(string: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at consecutive offsets of a string as (string, first offset, end of the last window)."""
    if not len(string):
        return string, offset, offset
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    new = np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    return string[first], offset[first], offset[last] + SPAN


CUT = "bucket int, anchor long, id long, start int, piece binary"
SPANS = "id long, start int, end int"


def _pieces(docs: DataFrame, open_: DataFrame) -> DataFrame:
    lists = open_.groupBy("id").agg(F.collect_list(F.struct("bucket", "anchor", "start", "length")).alias("wanted"))
    lists = stored(lists, "open-by-document")  # as many as a document has stretches

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("bucket", "anchor", "id", "start", "piece")}
            for own, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "data", "wanted"))):
                for w in wanted:
                    out["bucket"].append(w["bucket"]), out["anchor"].append(w["anchor"]), out["id"].append(own), out["start"].append(w["start"])
                    out["piece"].append(data[w["start"] : w["start"] + w["length"]])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("anchor", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("piece", pa.binary())]))

    return docs.select("id", "data").join(lists, "id").mapInArrow(cut, CUT)


FOUND = "id long, start int, end int, deal int, packed binary"
WINDOW = np.dtype([("a", np.int64), ("b", np.int64), ("id", np.int64), ("start", np.int32)])


def _merged_spans(pieces: DataFrame, deals: int) -> DataFrame:
    """Spans to remove; and of anchors that several tasks share (shards > 1) each interval's windows in its smallest document, packed."""
    import xxhash

    def table(ids, start, end, deal=None, packed=None):
        none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.binary())]
        kinds = [pa.int64(), pa.int32(), pa.int32()]
        spans = [pa.array(c, t) for c, t in zip((ids, start, end), kinds)] if deal is None else [pa.nulls(len(deal), t) for t in kinds]
        rest = none if deal is None else [pa.array(deal, pa.int32()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays([*spans, *rest], names=["id", "start", "end", "deal", "packed"])

    def merge(batches):
        held, size, last, shared = [], 0, None, False

        def answer():
            ids, start, strings = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), [h[2] for h in held]
            string, offset, interval = windows_of(strings)
            at_least = ids[string] == least_of(ids[string], interval) if len(string) else np.zeros(0, bool)
            own, a, b = runs_of(string[~at_least], offset[~at_least])
            yield table(ids[own], start[own] + a, start[own] + b)
            if shared and len(string):
                string, offset, interval = string[at_least], offset[at_least], interval[at_least]
                first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
                marks = b"".join(xxhash.xxh3_128_digest(strings[s][o : o + SPAN]) for s, o in zip(string[first].tolist(), offset[first].tolist()))
                marks = np.repeat(np.frombuffer(marks, np.int64).reshape(-1, 2), np.diff(np.append(first, len(string))), axis=0)
                rows = np.empty(len(string), WINDOW)
                rows["a"], rows["b"], rows["id"], rows["start"] = marks[:, 0], marks[:, 1], ids[string], start[string] + offset
                deal = rows["a"] % deals
                order = np.argsort(deal, kind="stable")
                some, at = np.unique(deal[order], return_index=True)
                yield table((), (), (), some, [x.tobytes() for x in np.split(rows[order], at[1:])])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "anchor", "shard", "shards", "id", "start", "piece"))
            for bucket, anchor, shard, shards, own, start, piece in zip(*columns):
                group = (bucket, anchor, shard)
                if held and group != last and (size > CHUNK or shared or shards > 1):
                    yield from answer()
                    held, size = [], 0
                held.append((own, start, piece))
                size, last, shared = size + len(piece), group, shards > 1
        if held:
            yield from answer()

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "bucket", "anchor", "shard").sortWithinPartitions("bucket", "anchor", "shard")
    return dealt.mapInArrow(merge, FOUND)


def _spans_across(packed: DataFrame, deals: int) -> DataFrame:
    """Of windows that several tasks sent, those that a smaller document holds: packed rows of a deal, which has about ACROSS windows."""

    def judge(held: list[bytes]):
        rows = np.frombuffer(b"".join(held), WINDOW)
        rows = rows[np.lexsort((rows["b"], rows["a"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
        gone = rows[rows["id"] > least_of(rows["id"], np.cumsum(new))]
        # windows of a document that follow each other are one span
        gone = gone[np.lexsort((gone["start"], gone["id"]))]
        string, a, b = runs_of(gone["id"].copy(), gone["start"].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(string, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["id", "start", "end"])

    def meet(batches):
        now, held = None, []
        for batch in batches:
            for deal, data in zip(batch.column("deal").to_pylist(), batch.column("packed").to_pylist()):
                if held and deal != now:
                    yield judge(held)
                    held = []
                now = deal
                held.append(data)
        if held:
            yield judge(held)

    return packed.select("deal", "packed").repartition(deals, "deal").sortWithinPartitions("deal").mapInArrow(meet, SPANS)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table (id, spans) of the bytes to remove, spans as they were found (they may overlap)."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), bytes_of(text).alias("data"))
    mixed = base.groupBy("id").agg(F.min(F.xxhash64("data")).alias("a"), F.max(F.xxhash64("data")).alias("b"), F.sum(F.octet_length("data")).alias("n"))
    facts = mixed.agg(F.sum("n").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("ambiguous"), F.count(F.lit(1)).alias("rows")).first()
    if facts["ambiguous"]:
        base = base.join(stored(mixed.where("a <> b").select("id"), "ambiguous-ids"), "id", "left_anti")
    buckets = max(1, -(-int(facts["n"] or 0) // BUCKET_BYTES))
    buckets = max(buckets, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    frequent = _frequent(base, int(facts["rows"]))
    met = stored(_met(_anchors(base, buckets, frequent), buckets), "stretches-met")
    spans = met.where("not open").select("id", "start", (F.col("start") + F.col("length")).alias("end"))
    open_ = met.where("open")
    hot = open_.groupBy("bucket", "anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    hot = stored(hot.select("bucket", "anchor", "n", F.ceil(F.col("n") / HOT).cast("int").alias("several")), "hot-anchors")
    deals = math.ceil((hot.agg(F.sum("n")).first()[0] or 0) * (REACH + 1) / ACROSS)
    pieces = stored(_pieces(base, open_), "pieces").join(hot.drop("n"), ["bucket", "anchor"], "left")
    pieces = pieces.withColumn("shards", F.coalesce("several", F.lit(1))).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    found = stored(_merged_spans(pieces, deals), "merged-spans")
    spans = spans.unionByName(found.where("deal is null").select("id", "start", "end"))
    if deals:
        spans = spans.unionByName(stored(_spans_across(found.where("deal is not null"), deals), "spans-across"))
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # as many as a document has stretches
    return stored(spans, "repeated-spans")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) of every row: kept is the bytes left."""
    spans = repeated_spans(docs, key, text)
    found = spans.withColumnRenamed("id", "of")
    base = docs.select(F.col(key).cast("bigint").alias("id"), bytes_of(text).alias("data"))
    at = base.join(found, F.col("id") == F.col("of"), "left").select("id", "data", "spans")

    def cut(batches):
        for batch in batches:
            n, removed, parts, kept = [], [], [], []
            for data, own in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                gone = merged([(s["start"], s["end"]) for s in own or ()])
                n.append(len(data))
                removed.append(sum(b - a for a, b in gone))
                parts.append([{"start": a, "end": b} for a, b in gone])
                ends = [0, *(x for s in gone for x in s), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                 pa.array(parts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"],
            )

    return at.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")


def op5(spark, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
