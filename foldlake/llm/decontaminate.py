"""Benchmark decontamination with suffix arrays over shards of the training texts.

Documents are dealt to shards of SHARD_BYTES or of one text. A shard's words are numbered by the benchmark's vocabulary (0: in no test item), and the
shard's suffix array holds every suffix that could match: those whose first words all occur in the benchmark. Every test suffix
(each window of WINDOW consecutive words of an item; an item with fewer words is one window) is binary-searched in the array of
every shard, which gives the range of its occurrences and their locations; neighbours that go on in the same item join to its longest
verbatim matches (of a whole window or more).
The documents never move: the benchmark's windows are broadcast in blocks of bounded size, and one pass over the documents
answers each block. Nothing is shuffled unless the benchmark needs more than one block.

Defined results: null and empty texts have no words and no hits; a null item has no windows; repeated rows of documents are judged
each by itself; repeated items are each listed; an empty benchmark or an empty documents table gives no hits, or no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.llm.common import bytes_of, field, free_name, small_batches

WINDOW = 10
#: UTF-8 bytes of item text in one broadcast block of the benchmark, which is about ten times as large in a task.
BLOCK_BYTES = 16 << 20
#: UTF-8 bytes of texts in one shard, which takes up to about thirty times as much while it is searched.
SHARD_BYTES = 4 << 20

#: Lower-cases A-Z and turns all ASCII but digits and letters into spaces; bytes from 0x80 on belong to words.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

SPAN = T.StructType([field("start", T.IntegerType()), field("end", T.IntegerType()), field("item", T.StringType())])
FOUND = T.StructType(
    [
        field("n_words", T.LongType()),
        field("n_hit", T.LongType()),
        field("longest", T.LongType()),
        field("items", T.ArrayType(T.StringType())),
        field("spans", T.ArrayType(SPAN)),
    ]
)


def bench_words(data: bytes) -> list[bytes]:
    return data.translate(TO_WORDS).split()


class TestSuffixes:
    """The windows of a block of test items, numbered and sorted, ready to be searched for.

    A word of the block takes about 60 bytes: its window as a key of 4 bytes a word, and the item and offset that it starts at.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.window, self.vocab = window, {}
        self.items = [item for item, _ in items]
        number = self.vocab.setdefault
        texts = [np.array([number(w, len(self.vocab) + 1) for w in bench_words(text)], np.uint32) for _, text in items]
        sizes = np.array([len(t) for t in texts], np.int64)
        # full windows of long items; an item with fewer words is one window, filled up with zeros
        counts = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        item = np.repeat(np.arange(len(texts)), counts)
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = np.concatenate([*texts, np.zeros(window, np.uint32)])
        begin = (np.cumsum(sizes) - sizes)[item] + offset
        length = np.minimum(sizes[item] - offset, window)
        rows = np.lib.stride_tricks.sliding_window_view(flat, window)[begin].astype(">u4")
        rows[np.arange(window) >= length[:, None]] = 0
        keys = self.packed(rows)
        order = np.lexsort((offset, item, keys))
        keys, self.item, self.offset = keys[order], item[order].astype(np.int32), offset[order].astype(np.int32)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.first = np.append(np.flatnonzero(new), len(keys))  # where the owners of each distinct window begin
        self.low = keys[new]
        self.lengths = length[order][new].astype(np.int32)
        self.short = np.flatnonzero(self.lengths < window)
        high = np.frombuffer(b"".join(k.ljust(4 * window, b"\0") for k in self.low[self.short]), ">u4").reshape(-1, window).copy()
        high[np.arange(window) >= self.lengths[self.short][:, None]] = 0xFFFFFFFF
        self.high = self.packed(high)
        self.least = int(self.lengths.min()) if len(self.low) else 0

    def packed(self, rows: np.ndarray) -> np.ndarray:
        """Rows of word numbers as byte strings whose order is that of the numbers."""
        return np.ascontiguousarray(rows, ">u4").view(f"S{4 * self.window}").reshape(-1)

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and all occurrences of windows as (text, first word there, window), by the shard's suffix array."""
        get, counts, parts = self.vocab.get, np.zeros(len(texts), np.int64), []
        none = np.zeros(0, np.int64)
        for k, text in enumerate(texts):
            found = bench_words(text)
            counts[k] = len(found)
            ids = np.zeros(len(found) + 1, np.uint32)  # texts are one word of no item apart
            ids[:-1] = np.fromiter(map(get, found, repeat(0)), np.uint32, len(found))
            parts.append(ids)
        if not parts or not len(self.low):
            return counts, none, none, none
        ids = np.concatenate([*parts, np.zeros(self.window, np.uint32)])
        # how many words from each place on are the benchmark's: the next 0's place less this one's
        zero = np.flatnonzero(ids == 0)
        places = np.flatnonzero(ids)
        run = zero[np.searchsorted(zero, places)] - places
        places, run = places[run >= self.least], run[run >= self.least]
        if not len(places):
            return counts, none, none, none
        rows = np.lib.stride_tricks.sliding_window_view(ids, self.window)[places]
        rows[np.arange(self.window) >= run[:, None]] = 0  # a suffix ends with its text, or with a word of no item
        suffixes = self.packed(rows)
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        first, last = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.low, "right")
        last[self.short] = np.searchsorted(array, self.high, "right")
        times = last - first
        window = np.repeat(np.arange(len(times)), times)
        place = places[order[np.repeat(first, times) + np.arange(len(window)) - np.repeat(np.cumsum(times) - times, times)]]
        begin = np.cumsum(counts + 1) - counts - 1
        text = np.searchsorted(begin, place, "right") - 1
        return counts, text, place - begin[text], window

    def spans(self, text: np.ndarray, start: np.ndarray, window: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
        """Occurrences as each text's longest verbatim matches (start, end, item): neighbours that go on in the item join."""
        if not len(window):
            return {}
        times = self.first[window + 1] - self.first[window]
        owner = np.repeat(self.first[window], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        text, start, length = np.repeat(text, times), np.repeat(start, times), np.repeat(self.lengths[window], times)
        item, shift = self.item[owner], self.offset[owner] - start
        order = np.lexsort((start, shift, item, text))
        text, start, length, item, shift = text[order], start[order], length[order], item[order], shift[order]
        new = np.ones(len(text), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(start) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text)) - 1
        out: dict[int, set[tuple[int, int, str]]] = defaultdict(set)
        for k, a, b, i in zip(text[first].tolist(), start[first].tolist(), (start[last] + length[last]).tolist(), item[first].tolist()):
            out[k].add((a, b, self.items[i]))
        return {k: sorted(v) for k, v in out.items()}


def shards(texts: list[bytes]):
    """Runs of texts of at most SHARD_BYTES, or of one text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SHARD_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def covered(spans) -> int:
    total, upto = 0, 0
    for start, end, _ in sorted(spans):
        total += max(0, end - max(start, upto))
        upto = max(upto, end)
    return total


def summary(n_words: int, spans: list[tuple[int, int, str]]) -> dict:
    return {
        "n_words": n_words,
        "n_hit": covered(spans),
        "longest": max((e - s for s, e, _ in spans), default=0),
        "items": sorted({item for _, _, item in spans}),
        "spans": [{"start": s, "end": e, "item": item} for s, e, item in spans],
    }


FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("longest", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))),
    ]
)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
            window: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "found") -> DataFrame:
    """docs with a struct column (FOUND): words, hit words, longest verbatim match, items met, and where.

    The benchmark is cut into blocks of at most block_bytes (or one item) that follow its ids; each is broadcast and answered in
    one pass over the documents, and the passes add their spans.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = benchmark.where(F.col(item_text).isNotNull()).select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("binary").alias("data")
    )
    total = held.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    column = free_name(docs, name)
    out = docs.withColumn(column, F.lit(None).cast(FOUND))
    for k in range(n):
        own = held if n == 1 else held.where(F.pmod(F.xxhash64("item", "data"), F.lit(n)) == k)
        block = spark.sparkContext.broadcast(TestSuffixes([(r.item, bytes(r.data)) for r in own.toLocalIterator()], window))
        out = _one_block(out, block, text, column)
    return out


def _one_block(docs: DataFrame, block, text: str, column: str) -> DataFrame:
    data = free_name(docs, "data_of_text")

    def answer(batches):
        tests = block.value
        for batch in batches:
            rows = []
            before_all = batch.column(column).to_pylist()
            for texts in shards(batch.column(data).to_pylist()):
                counts, *met = tests.search(texts)
                own, at = tests.spans(*met), len(rows)
                rows += [(count, own.get(k, []), before_all[at + k]) for k, count in enumerate(counts.tolist())]
            for k, (count, spans, before) in enumerate(rows):
                if before:
                    spans = sorted({*spans, *((s["start"], s["end"], s["item"]) for s in before["spans"])})
                rows[k] = summary(count, spans)
            kept = [c for c in batch.schema.names if c not in (data, column)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(rows, FOUND_ARROW)], names=[*kept, column]
            )

    schema = T.StructType([f for f in docs.schema if f.name != column] + [T.StructField(column, FOUND)])
    return docs.withColumn(data, bytes_of(text)).mapInArrow(answer, schema)


def is_contaminated(found: str = "found") -> Column:
    return F.col(found)["n_hit"] > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns."""
    column = free_name(docs, "found")
    return matches(docs, benchmark, **how).where(~is_contaminated(column)).select(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
