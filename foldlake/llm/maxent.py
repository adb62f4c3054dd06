"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) is a product over the classes that hold the word, from the coarsest to the word itself: at each, a softmax over WIDTH
subclasses. The classes are a Huffman tree of fan-out WIDTH over the training counts, so that frequent words are one or two decisions
away and the tree deepens with the vocabulary. Its leaves are the HEAD most frequent words, one by one (fewer if the corpus has fewer),
and TAIL classes of all other words by a hash of their last two bytes; within such a class a word has its smoothed share of the class's
training tokens, so that no word, seen or not, is left without probability. A decision adds up weight rows of features of the history:
the last word, the skips to the word before and to the third last, and the pair of the last two, each hashed with the class (at deeper
classes fewer of them, see FEATURES), and the class's own row, which starts as the unigram model.

Training is iterative parameter mixing (McDonald et al. 2010): in each of ROUNDS rounds every task makes minibatch gradient steps
(per-row AdaGrad) from the current weights over its part of the training texts; each step updates the rows of all its features. A row's
changes are averaged over the tasks, weighted by how often each met it, so that a rare n-gram's row isn't diluted by tasks that never
met it. All training texts are used, each in one round. Weights depend on which texts share a task, and in what order: on the same
files and splits they are the same at every run.

Texts are read twice: once to count words, once to turn them into leaves of the tree, which are stored. Training and scoring read the
leaves, in sparse minibatches of feature rows.

Counts are exact. The HEAD most frequent words (down to a count threshold) go to the tasks as a broadcast of bounded size; the counts of
all others meet their occurrences in a join by word. What grows with the corpus stays in tables; what is collected or broadcast (HEAD
words, ROWS weight rows and one a class) is bounded by parameters. ROWS is also what a task sends in a round, so it can't follow the
corpus: every task would send a model as large as the corpus.

Defined results: null texts are empty and have one token, the end; rows with a null id are training rows unless held_out says
otherwise; repeated rows are each scored; without training rows every count is 0 and all tail classes are equally likely; an empty
table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import bytes_of, small_batches, stored, words

HEAD = 1 << 18
WIDTH, TAIL = 16, 32
#: Features of a decision by its depth (the last entry holds below as well), and the weight rows (powers of two) that they are hashed to.
FEATURES = (("last", "skip", "third", "pair"), ("last", "skip", "pair"), ("last", "skip"))
ROWS = (1 << 16, 1 << 15, 1 << 15)
ROUNDS, RATE, BATCH = 2, 0.15, 4096
EAGER, EAGER_BATCH = 96, 512  # the first steps of a task are small
FLUSH = 600_000  # distinct words a task counts before it passes them on
END = b""
ADD = 0.1
BLOCK = 1 << 11  # weight rows in a block of changes
LARGEST = 60.0  # of a sum of weights, where it would not have a finite exponential
ROW = np.dtype((np.void, 4 * WIDTH))  # a weight row as one item: written in one move
ONES = np.ones(WIDTH, np.float32)  # sums over a row as a product


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over a column `data`; the end of a text counts as the empty word."""

    def count(batches):
        held: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for data in batch.column("data").to_pylist():
                held.update(words(data))
                held[END] += 1
            if len(held) > FLUSH:
                yield flush()
        yield flush()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tree:
    """A Huffman tree of fan-out WIDTH: for each leaf the classes on its way (nodes), the branch taken at each (digits), and their number."""

    def __init__(self, weights: np.ndarray) -> None:
        n = len(weights)
        spare = -(n - 1) % (WIDTH - 1)  # branches without a word, at the bottom
        order = np.argsort(weights, kind="stable")
        leaves, sums, at, made = [-1] * spare + order.tolist(), [], 0, 0
        mass = [0.0] * spare + weights[order].tolist()
        children: list[list[int]] = []  # of each class: leaves, or n + the number of a class; -1: spare
        while len(leaves) - at + len(children) - made > 1 or not children:
            own, total = [], 0.0
            while len(own) < WIDTH and (at < len(leaves) or made < len(children)):
                if made == len(children) or at < len(leaves) and mass[at] <= sums[made]:
                    own.append(leaves[at])
                    total, at = total + mass[at], at + 1
                else:
                    own.append(n + made)
                    total, made = total + sums[made], made + 1
            children.append(own)
            sums.append(total)
        last = len(children) - 1  # the root is the last class made; it becomes class 0
        self.length = np.zeros(n, np.int16)
        above: dict[int, tuple[tuple[int, int], ...]] = {last: ()}
        ways: list[tuple[tuple[int, int], ...]] = [()] * n
        size = np.zeros((len(children), WIDTH))
        for k in range(last, -1, -1):
            way = above.pop(k)
            for d, child in enumerate(children[k]):
                if child >= n:
                    above[child - n] = (*way, (last - k, d))
                    size[last - k, d] = sums[child - n]
                elif child >= 0:
                    ways[child] = (*way, (last - k, d))
                    size[last - k, d] = weights[child]
        self.depth = max(map(len, ways))
        self.length = np.array([len(w) for w in ways], np.int16)
        self.nodes, self.digits = np.zeros((self.depth, n), np.int32), np.zeros((self.depth, n), np.int8)
        for leaf, way in enumerate(ways):
            for depth, (node, digit) in enumerate(way):
                self.nodes[depth, leaf], self.digits[depth, leaf] = node, digit
        self.n_nodes, self.n_leaves = len(children), n
        share = size / np.maximum(size.sum(axis=1, keepdims=True), 1e-30)
        #: Where no word lies there is no probability: the weights of spare branches are low and stay so, as nothing is ever chosen.
        self.start = np.where(size > 0, np.log(np.maximum(share, 1e-12)), -LARGEST).astype(np.float32)


class Vocabulary:
    """The frequent words with their counts, and the totals of the tail classes."""

    def __init__(self, head: list[tuple[bytes, int]], tail: dict[int, tuple[int, int]], total: int, distinct: int) -> None:
        head = sorted(head, key=lambda x: (x[0] != END, -x[1], x[0]))  # the end comes first
        self.spelled = b" ".join(w for w, _ in head[1:]) if head else b""  # words hold no spaces; the first is the end
        self.counts = np.array([n for _, n in head], np.float64)
        self.total, self.distinct = total, distinct
        rest = np.zeros((TAIL, 2))
        for k, (n, v) in tail.items():
            rest[k] = n, v
        self.tail_weight = rest[:, 0]
        self.tail_log = np.log10(rest[:, 0] + ADD * (rest[:, 1] + 1))
        self.none = len(head) + TAIL  # the symbol before a text begins

    def index(self) -> dict[bytes, int]:
        return {END: 0} | {w: i + 1 for i, w in enumerate(self.spelled.split())} if len(self.counts) else {}

    def tree(self) -> Tree:
        return Tree(np.concatenate([self.counts, self.tail_weight + 1]))


OFFSETS = np.cumsum((0, *ROWS))
_PRIMES = {"last": 0x9E3779B97F4A7C15, "skip": 0xC2B2AE3D27D4EB4F, "third": 0x165667B19E3779F9, "pair": 0xD6E8FEB86659FD93}


class Model:
    """Weights (hashed rows, then a row for each class), and the steps of scoring and training over stretches of symbols."""

    def __init__(self, tree: Tree, weights: np.ndarray) -> None:
        self.tree, self.w = tree, weights

    @staticmethod
    def start(tree: Tree) -> np.ndarray:
        """Weights of the unigram model."""
        return np.concatenate([np.zeros((OFFSETS[-1], WIDTH), np.float32), tree.start])

    @staticmethod
    def hashed(kind: str, history: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
        level = min(depth, len(ROWS) - 1)
        h = (history.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + node.astype(np.uint64) + np.uint64(1)) * np.uint64(_PRIMES[kind])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(40)) & np.uint64(ROWS[level] - 1)).astype(np.int64) + OFFSETS[level]

    def rows(self, symbols: np.ndarray, at: np.ndarray, node: np.ndarray, depth: int) -> list[np.ndarray]:
        """The weight rows of each place's decision."""
        one, two = symbols[at - 1], symbols[at - 2]
        out = [node.astype(np.int64) + OFFSETS[-1]]
        for kind in FEATURES[min(depth, len(FEATURES) - 1)]:
            history = one if kind == "last" else two if kind == "skip" else symbols[at - 3] if kind == "third" else one * (self.tree.n_leaves + 1) + two
            out.append(self.hashed(kind, history, node, depth))
        return out

    def decide(self, symbols: np.ndarray, at: np.ndarray, depth: int):
        """ln P of the branch taken at a depth, at places that go so deep; and for a step exp(scores), their sums, places of branches, rows."""
        own = symbols[at]
        digit = self.tree.digits[depth][own]
        rows = self.rows(symbols, at, self.tree.nodes[depth][own], depth)
        picked = np.arange(0, len(at) * WIDTH, WIDTH) + digit
        z = self.scores(rows)
        chosen = z.ravel().take(picked)
        with np.errstate(over="ignore"):
            total = np.exp(z, out=z) @ ONES
        if not np.isfinite(total).all():
            z = np.clip(self.scores(rows), -LARGEST, LARGEST)
            chosen = z.ravel().take(picked)
            total = np.exp(z, out=z) @ ONES
        return chosen - np.log(total), z, total, picked, rows

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.take(self.w, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(self.w, r, axis=0)
        return z

    def log_probabilities(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """ln P(leaf | history) at places."""
        out, deep = np.zeros(len(at)), np.arange(len(at))
        for depth in range(self.tree.depth):
            deep = deep[self.tree.length[symbols[at[deep]]] > depth]
            if not len(deep):
                break
            out[deep] += self.decide(symbols, at[deep], depth)[0]
        return out

    def step(self, symbols: np.ndarray, at: np.ndarray, seen: np.ndarray, met: np.ndarray) -> None:
        """A gradient step on a minibatch at all depths; seen has the sums of squares of each row, met how often it was met."""
        for depth in range(self.tree.depth):
            at = at[self.tree.length[symbols[at]] > depth]
            n = len(at)
            if not n:
                break
            _, z, total, picked, rows = self.decide(symbols, at, depth)
            z *= (-1.0 / total)[:, None]
            z.ravel()[picked] += 1
            keys = np.concatenate(rows)
            keys <<= 17  # a batch has at most 2**17 places and features
            keys |= np.arange(len(keys))
            keys.sort()
            place = (keys & 0x1FFFF) % n
            idx = keys >> 17
            first = np.flatnonzero(np.diff(idx, prepend=-1))
            times = np.diff(first, append=len(idx))
            once, more = times == 1, times > 1
            self._apply(idx[first[once]], np.take(z, place[first[once]], axis=0), times[once], seen, met)
            if more.any():
                several = np.repeat(more, times)
                g = np.take(z, place[several], axis=0)
                starts = np.cumsum(times[more]) - times[more]
                sums = np.add.reduceat(g.view(np.complex64), starts, axis=0).view(np.float32)  # two weights at once
                self._apply(idx[first[more]], sums, times[more], seen, met)

    def _apply(self, rows: np.ndarray, sums: np.ndarray, times: np.ndarray, seen: np.ndarray, met: np.ndarray) -> None:
        met[rows] += times
        s = seen[rows]
        s += (sums * sums) @ ONES / WIDTH
        seen[rows] = s
        sums *= (RATE / np.sqrt(s + 1e-3))[:, None]
        sums += np.take(self.w, rows, axis=0)
        np.put(self.w.reshape(-1).view(ROW), rows, np.ascontiguousarray(sums).reshape(-1).view(ROW))


def leaves_of(texts: list[bytes], index: dict[bytes, int]):
    """(leaf of each token, ids in the head or -1, tokens of each text, words out of the head of each text)."""
    get, parts, sizes, outside = index.get, [], [], []
    for data in texts:
        found = words(data)
        found.append(END)
        ids = np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))
        parts.append(ids)
        sizes.append(len(found))
        outside.append([found[i] for i in np.flatnonzero(ids < 0)])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    leaves, missing = ids.copy(), np.flatnonzero(ids < 0)
    if len(missing):
        cache: dict[bytes, int] = {}
        of = lambda end: cache.get(end) or cache.setdefault(end, len(index) + tail_class(end))
        leaves[missing] = [of(w[-2:]) for own in outside for w in own]
    return leaves, ids, np.array(sizes, np.int64), outside


def _stretch(packed: list[bytes], none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with three `none` before each text, places of tokens, text of each token)."""
    parts = [np.frombuffer(p, np.int32) for p in packed]
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(int(sizes.sum())) + 3 * (text + 1)
    symbols = np.full(len(at) + 3 * len(parts), none, np.int64)
    symbols[at] = np.concatenate(parts) if parts else 0
    return symbols, at, text


CHANGES = "block int, met binary, change binary"


def train(encoded: DataFrame, tree: Tree, rounds: int = ROUNDS) -> np.ndarray:
    """Mixed weights after all rounds; encoded has `leaves` (packed) and `part`, the round that a text is used in."""
    spark = encoded.sparkSession
    held = spark.sparkContext.broadcast(tree)
    flat = Model.start(tree)
    for k in range(rounds):
        now = spark.sparkContext.broadcast(flat)

        def update(batches, now=now):
            tree = held.value
            start = now.value
            model, no = Model(tree, start.copy()), 0
            seen, met = np.zeros(len(start), np.float32), np.zeros(len(start), np.int64)
            for batch in batches:
                symbols, at, _ = _stretch(batch.column("leaves").to_pylist(), tree.n_leaves)
                i = 0
                while i < len(at):
                    size = EAGER_BATCH if no < EAGER else BATCH
                    model.step(symbols, at[i : i + size], seen, met)
                    i, no = i + size, no + 1
            for i in range(0, len(start), BLOCK):  # 16 bits are enough for changes that will be averaged
                own = met[i : i + BLOCK]
                if own.any():
                    change = (model.w[i : i + BLOCK] - start[i : i + BLOCK]).astype(np.float16)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i // BLOCK], pa.int32()), "met": [own.astype(np.float32).tobytes()], "change": [change.tobytes()]})

        def mix(batches):
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for block, met, change in zip(*(batch.column(c).to_pylist() for c in ("block", "met", "change"))):
                    n = np.frombuffer(met, np.float32).astype(np.float64)
                    own = sums.setdefault(block, [np.zeros(len(n)), np.zeros((len(n), WIDTH))])
                    own[0] += n
                    own[1] += n[:, None] * np.frombuffer(change, np.float16).reshape(len(n), WIDTH)
            for block, (n, total) in sums.items():
                change = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "met": [b""], "change": [change.tobytes()]})

        own = encoded.where(F.col("part") == k).select("leaves")
        blocks = math.ceil(len(flat) / BLOCK)
        changes = own.mapInArrow(update, CHANGES).repartition(blocks, "block").mapInArrow(mix, CHANGES)
        flat = flat.copy()
        for r in changes.collect():  # one row a block: as many weights as the model has
            got = np.frombuffer(bytes(r["change"]), np.float32).reshape(-1, WIDTH)
            flat[r["block"] * BLOCK :][: len(got)] += got
    return flat


def vocabulary(training: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of a column `data`, and the stored counts (word, n) of the words out of its head."""
    counts = stored(count_words(training), "word-counts")
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # the least count of the head: the histogram of counts has at most about sqrt(2 * tokens) rows, and is aggregated from the top
    steps = counts.where(F.length("word") > 0).groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    room, least = HEAD - 1, 1
    for r in steps.toLocalIterator():
        if r["words"] > room:
            least = r["n"] + 1
            break
        room -= r["words"]
    in_head = (F.col("n") >= least) | (F.length("word") == 0)
    head = [(bytes(r[0]), r[1]) for r in counts.where(in_head).select("word", "n").toLocalIterator()]  # at most HEAD
    rest = counts.where(~in_head)
    of_tail = F.crc32(F.substring("word", -2, 2)) % TAIL
    tail = {r[0]: (r[1], r[2]) for r in rest.groupBy(of_tail.cast("int").alias("k")).agg(F.sum("n"), F.count(F.lit(1))).collect()}  # TAIL rows
    return Vocabulary(head, tail, totals[0] or 0, totals[1]), rest


def encode(rows: DataFrame, vocab: Vocabulary, kind: str) -> DataFrame:
    """rows (id, held_out, part, data) with their leaves, counts of tokens, and the words out of the head; `row` numbers them."""
    held = rows.sparkSession.sparkContext.broadcast(vocab)

    def turn(batches):
        v = held.value
        index = v.index()
        log_count = np.log10(v.counts + ADD) if len(v.counts) else np.zeros(1)
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            n_rows = batch.num_rows
            if not n_rows:
                continue
            leaves, ids, sizes, outside = leaves_of(batch.column("data").to_pylist(), index)
            text, inside = np.repeat(np.arange(n_rows), sizes), ids >= 0
            ends = np.cumsum(sizes)
            tails = [Counter(o) for o in outside]
            tail_ends = np.cumsum([0, *map(len, tails)])
            tails = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array([w for t in tails for w in t], pa.binary()), pa.array([c for t in tails for c in t.values()], pa.int64())], ["word", "times"]
            ))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), batch.column("part"), pa.array((task << 33) + k + np.arange(n_rows)), pa.array(sizes),
                 pa.array(np.bincount(text, inside, n_rows).astype(np.int64)), pa.array(np.bincount(text, np.where(inside, log_count[np.maximum(ids, 0)], 0.0), n_rows)),
                 pa.array([leaves[a:b].tobytes() for a, b in zip(ends - sizes, ends)], pa.binary()), tails],
                names=["id", "held_out", "part", "row", "n_tokens", "n_head", "head_log", "leaves", "tails"],
            )
            k += n_rows

    return rows.mapInArrow(turn, f"id {kind}, held_out boolean, part int, row long, n_tokens long, n_head long, head_log double, leaves binary, "
                                 "tails array<struct<word:binary,times:long>>")  # fmt: skip


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs; learns from rows not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("id"), held_out.alias("held_out"), bytes_of(text).alias("data"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("data"), F.lit(rounds)).cast("int"))
    vocab, rest = vocabulary(rows.where(~F.col("held_out")).select("data"))
    encoded = stored(encode(rows, vocab, docs.schema[key].dataType.simpleString()), "leaves")
    tree = vocab.tree()
    flat = spark.sparkContext.broadcast(train(encoded.where(~F.col("held_out")), tree, rounds))
    held, tail_log = spark.sparkContext.broadcast(tree), vocab.tail_log

    def evaluate(batches):
        tree = held.value
        model = Model(tree, flat.value)
        per_leaf = np.concatenate([np.zeros(tree.n_leaves - TAIL), tail_log])
        for batch in batches:
            symbols, at, text_no = _stretch(batch.column("leaves").to_pylist(), tree.n_leaves)
            value = np.zeros(len(at))
            for i in range(0, len(at), BATCH):
                value[i : i + BATCH] = model.log_probabilities(symbols, at[i : i + BATCH])
            value = value / math.log(10) - per_leaf[symbols[at]]
            kept = [c for c in batch.schema.names if c != "leaves"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.bincount(text_no, value, batch.num_rows))], names=[*kept, "model_log"])

    kind = docs.schema[key].dataType.simpleString()
    scored = encoded.select("id", "held_out", "row", "n_tokens", "n_head", "head_log", "leaves").mapInArrow(
        evaluate, f"id {kind}, held_out boolean, row long, n_tokens long, n_head long, head_log double, model_log double"
    )
    met = encoded.select("row", F.explode("tails").alias("t")).select("row", "t.word", "t.times").join(rest, "word", "left")
    count = F.coalesce(F.col("n"), F.lit(0))
    sums = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(count + ADD)).alias("tail_log"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("n_rare")
    )
    out = scored.join(sums, "row", "left")
    in_tail = F.coalesce("tail_log", F.lit(0.0))
    over = math.log10(vocab.total + ADD * (vocab.distinct + 1))
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("head_log") + in_tail - F.col("n_tokens") * over).alias("base_score"), (F.col("model_log") + in_tail).alias("score"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out).withColumnRenamed("id", "doc_id")
