"""Language identification as mixture inference over character n-grams.

Every language has a distribution over hashed n-grams of its letters (n = 1 to 3, within words). A text is a mixture of languages:
expectation-maximisation finds the proportions that make its n-grams likeliest, and the set of languages is grown greedily for as
long as the likelihood rises by more than PENALTY nats for each proportion added, plus half the logarithm of the n-gram count (the
Bayesian information criterion's price). The prediction is the language with the largest proportion; the score is that proportion.

The mixture log-likelihood is concave, so max_j n*(g_j - 1), g being its gradient at the current proportions, bounds what any
further language could add. Most texts stop at that test after one language, without EM.

The distributions are learned from all labelled texts, at whole length; copies count once, so a label with one text is learned like
any other. Texts whose hash no other has are counted where they lie; those that a Bloom filter of repeated hashes passes are shuffled
and told apart as a whole, so the filter's errors and equal hashes change no count. LANGUAGES bounds how many label values are learned (a warning says so if there are more), as each takes SLOTS numbers in
every task. Expectation-maximisation runs until the likelihood rises by less than TOLERANCE nats. Prediction reads only the text.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled text all are `und`. Repeated
rows are predicted alike; ties in likelihood or proportion go to the language that sorts first; null ids and extra columns don't matter.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.llm import urlfilter
from foldlake.llm.common import drop_stored, field, free_name, small_batches, stored

#: Most label values that are learned: those with the most different texts.
LANGUAGES = 512
#: Bits of the filter of repeated texts for each of them, and at most; a fuller one only passes more.
FILTER_BITS, MOST_FILTER_BITS = 10.0, 1 << 23
#: Slots that n-grams are hashed to.
SLOTS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTH = 0.05
PENALTY = 3.0
TOLERANCE = 1e-3
UND = "und"

PREDICTED = T.StructType(
    [
        field("lang", T.StringType()),
        field("score", T.DoubleType()),
        field("langs", T.ArrayType(T.StringType())),
        field("shares", T.ArrayType(T.DoubleType())),
    ]
)
PREDICTED_ARROW = pa.struct(
    [("lang", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))]
)

#: ASCII as read for n-grams: letters in lower case, all else a space. Bytes of longer UTF-8 sequences stay.
LETTERS = np.array(
    [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8
)


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of a text, and how often each occurs. Words begin and end with a space; no n-gram spans two words."""
    b = LETTERS[np.frombuffer(b" " + data + b" ", np.uint8)]
    space = b == 32
    keep = ~(space[1:] & space[:-1])
    b = np.concatenate([b[:1], b[1:][keep]]).astype(np.uint32)
    if len(b) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = b != 32
    found, h = [], np.zeros(len(b), np.uint32)
    for n in ORDERS:
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        # a space may be the first or the last character of an n-gram, not one between
        ok = inner.copy() if n == 1 else np.ones(len(h), bool) if n == 2 else inner[1:-1]
        slots = (h[: len(ok)] ^ (h[: len(ok)] >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((slots >> np.uint32(16))[ok])
        if len(b) <= n:
            break
    all_ = np.concatenate(found).astype(np.int64) & (SLOTS - 1)
    if len(all_) < 4000:  # sorting a short list costs less than clearing all slots
        return np.unique(all_, return_counts=True)
    counts = np.bincount(all_, minlength=SLOTS)
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


class Mixture:
    """Log-likelihood rows of the languages over the slots."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        smooth = counts + SMOOTH
        self.p = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T, np.float32)

    @staticmethod
    def em(p: np.ndarray, c: np.ndarray, pi: np.ndarray, n: float) -> tuple[np.ndarray, float]:
        last = -np.inf
        while True:  # no step lowers the likelihood, and it is bounded
            s = p @ pi
            now = float(c @ np.log(s))
            if not now - last >= TOLERANCE:
                return pi, now
            last = now
            pi = pi * ((c / s) @ p) / n

    def infer(self, slots: np.ndarray, c: np.ndarray) -> list[tuple[str, float]]:
        p, n = self.p[slots].astype(np.float64), float(c.sum())
        price = PENALTY + 0.5 * np.log(n)
        singles = c @ np.log(p)
        own = [int(np.argmax(singles))]
        pi, best = np.ones(1), float(singles[own[0]])
        while len(own) < len(self.langs):
            gain = n * ((c / (p[:, own] @ pi)) @ p / n - 1)
            gain[own] = -np.inf
            order = [int(j) for j in np.argsort(-gain, kind="stable") if gain[j] > price]
            found = None
            for j in order:  # the gradient bounds the gain: once the best found reaches a bound, no later one can be better
                if found is not None and found[1] - best >= gain[j]:
                    break
                start = np.append(pi * 0.9, 0.1)
                now, value = self.em(p[:, [*own, j]], c, start, n)
                if value - best > price and (found is None or value > found[1]):
                    found = (j, value, now)
            if found is None:
                break
            own, best, pi = [*own, found[0]], found[1], found[2] / found[2].sum()
        return sorted(zip((self.langs[k] for k in own), pi.tolist()), key=lambda x: (-x[1], x[0]))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int | None = None) -> Mixture:
    """Count n-grams of the different texts of each language, and sum the counts by slot. rows: only so many texts a language, or somewhat more."""
    spark = labelled.sparkSession
    small_batches(spark)
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    usable = usable.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("data"))
    key = F.xxhash64("lang", "data")
    keys = stored(usable.groupBy("lang", key.alias("key")).agg((F.count(F.lit(1)) > 1).alias("repeated")), "text-keys")
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        warnings.warn(f"more than {LANGUAGES} labels: those with the most texts are learned", stacklevel=2)
        usable = usable.where(F.col("lang").isin([r["lang"] for r in sizes[:LANGUAGES]]))
    known = {r["lang"]: r["n"] for r in sizes[:LANGUAGES]}
    if not known:
        return Mixture([], np.zeros((0, SLOTS)))
    chosen = usable
    if rows is not None:  # a text is in if its hash falls below the share of its language's texts that there is room for
        share = F.create_map(*[F.lit(x) for k, n in known.items() for x in (k, min(1.0, 1.1 * rows / max(n, 1)))])[F.col("lang")]
        chosen = usable.where(F.pmod(F.xxhash64("data"), F.lit(1 << 20)) < share * float(1 << 20))
    if n := (repeated := keys.where("repeated")).count():  # copies count once
        repeats = urlfilter._build(repeated, n, 0, min(FILTER_BITS, MOST_FILTER_BITS / n)).passes(key, 0)
        chosen = chosen.where(~repeats).unionAll(chosen.where(repeats).distinct())
    drop_stored(keys)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, data in zip(batch.column("lang").to_pylist(), batch.column("data").to_pylist()):
                slots, c = grams(data)
                own = totals.setdefault(name, np.zeros(SLOTS, np.int64))
                own[slots] += c
        for name, own in totals.items():
            slots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int64()), pa.array(own[slots], pa.int64())],
                names=["lang", "slot", "n"],
            )

    counted = chosen.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    langs = sorted(known)
    at = {k: i for i, k in enumerate(langs)}
    counts = np.zeros((len(langs), SLOTS))
    got = counted.toPandas()  # at most LANGUAGES * SLOTS rows, and far fewer as letters are few
    np.add.at(counts, (got["lang"].map(at).to_numpy(np.int64), got["slot"].to_numpy(np.int64)), got["n"].to_numpy(float))
    seen = counts.sum(axis=1) > 0
    return Mixture([x for x, s in zip(langs, seen) if s], counts[seen])


def predict(docs: DataFrame, model: Mixture, text: str = "text", name: str = "predicted") -> DataFrame:
    """docs with a struct column (PREDICTED): language, its share, and the set of languages with their shares."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # LANGUAGES x SLOTS doubles at most
    column, data = free_name(docs, name), free_name(docs, "data_of_text")

    def answer(batches):
        mixture = held.value
        for batch in batches:
            rows = []
            for value in batch.column(data).to_pylist():
                none = {"lang": UND, "score": 0.0, "langs": [], "shares": []}
                if value is None or not mixture.langs or not has_letter(value.decode("utf-8", "replace")):
                    rows.append(none)
                    continue
                slots, c = grams(value)
                if not len(slots):
                    rows.append(none)
                    continue
                found = mixture.infer(slots, c)
                score = min(1.0, max(0.0, found[0][1]))
                rows.append({"lang": found[0][0], "score": score, "langs": [x for x, _ in found], "shares": [s for _, s in found]})
            kept = [c for c in batch.schema.names if c != data]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, PREDICTED_ARROW)], names=[*kept, column])

    schema = T.StructType([*docs.schema, T.StructField(column, PREDICTED)])
    return docs.withColumn(data, F.col(text).cast("binary")).mapInArrow(answer, schema)


def fold_of(doc_id: str, folds: int):
    """The contract's split: crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def op4(spark, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = learn(docs.where(~held_out).select("text", "lang"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("predicted.lang").alias("lang_pred"),
        F.col("predicted.score").alias("score"),
        F.col("predicted.langs").alias("langs"),
        F.col("predicted.shares").alias("shares"),
    )
