"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of (source, language, topic). The cells' token weights are scaled to the target share of each source, then
of each language, then of each topic, and again, until all marginals agree. Documents are then drawn by calibrated probabilities: a
cell's probability is its share of the token budget over its tokens, at most 1; what capped cells can't give is spread over the
others. A drawn document's weight (calibrated share over probability) lets weighted sums keep to the targets where cells are capped.

Topics are learned: texts are described by what share of them each of CLASSES of characters makes up and by their length, and the
profiles of all texts are clustered by k-means, which starts from profiles far apart and takes TOPIC_STEPS steps at most; every document
gets the nearest centre. Profiles are whole numbers, so that centres are the same at every run.

All of it is DataFrame functions. Profiles and tokens are taken once, into a narrow table; after the topics only the table of cells, which
has a row for each combination that occurs, is aggregated and joined. Hot sources cost nothing special: sums are taken where rows lie, and
cells are joined by a key that they have once.

Defined results: null source, language or topic is the value '' of its own; null texts have no tokens and are drawn with their
cell's probability; values without a target get none of the budget; targets of values that don't occur are left out and the rest
rescaled; an empty table gives an empty result. Rows that repeat an id are drawn together if they lie in cells of one probability. Targets
that no shares can meet (their values never occur together) leave marginals off; a warning says by how much after the plan's last round,
and shares are those of that round. Topics tie to the centre that comes first.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import drop_stored, free_name, stored

TOKEN = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
#: Up to this many cells, one partition holds them and their sums need no shuffle.
FEW_CELLS = 50_000
#: Rounds of raking between two looks at the marginals.
STRIDE = 4


#: Classes of characters whose shares describe a text.
CLASSES = (r"[0-9]", r"[A-Z]", r"[!-/:-@\[-`{-~]", r"\n", r" ")
TOPICS, TOPIC_STEPS = 6, 12


def profile(text: str = "text") -> list[Column]:
    """Whole numbers that describe a text: thousandths that each class makes up of it, and a hundred times the binary logarithm of its length."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    shares = [F.floor(F.regexp_count(t, F.lit(c)) * 1000 / n).cast("bigint") for c in CLASSES]
    return [*shares, F.floor(F.log2(n.cast("double")) * 100).cast("bigint")]


@dataclass(frozen=True)
class Topics:
    """Centres of profiles, and what a number's differences are divided by."""

    centres: tuple[tuple[float, ...], ...]
    scale: tuple[float, ...]

    def far(self, numbers: list[Column]) -> list[Column]:
        """Squared distances to the centres."""
        out = []
        for centre in self.centres:
            parts = [((x - F.lit(c)) / F.lit(s)) ** 2 for x, c, s in zip(numbers, centre, self.scale)]
            out.append(reduce(Column.__add__, parts))
        return out

    def nearest(self, numbers: list[Column]) -> Column:
        far = F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(self.far(numbers))])
        return F.array_min(far)["k"]

    def named(self, numbers: list[Column]) -> Column:
        return F.concat(F.lit("topic-"), self.nearest(numbers).cast("string")) if self.centres else F.lit("")

    def of(self, text: str = "text") -> Column:
        return self.named(profile(text))


NUMBERS = [f"x{i}" for i in range(len(CLASSES) + 1)]


def described(docs: DataFrame, text: str = "text", more: Sequence[Column] = ()) -> DataFrame:
    """A narrow stored table with a row a document: whether it has a text (`known`), its profile (NUMBERS), and more columns."""
    numbers = [c.alias(x) for c, x in zip(profile(text), NUMBERS)]
    return stored(docs.select(F.col(text).isNotNull().alias("known"), *numbers, *more), "profiles")


def learn_topics(rows: DataFrame, k: int = TOPICS) -> Topics:
    """k centres, or fewer if there are fewer different profiles, of all known rows of described()."""
    names, numbers = NUMBERS, [F.col(x) for x in NUMBERS]
    seen = rows.where("known")
    facts = seen.agg(F.count(F.lit(1)), *[F.sum(x) for x in names], *[F.sum(F.col(x) * F.col(x)) for x in names]).first()
    if not facts[0]:
        return Topics((), ())
    d, total = len(names), float(facts[0])
    means = [facts[1 + i] / total for i in range(d)]
    scale = tuple(max(1.0, facts[1 + d + i] / total - means[i] ** 2) ** 0.5 for i in range(d))
    topics = Topics((tuple(means),), scale)
    centres: list[tuple[float, ...]] = []
    for _ in range(k):  # the profile farthest from the mean, then those farthest from the ones chosen
        away = F.least(*far) if len(far := topics.far(numbers)) > 1 else far[0]
        far_off = seen.select(*names, away.alias("away")).orderBy(F.desc("away"), *names).first()
        if centres and far_off["away"] == 0:
            break
        centres.append(tuple(float(far_off[x]) for x in names))
        topics = Topics(tuple(centres), scale)
    for _ in range(TOPIC_STEPS):
        rows = seen.groupBy(topics.nearest(numbers).alias("k")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in names]).collect()  # k rows
        new = list(topics.centres)
        for r in rows:
            new[r["k"]] = tuple(r[x] / float(r["n"]) for x in names)
        if tuple(new) == topics.centres:
            break
        topics = Topics(tuple(new), scale)
    return topics


@dataclass(frozen=True)
class Plan:
    """What to mix to. targets: shares by dimension and value; a dimension without targets is tempered: shares ** temper."""

    budget: float = 0.5  # share of all tokens to draw
    temper: float = 0.5
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 100
    within: float = 1e-6
    seed: int = 1


def with_cells(docs: DataFrame, topic: Column) -> DataFrame:
    """docs with the struct column `cell`."""
    name = free_name(docs, "cell")
    parts = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    return docs.withColumn(name, F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in parts.items()]))


def _targets(cells: DataFrame, plan: Plan, k: str) -> DataFrame:
    """(value, target) of one dimension over the values that occur, summing to 1."""
    own = cells.groupBy(k).agg(F.sum("tokens").alias("tokens"))
    if k in plan.targets and plan.targets[k]:
        rows = [(str(v), float(w)) for v, w in plan.targets[k].items()]
        given = cells.sparkSession.createDataFrame(rows, f"{k} string, target double")
        own = own.join(F.broadcast(given), k, "left").select(k, F.coalesce("target", F.lit(0.0)).alias("target"))  # rows of the call
    else:
        own = own.select(k, F.pow(F.col("tokens").cast("double"), plan.temper).alias("target"))
    total = own.agg(F.sum("target")).first()[0] or 1.0
    return own.withColumn("target", F.col("target") / total)


def rake(cells: DataFrame, plan: Plan) -> DataFrame:
    """cells (source, lang, topic, tokens) with `share`, whose marginals agree with the targets; shares sum to 1."""
    few = cells.count() <= FEW_CELLS
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("share", F.col("tokens") / F.lit(float(total)))
    targets = {k: stored(_targets(cells, plan, k), f"target-{k}") for k in DIMENSIONS}
    for k in DIMENSIONS:
        now = now.join(targets[k].withColumnRenamed("target", f"to_{k}"), k)

    def scaled(df: DataFrame, k: str) -> DataFrame:
        if few:  # in one partition, a window needs no shuffle
            return df.withColumn("sum", F.sum("share").over(Window.partitionBy(k)))
        df = stored(df, "raking")  # a table of its own, as the join reads it twice
        passing.append(df)
        return df.join(df.groupBy(k).agg(F.sum("share").alias("sum")), k)

    held, passing, off = None, [], []
    for _ in range(0, plan.rounds, STRIDE):
        now = now.coalesce(1) if few else now
        for k in DIMENSIONS * STRIDE:
            ratio = F.when(F.col("sum") > 0, F.col(f"to_{k}") / F.col("sum")).otherwise(0.0)
            now = scaled(now, k).withColumn("share", F.col("share") * ratio).drop("sum")
        kept = stored(now, "raked")
        for df in [*passing, *([held] if held is not None else [])]:
            drop_stored(df)
        passing.clear()
        held = now = kept
        # the last dimension agrees by construction; look at the others
        off = [
            now.groupBy(k).agg(F.abs(F.sum("share") - F.first(f"to_{k}")).alias("off")).agg(F.max("off")).first()[0] or 0.0
            for k in DIMENSIONS[:-1]
        ]
        if max(off) <= plan.within:
            break
    else:
        warnings.warn(f"raking: marginals are off by {max(off, default=0.0):.3g} after {plan.rounds} rounds (wanted {plan.within:.3g})", stacklevel=2)
    return now.drop(*[f"to_{k}" for k in DIMENSIONS])


def calibrate(raked: DataFrame, plan: Plan) -> DataFrame:
    """raked with `prob`: min(1, level * share / tokens), the level such that the expected tokens are the budget."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    wanted = plan.budget * total
    level, capped = wanted, None
    for _ in range(100):
        full = F.col("share") * F.lit(float(level)) >= F.col("tokens")
        got = raked.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("share"))), F.sum(F.when(full, 1).otherwise(0))
        ).first()
        if got[2] == capped or not got[1]:
            break
        capped, level = got[2], max(0.0, (wanted - got[0]) / got[1])
    prob = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("share") * F.lit(float(level)) / F.col("tokens")))
    return raked.withColumn("prob", F.coalesce(prob, F.lit(0.0)))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and seed alone: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, plan: Plan = Plan(), topic: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with struct column `mix`: cell, share of the cell, tokens, probability, weight, and whether the document is drawn."""
    tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN)).cast("bigint").alias("n")
    if topic is None:  # texts are read once for topics and cells, once for the result
        rows = described(docs, text, [F.col("source"), F.col("lang"), tokens])
        topics = learn_topics(rows)
        at, counted = with_cells(docs, topics.of(text)), with_cells(rows, topics.named([F.col(x) for x in NUMBERS]))
    else:
        at = counted = with_cells(docs, topic)
    cell, n = at.columns[-1], tokens if topic is not None else F.col("n")
    cells = stored(counted.select(f"`{counted.columns[-1]}`.*", n).groupBy(*DIMENSIONS).agg(F.sum("n").alias("tokens")), "cells")
    drawn = stored(calibrate(rake(cells, plan), plan), "calibrated")
    drawn = drawn.select(F.struct(*DIMENSIONS).alias("of_cell"), F.struct("tokens", "share", "prob").alias("of"))
    out = at.join(drawn, at[cell] == drawn["of_cell"])
    of = drawn["of"]
    mix = F.struct(
        at[cell]["topic"].alias("topic"),
        of["share"].alias("share"),
        of["tokens"].alias("cell_tokens"),
        of["prob"].alias("prob"),
        F.when(of["prob"] > 0, of["share"] / of["prob"]).alias("weight"),
        (uniform(at[key], plan.seed) < of["prob"]).alias("drawn"),
    )
    return out.select(*[at[c] for c in docs.columns], mix.alias(free_name(docs, "mix")))


def draw(docs: DataFrame, plan: Plan = Plan(), **how) -> DataFrame:
    """The drawn documents, with `mix`."""
    out = mixed(docs, plan, **how)
    return out.where(F.col(out.columns[-1])["drawn"])


def op10(spark, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "source", "lang", "mix.topic", "mix.share", "mix.cell_tokens", "mix.prob", "mix.weight", "mix.drawn")
