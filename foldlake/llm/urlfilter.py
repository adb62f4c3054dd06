"""URL rules through a cascade of Bloom filters: exact membership over the corpus's own keys.

A rule is a key `host/path-prefix` with a verdict. The keys that a url could meet are its host and the parent domains of it, each with
the prefixes of its path that are as long as some rule's. The universe of the corpus is the set of those keys over all urls. The
cascade's first level holds the listed keys; each further level holds the keys that the level before it answers wrongly: listed ones
and unlisted ones by turns, until none is left. A key of the universe is then listed if and only if the number of levels that it
passes, before the first that it fails, is odd. No join decides membership.

Each verdict has a cascade of its own: which of them holds a key is the key's verdict. Rules never reach a plan but as bits.

Sizes. A level has BITS bits a key. The first holds the list; the second the unlisted keys of the universe that pass the first, which
the first level's rate keeps near the length of the list (its bits follow log2 of universe over list). So the cascade is bounded by
the list: at most (BITS + log2(universe / list) / ln 2) * 2 bits for each listed key and MIN_BITS a level. It is sent along with the
query as an array literal. A list that needs more than MAX_BITS is split by a hash of its keys into parts with cascades of their own;
then each part takes one pass over the keys of the urls, and the keys it finds meet their urls by a join.

The main path is DataFrame functions only.

Defined results: a null url, or one without `://`, has an empty host and path, meets no rule and gets the default verdict. Of the rules
that fit, the one with the longest key wins, of keys as long the one that sorts first, and of equal keys `block`. Repeated pages are each
judged, ids aren't read, urls of any length are; an empty rule list or table is allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.llm.common import free_name, stored

BITS, HASHES = 10, 4
ALONE_BITS = 16  # of a level that no other corrects
MIN_BITS, MAX_BITS = 1 << 10, 1 << 26
MOST_LEVELS = 64


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str  # begins with a slash
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    UrlRule("com", "/en/", "block"),
    UrlRule("example.com", "/en/7", "allow"),
    UrlRule("net", "/de/", "allow"),
    UrlRule("example.net", "/de/8", "block"),
    UrlRule("org", "/es/", "block"),
)


def split_url(url: str = "url") -> tuple[Column, Column]:
    """(host, path): the host up to / ? # or the end, A-Z in lower case; the path up to ? # or the end."""
    u = F.coalesce(F.col(url), F.lit(""))
    after = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise("")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys that a url could meet: each suffix of its host at a dot, with each prefix of its path that has a rule's length."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]  # of 64 bits

    def passes(self, key: Column, level: int) -> Column:
        """Whether all bits of the key are set."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # Spark folds it to one literal
        bit = lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        return F.forall(F.array(*places(key, level, self.bits, self.hashes)), bit)


def places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """The bits of a key in a level."""
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits).cast("bigint")) for i in range(hashes)]


def _build(keys: DataFrame, n: int, level: int, bits_a_key: float) -> Level:
    bits = max(MIN_BITS, 64 * math.ceil(n * bits_a_key / 64))
    hashes = max(1, min(16, round(bits_a_key * math.log(2))))
    bit = keys.select(F.explode(F.array(*places(F.col("key"), level, bits, hashes))).alias("place")).distinct()
    word = bit.groupBy(F.shiftright("place", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("v")
    )
    words = [0] * (bits // 64)
    for r in word.collect():  # at most MAX_BITS / 64 words
        words[r["w"]] = r["v"]
    return Level(bits, hashes, tuple(words))


def level_for(keys: DataFrame) -> Level:
    """A level (of number 0) that all the keys (column `key`, distinct) pass. It has MAX_BITS at most: of longer lists, more other keys pass too."""
    n = keys.count()
    return _build(keys, n, 0, min(ALONE_BITS, MAX_BITS / max(1, n)))


def _bits_a_key(n: int, universe: int) -> float:
    """Of the first level; later ones have BITS."""
    return BITS + max(0.0, math.log2(max(1, universe) / n)) / math.log(2)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the keys (column `key`, distinct) of listed, exact on all keys of universe and listed."""
    inside = stored(listed.select("key").distinct(), "listed-keys")
    n = inside.count()
    if not n:
        return []
    outside = universe.select("key").distinct().join(inside, "key", "left_anti")
    outside = stored(outside, "unlisted-keys")
    levels, rate = [], _bits_a_key(n, outside.count())
    mine, others = inside, outside
    while n:
        if len(levels) == MOST_LEVELS:
            raise ValueError("the cascade does not end; are keys of the list and of the universe equal?")
        level = _build(mine, n, len(levels), rate)
        wrong = stored(others.where(level.passes(F.col("key"), len(levels))), "wrongly-passed")
        levels.append(level)
        mine, others, n, rate = wrong, mine, wrong.count(), BITS
    return levels


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)).cast("int")


def partitioned(listed: DataFrame, universe: DataFrame) -> list[list[Level]]:
    """The cascades of the parts of a list, one if it fits into MAX_BITS."""
    n = listed.select("key").distinct().count()
    if not n:
        return []
    parts = math.ceil(n * _bits_a_key(n, universe.select("key").distinct().count()) / MAX_BITS)
    if parts == 1:
        return [cascade(listed, universe)]
    universe = stored(universe.select("key").distinct(), "keys-of-urls")
    own = lambda df, k: df.where(part_of(F.col("key"), parts) == k)
    return [cascade(own(listed, k), own(universe, k)) for k in range(parts)]


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the levels passed before the first failure are odd in number."""
    if not levels:
        return F.lit(False)
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(levels[k].passes(key, k), out).otherwise(F.lit(k % 2 == 1))
    return out


VERDICTS = ("block", "allow")


def _rules(spark: SparkSession, rules) -> DataFrame:
    """(key, verdict, length of the path) of rules given as UrlRules or as a table (host, path, verdict)."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    return rules.select(F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("length"))


def _best(found: Column) -> Column:
    """The longest of keys with verdicts; of those as long the first, and `block` before `allow`."""
    before = lambda a, b: (
        F.when(F.length(a["rule"]) != F.length(b["rule"]), F.length(b["rule"]) - F.length(a["rule"]))
        .when(a["rule"] != b["rule"], F.when(a["rule"] < b["rule"], -1).otherwise(1))
        .when(a["verdict"] == b["verdict"], 0).otherwise(F.when(a["verdict"] == "block", -1).otherwise(1))
    )
    return F.get(F.array_sort(found, before), F.lit(0))


def _hits(keys: Column, levels: list[Level], verdict: str) -> Column:
    """The keys that a cascade holds, with its verdict."""
    found = F.filter(keys, lambda k: is_listed(k, levels))
    return F.transform(found, lambda k: F.struct(k.alias("rule"), F.lit(verdict).alias("verdict")))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with the struct column `judged`: host, path, rule, verdict."""
    host, path = split_url(url)
    column = free_name(pages, "judged")
    at = pages.withColumn(column, F.struct(host.alias("host"), path.alias("path")))
    own = [F.col(f"{column}.host").alias("host"), F.col(f"{column}.path").alias("path")]
    rules = _rules(pages.sparkSession, rules)
    lengths = sorted(r[0] for r in rules.select("length").distinct().collect())  # of paths
    if not lengths:
        return at.withColumn(column, F.struct(*own, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
    keys = keys_of(F.col(f"{column}.host"), F.col(f"{column}.path"), lengths)
    every = at.select(F.explode(keys).alias("key"))
    # a cascade is exact on the keys of urls and of its own list; other rules' keys count only where a url has them
    cascades = {v: partitioned(rules.where(F.col("verdict") == v), every) for v in VERDICTS}
    if all(len(c) <= 1 for c in cascades.values()):
        hits = [_hits(keys, c[0], v) for v, c in cascades.items() if c]
        best = _best(F.concat(*hits))
        return at.withColumn(column, F.struct(*own, best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")))
    by_url = at.select(F.col(column).alias("of")).distinct().withColumn("key", F.explode(keys_of(F.col("of.host"), F.col("of.path"), lengths)))
    found = None
    for v, parts in cascades.items():
        for k, levels in enumerate(parts):
            mine = by_url.where((part_of(F.col("key"), len(parts)) == k) & is_listed(F.col("key"), levels)).select("of", F.col("key").alias("rule"), F.lit(v).alias("verdict"))
            found = mine if found is None else found.unionByName(mine)
    hits = stored(found.groupBy("of").agg(F.collect_list(F.struct("rule", "verdict")).alias("hits")), "rules-of-urls")  # as many as a url has keys
    hits = hits.select("of", _best(F.col("hits")).alias("best"))
    out = at.join(hits, F.col(column) == F.col("of"), "left")
    judged = F.struct(*own, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return out.select(*[at[c] for c in pages.columns], judged.alias(column))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.*")


_RULES_SQL = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
ORACLE = f"""
WITH rules(h, p, v) AS (VALUES {_RULES_SQL}),
a AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
m AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS rn
  FROM u JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND rn = 1
"""
