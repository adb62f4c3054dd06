"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger is a table of (blob, rule version) with the findings
of each pair that has been scanned. A scan takes the blobs of the documents, leaves out the pairs that the ledger holds, reads the
text of one document for each pair that is left, and adds the findings to the ledger; then findings are joined back to every path
(document) that has the blob. A text that thousands of documents share is scanned once, and a second run scans only what is new.

The main path is DataFrame functions only. Positions come from splitting a text at the matches of a rule: the lengths of the pieces
and of the matches, summed up, are the spans, in code points. Texts in which a rule's cheap test finds nothing are not split.

Defined results: null texts are empty and have no findings; documents that repeat are each reported; rows with a null id keep their
findings; an empty table gives an empty result and leaves the ledger alone. Very long texts are one blob each.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import bytes_of, free_name, stored


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    test: str  # finds something in every text in which pattern does
    group: int = 0  # the group whose length counts
    least: int = 0  # characters that it must have


#: The contract's kinds, in the order of its list. For access and hex the least length stands in the pattern: their matches are
#: whole runs of a class, so that what is too short can't hold another match.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"(?i:passw|secret|token|api_?key)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
#: Kinds that the ledger adds: private key blocks, and tokens with a prefix of their own.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("prefixed", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})", r"gh[pousr]_|xox[abprs]-|sk-"),
)
RULES = BASE + MORE


def version_of(rules: tuple[Rule, ...]) -> str:
    """Names a set of rules: any change to a rule changes it, and with it which pairs are unseen."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


LENGTHS = "array<struct<piece:int,whole:int,counted:int>>"
CHUNK = 256  # matches that are folded together: a fold copies what it has at every step


def lengths_of(rule: Rule, text: str = "text") -> Column:
    """For each match of a rule: the length of the text since the match before, of the match, and of the group that counts."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(F.col(text), rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("piece"), whole.alias("whole"), counted.alias("counted"))
    zipped = F.transform(zipped, lambda x: F.struct(x["piece"].alias("piece"), x["whole"].alias("whole"), x["counted"].alias("counted")))
    return F.when(F.col(text).rlike(rule.test), zipped).otherwise(F.array().cast(LENGTHS))


def spans_from(lengths: Column, rule: Rule, no: int) -> Column:
    """The spans (SPANS) of a rule's matches: running sums of lengths_of(), in chunks that begin where the chunks before end."""
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(lengths, i, F.lit(CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["piece"] + x["whole"]))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda a, t: F.struct((a["at"] + t).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    begins = F.aggregate(totals, none, add)["out"]

    def step(acc, x):
        begin = acc["at"] + x["piece"]
        end = begin + x["whole"]
        span = F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        out = F.when(x["counted"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    own = lambda c, b: F.aggregate(c, F.struct(b.alias("at"), F.array().cast(SPANS).alias("out")), step)["out"]
    return F.flatten(F.zip_with(chunks, begins, own))


def scan(texts: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """texts with a column `spans`: all spans by start, then by the order of the rules."""
    names = [free_name(texts, f"lengths_{k}") for k in range(len(rules))]
    at = texts.withColumns({name: lengths_of(r, text) for name, r in zip(names, rules)})  # columns of their own: patterns run once
    every = F.concat(*[spans_from(F.col(name), r, k) for k, (name, r) in enumerate(zip(names, rules))])
    return at.withColumn("spans", F.array_sort(every)).drop(*names)


def joined(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def ledger_schema() -> str:
    return f"blob string, version string, spans {SPANS}"


def scan_with_ledger(docs: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text",
                     rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(docs with `blob` and `spans`, new rows for the ledger); both names get underscores where docs has them already.

    Which document lends its text to an unseen blob is the one with the least id. Blobs without findings are in the ledger too, so
    that they count as seen.
    """
    version = version_of(rules)
    blob, spans = free_name(docs, "blob"), free_name(docs, "spans")
    named = docs.withColumn(blob, F.sha2(bytes_of(text), 256))
    blobs = named.groupBy(F.col(blob).alias("blob")).agg(F.min(key).alias("lender"))
    if ledger is not None:
        seen = ledger.where(F.col("version") == version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    unseen = blobs.where("lender is not null").withColumnRenamed("blob", "lent")
    texts = named.select(F.col(key).alias("lender"), F.col(blob).alias("lent"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the pair of id and blob: an id may stand for several texts
    once = texts.join(unseen, ["lender", "lent"], "left_semi")
    nameless = texts.where("lender is null").join(blobs.where("lender is null").select(F.col("blob").alias("lent")), "lent", "left_semi")
    found = scan(once.unionByName(nameless), rules).select(F.col("lent").alias("blob"), F.lit(version).alias("version"), "spans")
    new = stored(found, "secret-findings")
    known = new if ledger is None else new.unionByName(ledger.where(F.col("version") == version))
    # only blobs with findings are joined back; a row repeated in the ledger must not repeat the path
    # (stored, so that Spark knows its size when it chooses between broadcasting it and shuffling the texts)
    hits = known.where(F.size("spans") > 0).groupBy(F.col("blob").alias("found_in")).agg(F.first("spans").alias("own_spans"))
    hits = stored(hits, "secret-hits")
    out = named.join(hits, F.col(blob) == hits["found_in"], "left")
    return out.select(*named.columns, F.coalesce(hits["own_spans"], F.array().cast(SPANS)).alias(spans)), new


def without_secrets(docs: DataFrame, **how) -> DataFrame:
    """The documents in which no rule finds anything, with their own columns."""
    kept, _ = scan_with_ledger(docs, **how)
    return kept.where(F.size(kept.columns[-1]) == 0).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    from foldlake.llm.common import table

    found, _ = scan_with_ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _sql_spans(rule: Rule, no: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{rule.kind}' AS kind, {no} AS kind_no, b AS start_at, b + length(w) AS end_at FROM (
      SELECT doc_id, unnest(whole) AS w, unnest(counted) AS c,
        unnest([list_sum([length(x) for x in pieces[1:i]]) + coalesce(list_sum([length(x) for x in whole[1:i - 1]]), 0)
                for i in range(1, len(whole) + 1)]) AS b
      FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS pieces,
              regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {rule.group}) AS counted FROM d))
    WHERE length(c) >= {rule.least}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(end_at AS BIGINT), ',' ORDER BY start_at, kind_no)
    FILTER (kind_no < {len(BASE)}) AS base,
  string_agg(kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(end_at AS BIGINT), ',' ORDER BY start_at, kind_no) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
