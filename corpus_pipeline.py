"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, secrets, mixture.

Defined results: a null or empty text has no language and goes in the first stage. Rows with a null id are judged by their text like
others, but are never near-duplicates. Rows that repeat an id and a text are one document: all stay, or none; another text under the
same id is judged by itself. Of documents with equal words the one with the least id stays. Columns beyond those of `documents` pass
through; where they have the names that the last stage adds, its own get underscores before them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.llm import decontaminate, langid, minhash, mixing, secrets, urlfilter
from foldlake.llm.common import free_name, shared_path, stored, table

#: A document stays if its largest language has at least this share of it.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in which no language has LEAST_SHARE, go; lang becomes the language found."""
    model = langid.learn(docs.select("text", "lang"))
    found = langid.predict(docs, model)
    predicted = found.columns[-1]
    kept = found.where((F.col(predicted)["lang"] != langid.UND) & (F.col(predicted)["score"] >= LEAST_SHARE))
    return kept.withColumn("lang", F.col(predicted)["lang"]).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the least id stays."""
    found = minhash.near_duplicates(docs, marks=True)
    # stored, so that Spark knows its size when it chooses between broadcasting it and shuffling texts
    gone = stored(found.where(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct(), "near-duplicates")
    # texts that a Bloom filter of the ids stops can't go, so only the others are joined: a shuffle moves little more than the texts that go
    suspect = urlfilter.level_for(gone.select(F.col("gone_id").alias("key")).distinct()).passes(F.col("doc_id").cast("bigint"), 0)
    left = docs.where(suspect)
    left = left.join(gone, (left["doc_id"] == gone["gone_id"]) & (minhash.mark_of("text") == gone["gone_mark"]), "left_anti")
    return docs.where(~suspect).union(left)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a rule finds a secret go."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose sources, languages and topics have the target weights."""
    drawn = mixing.draw(docs)
    mix = F.col(drawn.columns[-1])
    return drawn.select(*docs.columns, *[mix[k].alias(free_name(docs, k)) for k in ("topic", "prob", "weight")])


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", drop_secrets),
    ("mixing", mix_sources),
]

#: Language identification has no SQL; tests hold the stages against a plain version that shares no code with them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
