"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept and is written as Parquet before the next
one reads it.  All stages but the last return the columns of documents.

quality    documents that the quality network scores below 0.3 go
language   documents without a letter, or far from every language's profile (likeness below
           0.3), go; if no row has a language to learn from, only those without a letter
duplicates one document of each group of near copies stays, the one of the smallest id
secrets    secrets are replaced by a mark; n_chars is counted anew; every document stays
packing    documents become pieces placed in sequences of at most 2048 tokens

Null texts, and texts without a word, have no letter and go with the second stage at the latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm import language, packing, quality, secret_scan, shingle_join
from offerscope.llm.queries import GOOD, SEQUENCE, remainder, table, word_vocabulary
from offerscope.llm.shingle_join import unused
from offerscope.session import stage

#: Part of the largest possible distance that a document must fall short of for its nearest language.
LEAST_LIKENESS = 0.3
MARK = "[SECRET]"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    texts, marks = quality.labelled_sample(docs, labels, "quality", "doc_id", "text", lambda key: remainder(key, 5) != 0)
    name = unused(docs, "_quality")
    scored = quality.score(docs, quality.train(texts, marks), keep=docs.columns, name=name)
    return scored.filter(F.col(name) >= GOOD).drop(name)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    profiles = language.learn(docs.filter(remainder("doc_id", 3) != 1))
    names = unused(docs, "_language"), unused(docs, "_likeness")
    if not profiles:  # nothing to be far from
        return language.with_letters(docs)
    judged = language.identify(docs, profiles, keep=docs.columns, names=names)
    kept = (F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= LEAST_LIKENESS)
    return judged.filter(kept).drop(*names)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.one_per_component(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark, spans = unused(docs, "_hash"), unused(docs, "_spans")
    hashed = docs.withColumn(mark, shingle_join.row_hash("doc_id", "text"))
    found = (
        secret_scan.secret_spans(hashed, keep=[mark])
        .withColumnRenamed("spans", spans)
        .filter(F.size(spans) > 0)
        .dropDuplicates([mark])
    )
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(
        secret_scan.redacted(F.col("text"), F.col(spans), MARK)
    )
    return (
        hashed.join(found, mark, "left")
        .withColumn("text", clean)
        .withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text")))
        .select(*docs.columns)
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_vocabulary(), SEQUENCE)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The network and the profiles are learnt, so SQL cannot express the rows; tests/llm compares
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
