"""Corpus pipeline: language ID, line dedup, near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``.

Defined results of every stage: columns are taken by exact name and returned in
place, whatever others are called; very long texts are handled whole; an empty
table stays empty.  Null, empty and blank texts go in the first stage, which
knows no language for them; a null id is no error, such rows are never copies of
one another and are never the owner of a line.  Rows that share an id stay or go
together in the near-duplicate and the mixing stage, ties there go to the
smaller id.  Repeated rows keep their lines and are tokenised each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, common, language_id, line_dedup, minhash, mixing
from textloom.llm.queries import BUDGET_SHARE, WEIGHTS

#: MinHash and the hash cuts have no equivalent in DuckDB SQL; tests compare with a brute-force version.
ORACLE_SQL = None
#: Documents from which the line stage takes a line for boilerplate.
FREQUENT = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language."""
    return language_id.keep_known(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes frequent lines out of all but their first document and repeats out of each document; documents left blank go.

    Only lines of at least ``FREQUENT`` documents count: without all of the lines
    that two documents share, near copies would no longer be alike in the next stage.
    """
    return filled(line_dedup.clean(docs, line_dedup.build(docs, min_docs=FREQUENT), min_docs=FREQUENT))


def filled(docs: DataFrame) -> DataFrame:
    """Documents with text left, ``n_chars`` as it is now."""
    plain, name = common.numbered(docs)
    left = plain.where(F.col(name("text")).rlike(r"[^ \t\r\n]"))
    return left.withColumn(name("n_chars"), F.length(name("text")).cast("long")).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, then takes out what long lines these still repeat.

    Copies go first: without the lines that they share they would no longer be alike.
    """
    left = common.settle(common.numbered(minhash.keep_one(docs))[0], "near-kept").toDF(*docs.columns)
    return filled(line_dedup.clean(left, line_dedup.build(left), min_docs=FREQUENT, long_words=line_dedup.LONG_WORDS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that weighted fair queueing puts within the budget."""
    return mixing.select(docs, WEIGHTS, BUDGET_SHARE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return byte_bpe.encode(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near), ("source_mixing", mix), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
