"""Registered queries of the ten operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, common, cotraining, language_id, line_dedup, matroska, minhash, mixing, passage_dedup, quality_rules, token_arrow

#: Target weights of the mix; sources that aren't listed weigh 1.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
BUDGET_SHARE = 0.75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return cotraining.score(documents, cotraining.fit(documents, table(spark, sf_dir, "labels")))


def op3_token_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_arrow.write(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language_id.detect(documents, language_id.fit(documents))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.packets(matroska.media_of(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.queue(table(spark, sf_dir, "documents"), WEIGHTS, BUDGET_SHARE)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return line_dedup.clean(documents, line_dedup.build(documents), report=True)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_token_arrow, op4_minhash, op5_language_id, op6_matroska, op7_mixing, op8_byte_bpe, op9_line_dedup, op10_passage_dedup, op10_spans)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.sql(), "op7_mixing": mixing.sql(WEIGHTS, BUDGET_SHARE), "op9_line_dedup": line_dedup.sql(), "op10_spans": passage_dedup.sql()}
