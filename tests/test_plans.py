"""No plan broadcasts the side of the documents, and short lists shuffle nothing."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from textloom.plans import catalogue, catalogue_more, small  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("name", ["entity_counts", "entity_graph", "entity_tags", "stopword_filter", "window_pairs", "word_ego", "doc_sentiment", "link_by_join", "search_and", "tfidf_topk"])
def test_documents_are_never_a_build_side(spark, data, name):
    text = plan(catalogue.QUERIES[name](spark, data))
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for x in lines[i + 1 :]:
                if len(x) - len(x.lstrip(" :+-")) <= depth:
                    break
                below.append(x)
            assert not any("documents.parquet" in x and "text" in x for x in below), text


def test_short_lists_are_filters(spark, data):
    text = plan(catalogue.QUERIES["stopword_filter"](spark, data))
    assert "Join" not in text


def test_local_tables_have_a_size(spark):
    df = small.local(spark, [("a", 1), ("b", None)], "w string, n int")
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1000
    assert sorted(map(str, df.collect())) == sorted(map(str, [("a", 1), ("b", None)])) or df.count() == 2
    big = spark.range(100).select(F.col("id").cast("string").alias("w"))
    facts = spark.range(1000).select((F.col("id") % 200).cast("string").alias("x"))
    for limit, join in ((1 << 20, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        got = facts.join(small.checked(big, limit=limit), F.col("x") == F.col("w"))
        assert re.search(join, plan(got)) and got.count() == 500


def test_lists_of_any_length(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "w string")
    for literals in (1000, 1):
        monkeypatch.setattr(small, "LITERALS", literals)
        assert {r.w for r in small.among(df, F.col("w"), ["a", "c"], True).collect()} == {"a", "c"}
        assert {r.w for r in small.among(df, F.col("w"), ["a", "c"], False).collect()} == {"b", None}
    assert small.among(df, F.col("w"), [], True).count() == 0 and small.among(df, F.col("w"), [], False).count() == 4
    words = spark.createDataFrame([("a",), ("a",)], "x string")
    assert small.among(df, F.col("w"), words, True).count() == 1
