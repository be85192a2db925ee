"""Inverted index over entities and types, counts and AND search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.small import among, local
from .lexicon import Lexicon
from .linking import REGEX_MENTIONS, links_table, surfaces


def entity_docs(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, entity, etype).  Distinct per document before the shuffle."""
    if len({m for m, _ in lexicon.pairs}) <= REGEX_MENTIONS:
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(surfaces(F.col(text_col), lexicon))).alias("mention"))
        first = [(m, *c[0]) for m, c in lexicon.candidates().items()]
        names = local(docs.sparkSession, first, "mention string, entity string, etype string")
        return found.join(names, "mention").select("doc_id", "entity", "etype").distinct()
    return links_table(docs, lexicon, id_col, text_col).select("doc_id", "entity", "etype").distinct()


def build_index(docs: DataFrame, lexicon: Lexicon, with_entity: bool = True, with_type: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id); a type is the term ``#type#``."""
    if not lexicon.pairs:
        raise ValueError("add entities to the lexicon before building an index")
    found = entity_docs(docs, lexicon, id_col, text_col)
    terms = F.array(*([F.col("entity")] if with_entity else []), *([F.concat(F.lit("#"), F.col("etype"), F.lit("#"))] if with_type else []))
    return found.select(F.explode(terms).alias("term"), "doc_id").distinct()


def postings(index: DataFrame) -> DataFrame:
    """term -> sorted array of doc_id."""
    return index.groupBy("term").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def entity_counts(index: DataFrame, lexicon: Lexicon, used_types: list[str] = ()) -> DataFrame:
    """Documents an entity; entities without any are left out."""
    own = [e for e, t in sorted(lexicon.types.items()) if not used_types or t in used_types]
    return among(index, F.col("term"), own, True).groupBy(F.col("term").alias("entity")).agg(F.countDistinct("doc_id").alias("n"))


def search_ids(index: DataFrame, query: str | list[str]) -> DataFrame:
    """doc_id of documents that have every term of a blank-separated query (or list)."""
    terms = sorted(set(query.split() if isinstance(query, str) else query))
    if not terms:
        return index.select("doc_id").limit(0)
    return index.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(terms)).select("doc_id")


def search(docs: DataFrame, index: DataFrame, query: str | list[str], id_col: str = "doc_id") -> DataFrame:
    ids = search_ids(index, query).withColumnRenamed("doc_id", "__hit")
    return docs.join(ids, F.col(id_col) == F.col("__hit"), "left_semi").orderBy(id_col)


def entity_sentiment(index: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean document score of each term; ``scores`` (doc_id, score)."""
    return index.join(scores, "doc_id").groupBy("term").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
