"""SO-PMI sentiment dictionaries and document scores.

Only pairs with a seed are counted, which is all that the score reads:
tokens x seeds rows instead of all pairs of a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import settle
from ..plans.small import LITERALS, among, checked, local

SCALES = ("None", "0-1", "+-1")


def build_sent_dict(tokens: DataFrame, pos_seeds: list[str] = (), neg_seeds: list[str] = (), min_times: int = 5, scale: str = "None", stopwords: DataFrame | Iterable[str] | None = None, method: str = "PMI", check_seeds: bool = True) -> DataFrame:
    """(word, score) from tokens (doc_id, word).

    A word co-occurs with itself; words under ``min_times`` documents get no
    score.  Raises where no seed is in the vocabulary (one small job;
    ``check_seeds=False`` skips it and gives scores of 0).
    """
    if method != "PMI":
        raise ValueError(f"unknown method {method!r}")
    if scale not in SCALES:
        raise ValueError(f"scale is one of {SCALES}")
    spark = tokens.sparkSession
    own = tokens.where("word is not null").select("doc_id", "word")
    own = own if stopwords is None else among(own, F.col("word"), stopwords, False)
    # a row a document: one shuffle of its distinct words, and none for pairs with seeds; read three times
    sets = settle(own.groupBy("doc_id").agg(F.collect_set("word").alias("words")), "doc-words")
    total = sets.agg(F.count("doc_id").alias("n_docs"))
    counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c")).where(F.col("c") >= min_times)
    counts = settle(counts, "word-counts")
    signs = {s: 1 for s in pos_seeds or ()}
    signs.update({s: -1 for s in neg_seeds or ()} if not set(signs) & set(neg_seeds or ()) else {s: signs.get(s, 0) - 1 for s in neg_seeds or ()})
    seeds = local(spark, sorted(signs.items()), "seed string, sgn int")
    seeds = checked(counts.join(seeds, F.col("word") == F.col("seed")).select("seed", "sgn", F.col("c").alias("cs")), "seeds")
    if check_seeds and seeds.limit(1).count() == 0:
        raise ValueError("no seed word is in the vocabulary")
    named = sets.where("doc_id is not null")
    if len(signs) <= LITERALS:
        hits = named.select("words", F.explode(F.array_intersect("words", F.array(*map(F.lit, signs)).cast("array<string>"))).alias("seed"))
    else:
        hits = among(named.select("words", F.explode("words").alias("seed")), F.col("seed"), list(signs), True)
    hits = hits.select("seed", F.explode("words").alias("word"))
    pairs = hits.groupBy("word", "seed").agg(F.count("*").alias("co")).join(seeds, "seed")
    pmi = pairs.join(counts, "word").crossJoin(F.broadcast(total)).select("word", (F.col("sgn") * F.log2(F.col("co") * F.col("n_docs") / (F.col("c") * F.col("cs")))).alias("x"))  # one row is broadcast
    summed = pmi.groupBy("word").agg(F.sum("x").alias("x"))
    raw = counts.select("word").join(summed, "word", "left").select("word", F.coalesce("x", F.lit(0.0)).alias("score"))
    if scale == "None":
        return raw
    bounds = raw.agg(F.greatest(F.max("score"), F.lit(0.0)).alias("hi"), F.least(F.min("score"), F.lit(0.0)).alias("lo"))
    raw = raw.crossJoin(F.broadcast(bounds))  # one row
    if scale == "+-1":
        x = F.when(F.col("score") > 0, F.col("score") / F.col("hi")).when(F.col("score") < 0, F.col("score") / -F.col("lo")).otherwise(0.0)
    else:
        x = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return raw.select("word", x.alias("score"))


def analyse(tokens: DataFrame, sent_dict: DataFrame, docs: DataFrame | None = None, avg: bool = True) -> DataFrame:
    """(doc_id, score): mean over a document's distinct known words, 0 without any;
    ``avg=False`` gives (doc_id, scores).  ``docs`` adds documents without tokens."""
    known = tokens.select("doc_id", "word").distinct().join(checked(sent_dict, "sent-dict"), "word").groupBy("doc_id")
    got = known.agg(F.avg("score").alias("score")) if avg else known.agg(F.array_sort(F.collect_list("score")).alias("scores"))
    every = (docs if docs is not None else tokens).select("doc_id").distinct().join(got, "doc_id", "left")
    return every.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score") if avg else F.coalesce("scores", F.array().cast("array<double>")).alias("scores"))


@dataclass(frozen=True)
class SentimentModel:
    """Seeds and options over a token table; ``with_*`` gives another model, scores are made when asked for."""

    tokens: DataFrame
    pos_seeds: tuple[str, ...] = ()
    neg_seeds: tuple[str, ...] = ()
    options: Mapping[str, object] = field(default_factory=dict)

    def with_pos_seeds(self, seeds: Iterable[str]) -> SentimentModel:
        return replace(self, pos_seeds=tuple(seeds))

    def with_neg_seeds(self, seeds: Iterable[str]) -> SentimentModel:
        return replace(self, neg_seeds=tuple(seeds))

    def scores(self) -> DataFrame:
        return build_sent_dict(self.tokens, self.pos_seeds, self.neg_seeds, **self.options)

    def scores_of(self, words: Iterable[str]) -> DataFrame:
        """(word, score) of some words; unknown ones are left out."""
        return among(self.scores(), F.col("word"), words, True)
