"""New-word discovery from character n-grams: frequency, cohesion and neighbour entropy.

Two narrow passes over the text count in numpy, block by block: one all n-grams,
one the neighbours of those that pass the frequency and cohesion thresholds.
Only (n-gram, count) rows, already combined, are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.cut import settle
from ..plans.small import among, checked

#: Runs of separators become one blank: white space, ASCII letters, punctuation (digits and others stay).
SEPARATORS = r"(?U)[\sA-Za-z" + "".join(f"\\x{{{c:x}}}" for c in sorted({*map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^_{|}~"), 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x2500, 0x2504, 0x3001, 0x3002, 0x300A, 0x300B, 0x3010, 0x3011, 0xFF01, 0xFF08, 0xFF09, 0xFF0C, 0xFF0D, 0xFF1A, 0xFF1B, 0xFF1F, 0xFF5B, 0xFF5D, 0xFFE5} - {0x2014, 0x2500} | {0x2014, 0x2500})) + "]+"


def normalised(docs: DataFrame, separators: str = SEPARATORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t): pieces whose concatenation in id order is the normalised text of all documents joined by line feeds."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = d.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    d = d.crossJoin(F.broadcast(ends))  # one row
    t = F.regexp_replace(F.concat("text", F.when(F.col("doc_id") < F.col("hi"), F.lit("\n")).otherwise(F.lit(""))), F.lit(separators), F.lit(" "))
    return d.select("doc_id", (F.col("doc_id") == F.col("lo")).alias("is_first"), (F.col("doc_id") == F.col("hi")).alias("is_last"), F.when(F.col("doc_id") == F.col("lo"), t).otherwise(F.regexp_replace(t, "^ ", "")).alias("t"))


#: Characters that one task counts at a time; a longer text is cut with the neighbours that its n-grams need.
CHUNK_CHARS = 1 << 21
#: Most candidate words that are looked up by broadcast hashes (8 bytes each); more meet the counted neighbours by a join.
PROBES = 4_000_000
_BLANK = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """Code points of many pieces, a blank on both sides of each; ``edge`` marks the blank outside of the corpus."""

    def __init__(self, pieces: list[tuple[str, bool, bool]]):
        codes, at = [np.array([_BLANK], np.uint32)], 1
        self.edges = []
        for text, first, last in pieces:
            if first:
                self.edges.append(at - 1)
            codes += [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), codes[0]]
            at += len(text) + 1
            if last:
                self.edges.append(at - 1)
        self.codes = np.concatenate(codes)
        # characters from each place to the next blank
        gaps = np.flatnonzero(self.codes == _BLANK)
        self.room = gaps[np.searchsorted(gaps, np.arange(len(self.codes)))] - np.arange(len(self.codes))

    def starts(self, k: int) -> np.ndarray:
        return np.flatnonzero(self.room >= k)

    def hashes(self, starts: np.ndarray, k: int) -> np.ndarray:
        h = np.full(len(starts), k, np.uint64)
        for j in range(k):
            h = (h ^ (self.codes[starts + j].astype(np.uint64) + np.uint64(1))) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def texts(self, starts: np.ndarray, k: int) -> pa.Array:
        m = self.codes[starts[:, None] + np.arange(k)]
        if (m == 0).any():  # numpy drops trailing zeros
            return pa.array(["".join(map(chr, r)) for r in m.tolist()], pa.string())
        return pa.array(np.ascontiguousarray(m, "<u4").view(f"<U{k}").reshape(-1), pa.string())


def _blocks(batches: Iterator[pa.RecordBatch], max_len: int) -> Iterator[tuple[Block, int | None]]:
    """Blocks of about CHUNK_CHARS; the second value bounds the starts that count in a part of a long text."""
    held, size = [], 0
    for batch in batches:
        for text, first, last in zip(batch.column("t").to_pylist(), batch.column("is_first").to_pylist(), batch.column("is_last").to_pylist()):
            if len(text) > 2 * CHUNK_CHARS:
                for a in range(0, len(text), CHUNK_CHARS):
                    # one character before and max_len after: neighbours of the starts from 1 (0 at the beginning) on
                    lead = min(a, 1)
                    yield Block([(text[a - lead : a + CHUNK_CHARS + max_len], first and not a, last and a + CHUNK_CHARS + max_len >= len(text))]), (1 + lead, 1 + lead + CHUNK_CHARS)
                continue
            held.append((text, first, last))
            size += len(text) + 1
            if size >= CHUNK_CHARS:
                yield Block(held), None
                held, size = [], 0
    if held:
        yield Block(held), None


def _places(block: Block, inside: tuple[int, int] | None, k: int) -> np.ndarray:
    at = block.starts(k)
    return at if inside is None else at[(at >= inside[0]) & (at < inside[1])]


def gram_rows(batches: Iterator[pa.RecordBatch], max_len: int) -> Iterator[pa.RecordBatch]:
    for block, inside in _blocks(batches, max_len):
        for k in range(1, max_len + 1):
            at = _places(block, inside, k)
            _, first, n = np.unique(block.hashes(at, k), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([block.texts(at[first], k), pa.array(n.astype(np.int64))], ["text", "n"])


def gram_counts(pieces: DataFrame, max_len: int) -> DataFrame:
    """(text, n) of every n-gram of 1 to ``max_len`` characters without a blank; counted in each block before the shuffle."""
    rows = pieces.select("t", "is_first", "is_last").mapInArrow(lambda batches: gram_rows(batches, max_len), "text string, n long")
    return rows.groupBy("text").agg(F.sum("n").alias("n"))


def neighbour_rows(batches: Iterator[pa.RecordBatch], max_len: int, known: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """(text, side, near, c) of each block; ``known``: sorted hashes of the words of each length, None for all n-grams."""
    for block, inside in _blocks(batches, max_len):
        for k in range(1, max_len + 1) if known is None else sorted(known):
            at = _places(block, inside, k)
            h = block.hashes(at, k)
            if known is not None:
                hit = known[k][np.minimum(np.searchsorted(known[k], h), len(known[k]) - 1)] == h
                at, h = at[hit], h[hit]
            for side, place in (("left", at - 1), ("right", at + k)):
                near = block.codes[place].astype(np.uint64)
                real = ~np.isin(place, block.edges)
                _, first, c = np.unique((h[real] ^ ((near[real] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([block.texts(at[real][first], k), pa.array([side] * len(first), pa.string()), block.texts(place[real][first], 1), pa.array(c.astype(np.int64))], ["text", "side", "near", "c"])


def neighbour_counts(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(text, side, near, c): how often each character stands before and after each word of ``words`` (text).

    Blanks count as neighbours, the ends of the corpus don't.  Words are looked
    up by hash while there are at most ``PROBES``, and by a join in any case, so
    that a clash of hashes changes nothing.
    """
    size = words.agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).first()
    max_len, keys = size.longest or 0, None
    if size.n <= PROBES:
        by_len: dict[int, list[str]] = {}
        for (text,) in words.select("text").toLocalIterator():
            by_len.setdefault(len(text), []).append(text)
        keys = words.sparkSession.sparkContext.broadcast({k: known_hashes(own) for k, own in by_len.items()})
    every = pieces.select("t", "is_first", "is_last").mapInArrow(lambda batches: neighbour_rows(batches, max_len, None if keys is None else keys.value), "text string, side string, near string, c long")
    return every.join(checked(words.select("text"), "words"), "text", "left_semi").groupBy("text", "side", "near").agg(F.sum("c").alias("c"))


def known_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words of one length."""
    k = len(words[0])
    return np.unique(Block([(w, False, False) for w in words]).hashes(1 + (k + 1) * np.arange(len(words)), k))


def entropy(near: DataFrame, side: str) -> DataFrame:
    """(text, h): ln n - sum(c ln c) / n over the neighbours of one side."""
    own = near.where(F.col("side") == side)
    return own.groupBy("text").agg((F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("h"))


def auto_parameters(length: int) -> dict[str, float]:
    return {"min_entropy": math.log(length) / 10 if length else 0.0, "min_freq": min(5e-5, 20.0 / max(1, length)), "min_aggregation": math.sqrt(length) / 15}


def discover(docs: DataFrame, max_word_len: int = 5, auto_param: bool = True, min_freq: float = 5e-5, min_entropy: float = 1.4, min_aggregation: float = 50, ent_threshold: str = "both", excluding: DataFrame | Iterable[str] | None = None, exclude_number: bool = True, threshold_seeds: list[str] = (), sort_by: str | None = "freq", separators: str = SEPARATORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New words (schema NEW_WORDS), sorted by ``sort_by`` then text.  All thresholds are strict."""
    if auto_param:
        got = docs.agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("n"), F.count("*").alias("d")).first()
        p = auto_parameters(int((got.n or 0) + max(0, got.d - 1)))
        min_entropy, min_freq, min_aggregation = p["min_entropy"], p["min_freq"], p["min_aggregation"]
    pieces = normalised(docs, separators, id_col, text_col)
    length = pieces.agg(F.sum(F.length("t")).alias("len"))
    # a part of a frequent n-gram is at least as frequent: all that is looked up below is in this table of at most max_word_len / min_freq rows
    kept = gram_counts(pieces, max_word_len).crossJoin(F.broadcast(length)).select("text", (F.col("n") / F.col("len")).alias("freq")).where(F.col("freq") > min_freq)  # one row is broadcast
    freq = settle(kept, "ngram-freq")
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("k")
    parts = freq.where(F.length("text") > 1).select("text", "freq", at).select("text", "freq", F.substring("text", F.lit(1), F.col("k")).alias("a"), F.expr("substring(text, k + 1)").alias("b"))
    parts = parts.join(freq.select(F.col("text").alias("a"), F.col("freq").alias("fa")), "a").join(freq.select(F.col("text").alias("b"), F.col("freq").alias("fb")), "b")
    solid = parts.groupBy("text", "freq").agg(F.min(F.col("freq") / (F.col("fa") * F.col("fb"))).alias("agg")).where(F.col("agg") > min_aggregation)
    solid = settle(solid, "ngram-solid")
    near = settle(neighbour_counts(pieces, solid.select("text")), "ngram-near")
    words = solid
    for side in ("left", "right"):
        words = words.join(entropy(near, side).withColumnRenamed("h", f"{side}_ent"), "text", "left").withColumn(f"{side}_ent", F.coalesce(f"{side}_ent", F.lit(0.0)))
    low: Column = (F.col("left_ent") > min_entropy) & (F.col("right_ent") > min_entropy) if ent_threshold == "both" else (F.col("left_ent") + F.col("right_ent")) / 2 > min_entropy
    words = words.where(low)
    if excluding is not None:
        words = among(words, F.col("text"), excluding, False)
    if exclude_number:
        words = words.where(~F.col("text").rlike(r"^\p{Nd}+$"))
    words = words.select("text", "freq", "left_ent", "right_ent", "agg", (F.log10("agg") * F.col("freq") * (F.col("left_ent") + F.col("right_ent"))).alias("score"))
    if threshold_seeds:
        least = words.where(F.col("text").isin(list(threshold_seeds))).agg((F.min("score") * 0.9).alias("least"))
        words = words.crossJoin(F.broadcast(least)).where(F.col("least").isNull() | (F.col("score") > F.col("least"))).drop("least")  # one row
    return words.orderBy(F.desc(sort_by), "text") if sort_by else words


def averages(words: DataFrame) -> DataFrame:
    """Mean length, frequency, entropies and cohesion of the found words; zeros without any."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return words.agg(zero(F.avg(F.length("text"))).alias("avg_len"), *(zero(F.avg(c)).alias(f"avg_{c}") for c in ("freq", "left_ent", "right_ent", "agg")))


def find_with_rules(words: DataFrame, rule) -> DataFrame:
    """Distinct words that a rule of ``functions.patterns`` accepts."""
    return words.select("word").where(rule(F.col("word"))).distinct()


__all__ = ["W", "SEPARATORS", "normalised", "gram_counts", "neighbour_counts", "entropy", "auto_parameters", "discover", "averages", "find_with_rules"]
