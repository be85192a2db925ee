"""Extractive summaries: TextRank over sentences, MMR against repetition, a length budget."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.batches import freed
from .graph import pagerank_matrix, power_iteration

Similarity = Callable[[list[str], list[str]], float]


def overlap(a: list[str], b: list[str]) -> float:
    if len(a) <= 1 or len(b) <= 1:
        return 0.0
    return len(set(a) & set(b)) / (math.log2(len(a)) + math.log2(len(b)))


def cosine(a: list[str], b: list[str], eps: float = 1e-5) -> float:
    x, y = Counter(a), Counter(b)
    size = lambda c: math.sqrt(sum(v * v for v in c.values())) + eps
    return sum(v * y[w] for w, v in x.items() if w in y) / (size(x) * size(y))


def overlap_matrix(sents: list[list[str]]) -> np.ndarray:
    """All overlaps through an inverted index: pairs without a shared token cost nothing."""
    n = len(sents)
    m = np.zeros((n, n))
    post: dict[str, list[int]] = {}
    for i, s in enumerate(sents):
        for w in set(s):
            post.setdefault(w, []).append(i)
    for ids in post.values():
        m[np.ix_(ids, ids)] += 1
    logs = np.log2(np.maximum([len(s) for s in sents], 1))
    both = logs[:, None] + logs[None, :]
    short = np.array([len(s) <= 1 for s in sents])
    m = np.divide(m, both, out=np.zeros_like(m), where=both > 0)
    m[short, :] = m[:, short] = 0
    np.fill_diagonal(m, 0)
    return m


def overlap_rank(sents: list[list[str]]) -> np.ndarray:
    """``pagerank_matrix(overlap_matrix(sents))`` without the matrix."""
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for s in sents for w in s], np.int64)
    sizes = np.array([len(s) for s in sents], np.int64)
    return _overlap_rank(sizes, *_distinct(codes, sizes, len(known))[:2], len(known))


def _distinct(codes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence, word and count of each sentence's distinct words; ``codes`` of ``n`` words, sentence after sentence."""
    key, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + codes, return_counts=True)
    return key // max(1, n), key % max(1, n), count


#: Up to so many sentences, the matrix is made: it is quicker than the words.
DENSE = 64


def _overlap_rank(sizes: np.ndarray, at: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """``overlap_rank`` of sentences of ``sizes`` words from their distinct words (``at``, ``word``) of ``n``.

    The matrix's product with a vector goes through words and sentence lengths, so many sentences take no square of their number."""
    long = sizes[at] > 1  # shorter sentences have no edges
    at, word = at[long], word[long]
    several = np.bincount(word, minlength=n) > 1  # other words link nothing
    number, own = np.cumsum(several) - 1, several[word]
    at, word, words = at[own], number[word[own]], int(several.sum())
    lengths, kind = np.unique(sizes, return_inverse=True)
    logs = np.log2(np.maximum(lengths, 1))
    both = logs[None, :] + logs[:, None]
    weight = np.divide(1.0, both, out=np.zeros_like(both), where=both > 0)
    if len(sizes) <= DENSE:
        has = np.zeros((len(sizes), words))
        has[at, word] = 1
        m = (has @ has.T) * weight[kind][:, kind]
        np.fill_diagonal(m, 0)
        return power_iteration(len(sizes), lambda x: m @ x)
    slot = word * len(lengths) + kind[at]
    own = np.bincount(at, minlength=len(sizes)) * weight[kind, kind]  # of a sentence with itself

    def flow(x: np.ndarray) -> np.ndarray:
        by_word = np.bincount(slot, x[at], words * len(lengths)).reshape(-1, len(lengths)) @ weight
        return np.bincount(at, by_word.ravel()[slot], len(sizes)) - own * x

    return power_iteration(len(sizes), flow)


def summarise(sents: list[list[str]], lengths: list[int], k: int, maxlen: float = math.inf, avoid_repeat: bool = False, sim: Similarity | None = None, lemma: Callable[[str], str] | None = None) -> list[tuple[int, float]]:
    """(index, importance) of the chosen sentences, best first; sentences without tokens are never chosen."""
    if k <= 0:
        raise ValueError("k must be positive")
    if lemma:
        sents = [[lemma(w) for w in s] for s in sents]
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for s in sents for w in s], np.int64)
    rank = None
    if sim is not None:
        words = [s for s in sents if s]
        rank = pagerank_matrix(np.array([[0.0 if i == j else sim(words[min(i, j)], words[max(i, j)]) for j in range(len(words))] for i in range(len(words))])) if words else np.zeros(0)
    return _summarise(codes, len(known), np.array([len(s) for s in sents], np.int64), np.array(lengths), k, maxlen, avoid_repeat, rank)


def _summarise(codes: np.ndarray, n: int, sizes: np.ndarray, lengths: np.ndarray, k: int, maxlen: float, avoid_repeat: bool, rank: np.ndarray | None = None) -> list[tuple[int, float]]:
    """``summarise`` of sentences of ``sizes`` words, these as ``codes`` below ``n``."""
    own = np.flatnonzero(sizes)
    if not len(own):
        return []
    at, word, count = _distinct(codes, sizes[own], n)
    if rank is None:
        rank = _overlap_rank(sizes[own], at, word, n)
    order = np.argsort(-np.round(rank, 12), kind="stable")
    out, used = [], 0

    def take(i: int) -> bool:
        nonlocal used
        used += int(lengths[own[i]])
        if used > maxlen:
            return False
        out.append((int(own[i]), float(rank[i])))
        return True

    if not avoid_repeat:
        for i in order[:k]:
            if not take(i):
                break
        return out
    # cosine(said, sentence), of all sentences at once
    size = np.sqrt(np.bincount(at, count * count, len(own))) + 1e-5
    said, left = np.zeros(n), np.ones(len(own), bool)
    i = order[0]
    while take(i):
        left[i] = False
        if len(out) == k or not left.any():
            break
        new = slice(*np.searchsorted(at, [i, i + 1]))
        said[word[new]] += count[new]
        near = np.bincount(at, count * said[word], len(own)) / ((math.sqrt(said @ said) + 1e-5) * size)
        rest = np.flatnonzero(left)
        e = np.exp(rank[rest] - rank[rest].max())
        i = rest[int(np.argmax(np.round(0.6 * e / e.sum() - 0.4 * near[rest], 12)))]  # equal ones in their order
    return out


def summary(sents: DataFrame, k: int = 5, maxlen: int | None = None, avoid_repeat: bool = False, sim: Similarity | None = None, lemma: Callable[[str], str] | None = None, group_col: str = "doc_id") -> DataFrame:
    """(group, sent_id, text, importance, rank) from sentences (group, sent_id, text, words); a group is one task's problem.

    Sentences are brought together by a shuffle; where documents are at hand, ``summary_docs`` spares it."""
    whole = sents.groupBy(group_col).agg(F.array_sort(F.collect_list(F.struct("sent_id", "text", "words"))).alias("sents"))
    return summary_docs(whole, k, maxlen, avoid_repeat, sim, lemma, group_col)


def summary_docs(docs: DataFrame, k: int = 5, maxlen: int | None = None, avoid_repeat: bool = False, sim: Similarity | None = None, lemma: Callable[[str], str] | None = None, group_col: str = "doc_id") -> DataFrame:
    """``summary`` of (group, sents), the latter an array of (sent_id, text, words) in order: one narrow pass, a row a summary of its own."""
    if k <= 0:
        raise ValueError("k must be positive")
    kind, sid = docs.schema[group_col].dataType.simpleString(), docs.schema["sents"].dataType.elementType["sent_id"].dataType.simpleString()
    budget = math.inf if maxlen is None else maxlen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sents = batch.column("sents")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(sents), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            rows = sents.flatten()
            text, words = rows.field("text"), rows.field("words")
            lengths = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten()
            codes = None if sim or lemma else flat.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.append(0, np.cumsum(sizes))
            doc, at, value, place = [], [], [], []
            for d, (a, b) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
                if codes is None:
                    got = summarise([w or [] for w in words.slice(a, b - a).to_pylist()], lengths[a:b], k, budget, avoid_repeat, sim, lemma)
                else:
                    known, own = np.unique(codes[starts[a] : starts[b]], return_inverse=True)
                    got = _summarise(own.ravel(), len(known), sizes[a:b], lengths[a:b], k, budget, avoid_repeat)
                doc += [d] * len(got)
                at += [a + i for i, _ in got]
                value += [x for _, x in got]
                place += range(1, len(got) + 1)
            took = rows.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("g").take(pa.array(doc, pa.int64())), took.field("sent_id"), took.field("text"), pa.array(value, pa.float64()), pa.array(place, pa.int32())], ["g", "sent_id", "text", "importance", "rank"])
        freed()

    out = docs.select(F.col(group_col).alias("g"), "sents").mapInArrow(run, f"g {kind}, sent_id {sid}, text string, importance double, rank int")
    return out.withColumnRenamed("g", group_col)


def similar_pairs(sents: DataFrame, group_col: str = "doc_id") -> DataFrame:
    """(group, a, b, weight) of sentence pairs with a shared token, by a join on tokens: for groups too large for one task."""
    s = sents.select(F.col(group_col).alias("g"), "sent_id", "words").where(F.size("words") > 1)
    t = s.select("g", "sent_id", F.size("words").alias("n"), F.explode(F.array_distinct("words")).alias("w"))
    o = t.select("g", F.col("sent_id").alias("b"), F.col("n").alias("m"), "w")
    pairs = t.join(o, ["g", "w"]).where(F.col("sent_id") < F.col("b")).groupBy("g", "sent_id", "b", "n", "m").agg(F.count("*").alias("c"))
    return pairs.select(F.col("g").alias(group_col), F.col("sent_id").alias("a"), "b", (F.col("c") / (F.log2("n") + F.log2("m"))).alias("weight"))
