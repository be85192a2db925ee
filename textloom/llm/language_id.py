"""Word-first language identification with back-off to shorter character n-grams.

Every word has a cost in every language, -log10 of its relative frequency
there, ``PENALTY`` where the language never had it.  A word that no language
had is cut into character n-grams of the padded word; the longest length with
at least one known n-gram gives the mean cost of its known ones, else the next
shorter length is tried; a word without any known n-gram costs ``PENALTY`` in
all languages.  A document takes the language of least mean cost.

The model is fitted on at most ``TRAIN_DOCS`` labelled documents (smallest
hashes of doc_id; a documented bound on fitting only) and keeps every word and
n-gram that occurs at least ``MIN_COUNT`` times in a language of that sample, so
its broadcast doesn't grow with the corpus.  Scoring covers every document and
all of its text.

Defined results: words are runs of letters and marks, lower-cased.  Null, empty
and letterless texts get ``pred_lang`` 'und', cost and margin 0.0, keep false.
Ties go to the language that sorts first.  Very long texts are scored whole.
Rows are scored one by one, so repeated rows and null ids change nothing.  An
empty table, or one without labelled rows, gives a model without languages, and
every document of it 'und'.  Columns are taken by exact name; others, whatever
they are called, are ignored (``detect``) or kept (``keep_known``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TRAIN_DOCS, MIN_COUNT, MAX_GRAM, PENALTY = 6000, 3, 4, 7.0
#: Least difference of mean cost to the second language, and most mean cost, of a document that stays.
MIN_MARGIN, MAX_COST = 0.005, 6.9

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])
    return _letters


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in code points and the code points of lower-cased texts."""
    lower = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    offsets = np.concatenate([[0], np.cumsum(pc.utf8_length(lower).to_numpy(zero_copy_only=False))]).astype(np.int64)
    _, raw = C.string_buffers(lower)
    return offsets, np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, doc of each word, index into the distinct words, their hashes, starts, ends)."""
    offsets, codes = code_points(texts)
    start, end, doc = C.spans(offsets, ~letters()[codes])
    h = C.span_hash(codes, start, end, C.BASE)
    keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    return codes, doc, inverse, keys, start[at], end[at]


def grams(codes: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the blank-padded words, and the word of each."""
    width = end - start + 2
    base = np.cumsum(width) - width
    word = np.repeat(np.arange(len(start)), width)
    place = np.arange(len(word)) - base[word]
    flat = np.full(len(word), 32, np.uint32)
    inner = (place > 0) & (place < width[word] - 1)
    flat[inner] = codes[(start[word] + place - 1)[inner]]
    at = np.flatnonzero(place + size <= width[word])
    if size == 1:
        at = at[inner[at]]
    return C.span_hash(flat, at, at + size, C.QBASE), word[at]


class Model:
    """Sorted 64-bit keys and a cost matrix for words (level 0) and n-grams of each length."""

    def __init__(self, langs: list[str], levels: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.levels = langs, levels

    @classmethod
    def of(cls, rows: pd.DataFrame, max_gram: int = MAX_GRAM) -> Model:
        langs = sorted(rows.lang.unique())
        levels = {}
        for n in range(max_gram + 1):
            part = rows[rows.n == n]
            keys, at = np.unique(part.key.to_numpy(np.int64).view(np.uint64), return_inverse=True)
            cost = np.full((len(keys), len(langs)), PENALTY)
            cost[at, np.searchsorted(langs, part.lang.to_numpy(str)) if len(part) else []] = np.minimum(PENALTY, -np.log10(part.cnt.to_numpy(float) / np.maximum(part.total.to_numpy(float), 1)))
            levels[n] = keys, cost
        return cls(langs, levels)

    def find(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.levels[n]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def word_costs(self, codes: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost[word, lang], whether the word is unseen)."""
        cost = np.full((len(keys), len(self.langs)), PENALTY)
        at, known = self.find(0, keys)
        cost[known] = self.levels[0][1][at[known]]
        unseen = ~known
        left = np.flatnonzero(unseen)
        for n in range(max(self.levels), 0, -1):
            if not len(left):
                break
            h, word = grams(codes, start[left], end[left], n)
            at, hit = self.find(n, h)
            at, word = at[hit], word[hit]
            hits = np.bincount(word, minlength=len(left))
            got = hits > 0
            for k in range(len(self.langs)):
                total = np.bincount(word, self.levels[n][1][at, k], minlength=len(left))
                cost[left[got], k] = total[got] / hits[got]
            left = left[~got]
        return cost, unseen

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        n = len(texts)
        codes, doc, inverse, keys, start, end = distinct_words(texts)
        cost, unseen = self.word_costs(codes, keys, start, end)
        words = C.per_doc(doc, n)
        mean = np.stack([np.bincount(doc, cost[inverse, k], minlength=n) for k in range(len(self.langs))], 1) if self.langs else np.zeros((n, 1))
        mean = mean / np.maximum(words, 1)[:, None]
        best = np.argmin(mean, 1)
        ordered = np.sort(mean, 1)
        margin = ordered[:, 1] - ordered[:, 0] if mean.shape[1] > 1 else np.full(n, np.inf)
        some = (words > 0) & bool(self.langs)
        return {
            "pred_lang": np.where(some, np.array(self.langs or ["und"], object)[best], "und"),
            "cost": np.where(some, ordered[:, 0], 0.0),
            "margin": np.where(some, np.minimum(margin, PENALTY), 0.0),
            "n_words": words,
            "n_unseen": C.per_doc(doc, n, unseen[inverse].astype(float)),
            "some": some,
        }


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, min_count: int = MIN_COUNT, max_gram: int = MAX_GRAM) -> Model:
    """Counts over a bounded labelled sample; rows without id, text or language are left out."""
    slim = C.narrow(df, doc_id=id_col, text=text_col, lang=lang_col).where("doc_id is not null and text is not null and lang is not null")
    pick = slim.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    sample = slim.join(pick, "doc_id", "left_semi").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch):
                codes, doc, inverse, keys, start, end = distinct_words(part.column("text"))
                names, lang_of = np.unique(part.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                for k, lang in enumerate(names):
                    seen = np.bincount(inverse[lang_of[doc] == k], minlength=len(keys))
                    have = np.flatnonzero(seen)
                    for n in range(max_gram + 1):
                        if n:
                            h, word = grams(codes, start[have], end[have], n)
                            h, at = np.unique(h, return_inverse=True)
                            c = C.per_doc(at, len(h), seen[have][word])
                        else:
                            h, c = keys[have], seen[have]
                        yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(h), pa.string()), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "n", "key", "cnt"])

    counts = sample.mapInArrow(C.tidy(count), "lang string, n int, key long, cnt long").groupBy("lang", "n", "key").agg(F.sum("cnt").alias("cnt"))
    counts = C.settle(counts, "language-counts")
    total = F.broadcast(counts.groupBy("lang", "n").agg(F.sum("cnt").alias("total")))  # a row a language and length
    kept = counts.where(F.col("cnt") >= min_count).join(total, ["lang", "n"]).select("lang", "n", "key", "cnt", "total")
    return Model.of(kept.toPandas(), max_gram)  # of the bounded sample


def detect(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_margin: float = MIN_MARGIN, max_cost: float = MAX_COST) -> DataFrame:
    """One row a document: doc_id, lang, pred_lang, cost, margin, n_words, n_unseen, keep."""
    slim = C.narrow(df, doc_id=id_col, text=text_col, lang=lang_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in C.text_chunks(batch):
                got = own.score(part.column("text"))
                keep = got["some"] & (got["margin"] >= min_margin) & (got["cost"] <= max_cost)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang").cast(pa.string()), pa.array(got["pred_lang"], pa.string()), pa.array(got["cost"]), pa.array(got["margin"]), pa.array(got["n_words"]), pa.array(got["n_unseen"]), pa.array(keep)],
                    ["doc_id", "lang", "pred_lang", "cost", "margin", "n_words", "n_unseen", "keep"],
                )

    return slim.mapInArrow(C.tidy(run), f"doc_id {kind}, lang string, pred_lang string, cost double, margin double, n_words long, n_unseen long, keep boolean")


def keep_known(df: DataFrame, model: Model, text_col: str = "text", min_margin: float = MIN_MARGIN, max_cost: float = MAX_COST) -> DataFrame:
    """The rows of ``df`` whose language is known, all columns as they were; no shuffle."""
    plain, name = C.numbered(df)
    text = name(text_col)
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in C.text_chunks(batch, text):
                got = own.score(part.column(text))
                yield part.filter(pa.array(got["some"] & (got["margin"] >= min_margin) & (got["cost"] <= max_cost)))

    return plain.mapInArrow(C.tidy(run), plain.schema).toDF(*df.columns)
