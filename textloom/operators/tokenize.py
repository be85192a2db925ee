"""Entity-aware segmentation and tagging.

Link spans are cut out first; the gaps are segmented by a dictionary's
most probable path (Han), or by a regex (Latin).  Unknown Han characters are
single tokens; runs of ASCII letters or digits are one token.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segment import ENGLISH_TOKEN, words
from ..plans.batches import freed, in_pieces, pieces
from ..plans.small import among
from ..schema import TOKENS
from .lexicon import Lexicon
from .linking import Matcher

#: Words of short documents that become rows at once.
SPAN_ROWS = 1 << 16
RUN = re.compile(r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|\s+|.", re.S)


@dataclass
class Dictionary:
    """word -> (frequency, tag); ``from_table`` reads a (word, freq, pos) table."""

    words: dict[str, tuple[int, str | None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total = math.log(max(1, sum(f for f, _ in self.words.values())))
        self.cost = {w: math.log(max(1, f)) - self.total for w, (f, _) in self.words.items()}
        sizes: dict[str, set[int]] = {}
        for w in self.words:
            sizes.setdefault(w[0], set()).add(len(w))
        self.sizes = {c: sorted(n) for c, n in sizes.items()}  # lengths of the words that begin with a character

    @classmethod
    def from_table(cls, df: DataFrame, limit: int = 5_000_000) -> Dictionary:
        if df.limit(limit + 1).count() > limit:
            raise ValueError(f"a segmentation dictionary has at most {limit} words")
        return cls({r[0]: (int(r[1] or 1), r[2] if len(r) > 2 else None) for r in df.collect() if r[0]})

    def cut(self, text: str) -> list[str]:
        """Most probable path; later starts win ties by the longer word."""
        if not self.words:
            return RUN.findall(text)
        runs, n, cost = {}, len(text), self.cost
        for m in RUN.finditer(text):
            runs[m.start()] = m.end()
        best: list[tuple[float, int]] = [(0.0, 0)] * n + [(0.0, 0)]
        for i in range(n - 1, -1, -1):
            ends = [i + k for k in self.sizes.get(text[i], ()) if i + k <= n and text[i : i + k] in cost]
            end = runs.get(i)
            if not ends or end is not None and end > i + 1:
                ends.append(end or i + 1)
            best[i] = max((cost.get(text[i:j], -self.total) + best[j][0], j) for j in ends)
        out, i = [], 0
        while i < n:
            out.append(text[i : best[i][1]])
            i = best[i][1]
        return out

    def tag(self, word: str) -> str | None:
        got = self.words.get(word)
        if got and got[1]:
            return got[1]
        if re.fullmatch(r"[A-Za-z]+", word):
            return "eng"
        if re.fullmatch(r"[\d.]+", word):
            return "m"
        return "x" if not re.search(r"\w", word) else None


_TOKEN_TYPE = pa.struct([("word", pa.string()), ("flag", pa.string()), ("l", pa.int32()), ("r", pa.int32()), ("is_entity", pa.bool_())])


def posseg(text: Column, lexicon: Lexicon, spark: SparkSession, dictionary: Dictionary | None = None, stopwords: set[str] = frozenset(), standard_name: bool = False) -> Column:
    """Array of tokens (schema TOKENS).  An entity is one token flagged with its
    type and never a stop word; ``standard_name`` writes the entity's name."""
    tokens = _tagger(lexicon, spark, dictionary, stopwords, standard_name)

    @F.arrow_udf(TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(tokens, pa.list_(_TOKEN_TYPE))(texts)

    return run(text)


def posseg_table(docs: DataFrame, lexicon: Lexicon, dictionary: Dictionary | None = None, stopwords: set[str] = frozenset(), standard_name: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fields of ``posseg``'s tokens, a row a token; what a worker holds follows a piece of the text."""
    tokens = _tagger(lexicon, docs.sparkSession, dictionary, stopwords, standard_name)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                got = tokens(batch.column("text").slice(a, b - a).to_pylist())
                ids = batch.column("doc_id").slice(a, b - a).take(pc.list_parent_indices(got))
                yield pa.RecordBatch.from_arrays([ids, *got.flatten().flatten()], ["doc_id", *(f.name for f in _TOKEN_TYPE)])
        freed()

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, word string, flag string, l int, r int, is_entity boolean")


def _tagger(lexicon: Lexicon, spark: SparkSession, dictionary: Dictionary | None, stopwords: set[str], standard_name: bool) -> Callable[[list[str | None]], pa.Array]:
    english = lexicon.language == "en"
    shared = spark.sparkContext.broadcast((lexicon.candidates(), dictionary or Dictionary(), frozenset(stopwords)))

    def run(texts: list[str | None]) -> pa.Array:
        cands, known, stop = shared.value
        matcher = Matcher(cands)
        english_word = regex.compile(ENGLISH_TOKEN)
        tags: dict[str, str | None] = {}
        # one flat list a field: no object a token
        words, flags, begins, ends, linked, offsets, empty = [], [], [], [], [], [0], []

        def gap(t: str, a: int, b: int) -> None:
            part = t[a:b]
            if english:
                pieces = [(m.group(), a + m.start()) for m in english_word.finditer(part)]
            else:
                pieces, at = [], a
                for w in known.cut(part):
                    pieces.append((w, at))
                    at += len(w)
            for w, p in pieces:
                if w.isspace() or w in stop:
                    continue
                if w not in tags:
                    tags[w] = known.tag(w)
                words.append(w)
                flags.append(tags[w])
                begins.append(p)
                ends.append(p + len(w))
                linked.append(False)

        for t in texts:
            empty.append(t is None)
            at = 0
            for l, r in matcher.scan(t or ""):
                entity, etype = cands[t[l:r]][0]
                gap(t, at, l)
                words.append(entity if standard_name else t[l:r])
                flags.append(etype)
                begins.append(l)
                ends.append(r)
                linked.append(True)
                at = r
            gap(t or "", at, len(t or ""))
            offsets.append(len(words))
        rows = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((words, flags, begins, ends, linked), _TOKEN_TYPE)], fields=list(_TOKEN_TYPE))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=pa.array(empty, pa.bool_()))

    return run


def seg(text: Column, lexicon: Lexicon, spark: SparkSession, dictionary: Dictionary | None = None, stopwords: set[str] = frozenset(), standard_name: bool = False, return_sent: bool = False) -> Column:
    """Array of words, or one blank-joined string."""
    got = F.transform(posseg(text, lexicon, spark, dictionary, stopwords, standard_name), lambda t: t["word"])
    return F.array_join(got, " ") if return_sent else got


def char_tags(tokens: Column, text: Column) -> Column:
    """One tag a character, from a column of tokens (not a UDF's result in the same select); null where none covers it."""
    return F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.try_element_at(F.filter(tokens, lambda t: (t["l"] <= i) & (i < t["r"])), F.lit(1))["flag"])


def tokens_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"[\p{L}\p{N}]+", lower: bool = True) -> DataFrame:
    """doc_id, pos, word: regex words in the JVM."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(F.col(text_col), pattern, lower)).alias("pos", "word"))


def words_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"[\p{L}\p{N}]+", lower: bool = True) -> DataFrame:
    """doc_id, word: a document's distinct words, repeats left out before they become rows."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(words(F.col(text_col), pattern, lower))).alias("word"))


def spans_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"[\p{L}\p{N}]+", sizes: Iterable[int] | None = None) -> DataFrame:
    """doc_id, pos, word, l, r: regex words with their offsets.  The JVM finds words and gaps, a narrow pass sums lengths.

    ``sizes``: only words of these lengths become rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = words(F.col(text_col), pattern, False)
    wanted = None if sizes is None else sorted(set(sizes))
    both = docs.select(F.col(id_col).alias("doc_id"), found.alias("w"), F.transform(F.split(text_col, pattern, -1), F.length).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pc.list_value_length(batch.column("w"))
            batch = batch.filter(pc.greater(some, 0))  # not by Spark: below the projection words would be found twice
            ends, start = np.cumsum(pc.list_value_length(batch.column("w")).to_numpy().astype(np.int64)), 0
            while start < len(ends):
                begin = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, begin + SPAN_ROWS, "right")))
                w, g = batch.column("w").slice(start, end - start), batch.column("g").slice(start, end - start)
                own, word = pc.list_parent_indices(w), w.flatten()
                doc, first = own.to_numpy(), np.append(0, ends[start : end - 1] - begin)
                pos = np.arange(len(doc)) - first[doc]
                size = pc.utf8_length(word).to_numpy().astype(np.int64)
                # a text has a gap before each word and one behind the last
                gap = g.flatten().to_numpy()[np.arange(len(doc)) + doc]
                total = np.cumsum(gap + size)
                r = total - np.append(0, total)[first][doc]
                fields = [batch.column("doc_id").slice(start, end - start).take(own), pa.array(pos, pa.int32()), word, pa.array(r - size, pa.int32()), pa.array(r, pa.int32())]
                rows = pa.RecordBatch.from_arrays(fields, ["doc_id", "pos", "word", "l", "r"])
                yield rows if wanted is None else rows.filter(pa.array(np.isin(size, wanted)))
                start = end
        freed()

    return both.mapInArrow(run, f"doc_id {kind}, pos int, word string, l int, r int")


def without(tokens: DataFrame, stopwords: DataFrame | Iterable[str], word_col: str = "word") -> DataFrame:
    """Tokens that are no stop words: a filter for a short list, a join behind a size check for a table or a long list."""
    return among(tokens, F.col(word_col), stopwords, False)
