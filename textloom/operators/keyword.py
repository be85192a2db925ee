"""Keywords by TF-IDF or by TextRank over adjacent words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.batches import freed
from ..plans.cut import settle
from ..plans.small import among, repeated
from .graph import power_iterations

POS = ("n", "ns", "nr", "nt", "nz", "vn", "v", "an", "a", "i")


def filter_tokens(tokens: DataFrame, min_word_len: int = 2, allow_pos: list[str] | None = None, stopwords: DataFrame | Iterable[str] | None = None) -> DataFrame:
    """Tokens that may be keywords; ``allow_pos`` needs a ``flag`` column."""
    out = tokens.where(F.length("word") >= min_word_len)
    if allow_pos is not None:
        out = out.where(F.col("flag").isin(list(allow_pos)))
    return out if stopwords is None else among(out, F.col("word"), stopwords, False)


def allowed(words: Column, stopwords: Iterable[str] = (), min_word_len: int = 2) -> Column:
    """``filter_tokens`` on an array of words and a short list of stop words."""
    stop = sorted(set(stopwords))
    return F.filter(words, lambda w: (F.length(w) >= min_word_len) & (~w.isin(stop) if stop else F.lit(True)))


def idf_table(tokens: DataFrame) -> DataFrame:
    """(word, idf) = ln((1 + N) / (1 + df)) + 1 over the documents of the corpus."""
    own = settle(tokens.select("doc_id", "word").distinct(), "doc-words")
    n = own.agg(F.countDistinct("doc_id").alias("n_docs"))
    df = own.groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row is broadcast


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each doc_id, ties by word."""
    w = W.partitionBy("doc_id").orderBy(F.desc(score), "word")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tfidf(tokens: DataFrame, k: int, idf: DataFrame | None = None, default_idf: float | None = None, decimals: int | None = None) -> DataFrame:
    """doc_id, word, score, rank.  Words that a supplied ``idf`` lacks take ``default_idf`` (none: left out).

    ``decimals`` rounds scores before they are ranked, so that equal words tie by name whatever the order of sums.
    Token rows are brought together by a shuffle; where documents are at hand, ``tfidf_words`` spares it.
    """
    if idf is None:
        return _tfidf_words(settle(tokens.groupBy("doc_id").agg(F.collect_list("word").alias("words")), "doc-words"), k, decimals)
    total = tokens.groupBy("doc_id", "word").agg(F.count("*").alias("tf")).withColumn("n", F.sum("tf").over(W.partitionBy("doc_id")))
    joined = total.join(idf, "word", "left" if default_idf is not None else "inner")
    weight = F.coalesce("idf", F.lit(default_idf)) if default_idf is not None else F.col("idf")
    score = F.col("tf") / F.col("n") * weight
    return top_k(joined.select("doc_id", "word", (score if decimals is None else F.round(score, decimals)).alias("score")), k)


#: Most words whose document frequencies every worker gets.
KNOWN_WORDS = 1 << 20
#: Tokens that are counted at once; one document is never split.
COUNTED_TOKENS = 1 << 20


def tfidf_words(docs: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """``tfidf`` of (doc_id, words) by the documents' own frequencies: two narrow passes, what is shuffled are words with their
    document frequencies.  Rows of one doc_id are one document; where there are such rows, they are brought together first."""
    if repeated(docs, "doc_id"):
        docs = settle(docs.groupBy("doc_id").agg(F.flatten(F.collect_list("words")).alias("words")), "doc-words")
    return _tfidf_words(docs, k, decimals)


def _tfidf_words(docs: DataFrame, k: int, decimals: int | None) -> DataFrame:
    """The workers get the frequencies of the most frequent words, ``KNOWN_WORDS`` at most.  Of the others they know bounds
    (mostly exact: these words are in one document each) and leave out what can't be among a document's k best by them."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.filter("words", lambda w: w.isNotNull()).alias("words"))
    once = F.array_distinct("words")
    # a document with an id and words adds a row without a word, which counts the documents
    marked = F.explode(F.when(F.col("doc_id").isNull() | (F.size("words") < 1), once).otherwise(F.concat(once, F.array(F.lit(None).cast("string")))))
    df = settle(docs.select(marked.alias("word")).groupBy("word").agg(F.count("*").alias("df")), "doc-frequencies")
    row = df.where("word is null").first()
    n_docs, df = row.df if row else 0, df.where("word is not null")
    power, known = 0, 0
    for r in df.groupBy(F.floor(F.log2("df")).alias("e")).agg(F.count("*").alias("n")).orderBy(F.desc("e")).collect():
        if r.e < 1 or known + r.n > KNOWN_WORDS:
            power = r.e + 1
            break
        known += r.n
    least = 1 << max(1, power)  # words of fewer documents are not known
    shared = spark.sparkContext.broadcast(_ipc(df.where(F.col("df") >= least).select("word", "df").toArrow()))
    margin = 0.0 if decimals is None else 1.01 * 10.0**-decimals
    idf = lambda x: np.log((1 + n_docs) / (1 + x)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        names, frequency = (table.column(c).combine_chunks() for c in ("word", "df"))
        frequency = np.append(frequency.to_numpy(), 0)  # the last one: not known
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("words")), 0))  # not by Spark: below the projection words would be found twice
            words = batch.column("words")
            sizes = pc.list_value_length(words).to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            codes, n_words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            own = frequency[pc.fill_null(pc.index_in(coded.dictionary, value_set=names), len(names)).to_numpy(zero_copy_only=False)]
            low, high = idf(np.where(own, own, least - 1)), idf(np.where(own, own, 1))
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):
                begin = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, begin + COUNTED_TOKENS, "right")))
                key, tf = np.unique(np.repeat(np.arange(end - start), sizes[start:end]) * n_words + codes[begin : int(ends[end - 1])], return_counts=True)
                doc, word = key // n_words, key % n_words
                share = tf / sizes[start + doc]
                first = np.searchsorted(doc, np.arange(end - start))
                least_scores = (share * low[word])[np.lexsort((-(share * low[word]), doc))]
                count = np.bincount(doc, minlength=end - start)
                kth = least_scores[first + np.minimum(k, count) - 1]
                bar = np.where(count > k, kth - margin - 1e-9 * np.abs(kth), -np.inf)
                keep = share * high[word] >= bar[doc]
                doc, word, tf = doc[keep], word[keep], tf[keep]
                mine = own[word]
                found = pa.array(np.where(mine, mine, 1), pa.int64(), mask=(mine == 0) if least > 2 else None)
                fields = [coded.dictionary.take(pa.array(word)), pa.array(tf, pa.int64()), pa.array(sizes[start + doc], pa.int64()), found]
                rows = pa.StructArray.from_arrays(fields, ["word", "tf", "n", "df"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=end - start))), pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), lists], ["doc_id", "best"])
                start = end
        freed()

    best = docs.mapInArrow(run, f"doc_id {kind}, best array<struct<word: string, tf: long, n: long, df: long>>")

    def score(tf: Column, n: Column, df: Column) -> Column:
        x = tf / n * (F.ln((1 + F.lit(n_docs)) / (1 + df)) + 1)
        return x if decimals is None else F.round(x, decimals)

    if least > 2:
        rows = settle(best.select("doc_id", F.explode("best").alias("x")).select("doc_id", "x.*"), "tfidf-candidates")
        rest = rows.where("df is null").drop("df").join(df.where(F.col("df") < least).hint("merge"), "word")
        every = rows.where("df is not null").unionByName(rest)
        return top_k(every.select("doc_id", "word", score(F.col("tf"), F.col("n"), F.col("df")).alias("score")), k)
    ranked = F.array_sort(F.transform("best", lambda x: _by_score(score(x["tf"], x["n"], x["df"]), x["word"])))
    top = best.select("doc_id", F.posexplode(F.slice(ranked, 1, k)).alias("rank", "x"))
    return top.select("doc_id", "x.word", (-F.col("x.below")).alias("score"), (F.col("rank") + 1).alias("rank"))


def _by_score(score: Column, word: Column) -> Column:
    return F.struct((-score).alias("below"), word.alias("word"))


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def window_pairs(tokens: DataFrame, window: int = 2, block: list[str] = ("doc_id",)) -> DataFrame:
    """Pairs of words at distances 1 .. window - 1 inside a block: block columns, a, b."""
    w = W.partitionBy(*block).orderBy("pos")
    ahead = F.array(*(F.lead("word", x).over(w) for x in range(1, max(2, window)))).alias("ahead")
    pairs = tokens.select(*block, F.col("word").alias("a"), ahead).select(*block, "a", F.explode("ahead").alias("b"))
    return pairs.where("b is not null")


def window_pair_counts(docs: DataFrame, window: int = 2) -> DataFrame:
    """a, b, n: how often ``window_pairs`` has a pair, of (words), a row a block: no token is shuffled.

    Pairs are counted in numpy batch by batch and shuffled in the order of their first word, which compresses well.
    Parts of a frequent first word go to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(ends):
                begin = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, begin + PAIR_TOKENS, "right")))
                coded = words.slice(start, end - start).flatten().dictionary_encode()
                order = pc.sort_indices(coded.dictionary)  # neighbours in the shuffle begin alike
                codes, names = np.argsort(order.to_numpy())[coded.indices.to_numpy()], coded.dictionary.take(order)
                block = np.repeat(np.arange(end - start), np.diff(np.append(begin, ends[start:end])))
                keys = []
                for x in range(1, max(2, window)):
                    near = block[:-x] == block[x:]
                    keys.append(codes[:-x][near] * len(names) + codes[x:][near])
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                for i in range(0, len(key), PAIR_ROWS):
                    part = key[i : i + PAIR_ROWS]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(part // len(names))), names.take(pa.array(part % len(names))), pa.array(n[i : i + PAIR_ROWS], pa.int64())], ["a", "b", "n"])
                start = end
        freed()

    pairs = docs.select("words").mapInArrow(run, "a string, b string, n long")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS))).repartition("a", "part")
    return pairs.groupBy("a", "part", "b").agg(F.sum("n").alias("n")).select("a", "b", "n")


#: Tokens whose pairs are counted at once (the more, the fewer pairs are shuffled; a document is never split), pairs that become rows at once.
PAIR_TOKENS, PAIR_ROWS = 1 << 22, 1 << 16
#: Tasks that share the pairs of one first word.
PARTS = 4


def _ranked(codes: np.ndarray, block: np.ndarray, doc: np.ndarray, window: int, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, codes and ranks: by document, best first, ties by first appearance; ``block`` and ``doc`` ascend."""
    pairs, of = [], []
    for x in range(1, max(2, window)):
        near = np.flatnonzero(block[:-x] == block[x:])
        pairs.append(np.stack([near, near + x], 1))
        of.append(block[near])
    ends = np.concatenate(pairs)
    if len(pairs) > 1:
        ends = ends[np.argsort(np.concatenate(of), kind="stable")]
    ends = ends.ravel()
    if not len(ends):
        return doc[:0], codes[:0], np.zeros(0)
    _, first, at = np.unique(doc[ends] * (codes.max() + 1) + codes[ends], return_index=True, return_inverse=True)
    order = np.argsort(first)
    n, place = len(first), np.empty(len(first), np.int64)
    place[order] = np.arange(n)
    own, names = doc[ends[first[order]]], codes[ends[first[order]]]
    a, b = place[at.ravel()].reshape(-1, 2).T
    edge, count = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_counts=True)
    u, v = edge // n, edge % n
    w = count.astype(float) if weighted else np.ones(len(edge))
    apart = u != v
    src, dst, w = np.append(u, v[apart]), np.append(v, u[apart]), np.append(w, w[apart])
    rank = power_iterations(np.unique(own, return_counts=True)[1], lambda x: np.bincount(dst, w * x[src], n))
    best = np.lexsort((np.arange(n), -np.round(rank, 12), own))
    return own[best], names[best], rank[best]


def textrank_words(blocks: list[list[str]], window: int = 2, weighted: bool = False) -> list[tuple[str, float]]:
    """Words with their rank, best first, ties by first appearance."""
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for own in blocks for w in own], np.int64)
    _, got, rank = _ranked(codes, np.repeat(np.arange(len(blocks)), [len(x) for x in blocks]), np.zeros(len(codes), np.int64), window, weighted)
    names = list(known)
    return [(names[i], x) for i, x in zip(got.tolist(), rank.tolist())]


#: Words of short documents that are ranked at once.
RANKED_WORDS = 1 << 15


def textrank_blocks(docs: DataFrame, k: int, window: int = 2, weighted: bool = True) -> DataFrame:
    """``textrank`` of (doc_id, blocks), each document's words in their neighbourhoods: one narrow pass, no token is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks")
            sizes = pc.fill_null(pc.list_value_length(blocks), 0).to_numpy(zero_copy_only=False)
            inner = blocks.flatten()
            coded = inner.flatten().dictionary_encode()
            codes, long = coded.indices.to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
            block = np.repeat(np.arange(len(long)), long)
            doc = np.repeat(np.arange(len(sizes)), sizes)[block]
            ends = np.cumsum(np.bincount(doc, minlength=len(sizes)))
            start = 0
            while start < len(sizes):
                begin = int(ends[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(ends, begin + RANKED_WORDS, "right")))
                part = slice(begin, int(ends[end - 1]))
                own, words, score = _ranked(codes[part], block[part], doc[part], window, weighted)
                rank = np.arange(len(own)) - np.searchsorted(own, own)
                top = rank < k
                fields = [batch.column("doc_id").take(pa.array(own[top])), coded.dictionary.take(pa.array(words[top])), pa.array(score[top]), pa.array((rank[top] + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(fields, ["doc_id", "word", "score", "rank"])
                start = end
        freed()

    return docs.select("doc_id", "blocks").mapInArrow(run, f"doc_id {kind}, word string, score double, rank int")


def textrank(tokens: DataFrame, k: int, window: int = 2, weighted: bool = True, block: str | None = None) -> DataFrame:
    """doc_id, word, score, rank; a document is one task's numpy problem.  ``block``: column that separates word neighbourhoods.

    Token rows are brought together by a shuffle; where documents are at hand, ``textrank_blocks`` spares it."""
    slim = tokens.where("word is not null").select("doc_id", "pos", "word", (F.col(block) if block else F.lit(0)).cast("string").alias("block"))
    part = slim.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("x"))
    whole = part.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return textrank_blocks(whole.select("doc_id", F.transform("x", lambda b: b["word"]).alias("blocks")), k, window, weighted)


def extract(tokens: DataFrame, k: int, method: str = "jieba_tfidf", min_word_len: int = 2, allow_pos: list[str] | None = None, stopwords: DataFrame | Iterable[str] | None = None, idf: DataFrame | None = None, **options) -> DataFrame:
    """Dispatcher over tokens (doc_id, pos, word[, flag]); filters come before windows, so neighbours are neighbours after filtering."""
    if method not in ("jieba_tfidf", "tfidf", "textrank"):
        raise ValueError(f"unknown method {method!r}")
    own = filter_tokens(tokens, min_word_len, allow_pos, stopwords)
    return textrank(own, k, **options) if method == "textrank" else tfidf(own, k, idf, **options)


def evaluate(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Micro-averaged precision, recall and F1 of (doc_id, word) tables, each read once, in one shuffle."""
    both = found.select("doc_id", "word", F.lit(1).alias("f"), F.lit(0).alias("t")).unionAll(truth.select("doc_id", "word", F.lit(0), F.lit(1)))
    each = both.groupBy("doc_id", "word").agg(F.max("f").alias("f"), F.max("t").alias("t"))
    met = F.when(F.col("doc_id").isNotNull() & F.col("word").isNotNull(), F.col("f") * F.col("t"))
    n = each.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in (("h", met), ("f", F.col("f")), ("t", F.col("t")))))
    p, r = F.try_divide("h", "f"), F.try_divide("h", "t")
    return n.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def length_histogram(words: DataFrame) -> DataFrame:
    """length, n, cumulative share of words."""
    h = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"))
    w = W.orderBy("length")  # a row a length
    return h.select("length", "n", (F.sum("n").over(w) / F.sum("n").over(W.partitionBy())).alias("share"))
