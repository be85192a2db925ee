"""Substring dedup by hashing normalised units of text.

Units tile a text: a paragraph or line ends with its line feeds
(``unit='line'``), a sentence also with its run of ``. ! ?``
(``unit='sentence'``, the default: copied passages start and end inside lines).
A unit is normalised to its words (runs of ASCII letters and digits and of
non-ASCII characters, ASCII letters lower-cased) and digested to 128 bits.
Digests are grouped globally by one range sort; the occurrence of smallest
(doc_id, start) stays.
Neighbouring units that occur earlier make a run; removed are runs of at least
``MIN_WORDS`` words in units of at least ``UNIT_WORDS`` words and any run of at
least ``LONG_RUN`` words, so that stray short sentences, which repeat by
chance, stay.  Offsets of removed spans are code points of the original text.

Defined results: null texts and null ids have no units; empty texts and units
without words are never repeats, though a wordless unit inside a run goes with
it.  Rows that share an id and start are the same occurrence, so repeated rows lose
nothing to each other.  Repeats inside one document count.  Very long texts
count whole.  Ties don't exist: (doc_id, start) orders all occurrences.  An empty
table has no spans.  Ids are whole numbers (a ``TypeError`` at call time else).
Columns are taken by exact name and others, whatever they are called, ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS, UNIT_WORDS, LONG_RUN = 20, 4, 50
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _GAP[_a:_b] = False
_END = {"line": np.zeros(256, bool), "sentence": np.zeros(256, bool)}
_END["line"][10] = True
_END["sentence"][[10, 33, 46, 63]] = True


def unit_table(offsets: np.ndarray, data: np.ndarray, unit: str = "sentence") -> dict[str, np.ndarray]:
    """Units with a word: doc, place among them, start and end in code points, words, digest."""
    stop = _END[unit][data]
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = stop[:-1] & ~stop[1:] if len(data) else False
    begin[offsets[:-1]] = True
    begin[-1] = True
    edge = np.flatnonzero(begin)
    ustart, uend = edge[:-1], edge[1:]
    start, end, _ = C.spans(offsets, _GAP[data])
    word = C.span_hash(_FOLD[data], start, end, C.BASE)
    a, b = np.searchsorted(start, ustart), np.searchsorted(start, uend)
    some = b > a
    ustart, uend, a, b = ustart[some], uend[some], a[some], b[some]
    doc = np.searchsorted(offsets, ustart, "right") - 1
    chars = C.char_index(data)
    zero = chars[offsets[doc]]
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    return {
        "doc": doc, "place": place, "start": chars[ustart] - zero, "end": chars[uend] - zero, "words": b - a,
        "h1": C.span_hash(word, a, b, C.QBASE).view(np.int64), "h2": C.span_hash(word, a, b, C.PBASE | np.uint64(1)).view(np.int64),
    }


def units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence") -> DataFrame:
    slim = C.narrow(df, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null")
    slim = slim.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, place int, start int, end int, words int, h1 long, h2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch):
                got = unit_table(*C.string_buffers(part.column("text")), unit)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(got["doc"])), *(pa.array(got[c].astype(np.int32)) for c in ("place", "start", "end", "words")), pa.array(got["h1"]), pa.array(got["h2"])],
                    ["doc_id", "place", "start", "end", "words", "h1", "h2"],
                )

    return slim.mapInArrow(C.tidy(run), schema)


OCCURRENCE = "h1 long, h2 long, doc_id long, start int, place int, end int, words int"
REPEAT = "h1 long, h2 long, doc_id long, start int, place int, end int, words int, kind int, keeper_id long, keeper_start int"
#: Kinds of rows that a sorted range gives: a repeat with its keeper; an occurrence of the range's first digest, whose
#: keeper may be in an earlier range; the first occurrence of its first and of its last digest.
FOUND, OPEN, EDGE = 0, 1, 2


def _in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of a range of occurrences sorted by digest, id and start; holds one batch at a time."""
    opening = keeper = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, start = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc_id", "start"))
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        if last == (h1[0], h2[0]):
            new[0] = False
        else:
            keeper = (doc[0], start[0])
        if opening is None:
            opening = (h1[0], h2[0])
            yield _rows(batch, np.array([0]), EDGE, doc[:1], start[:1])
        # the place of each row's first occurrence, -1: in an earlier batch
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        kd, ks = np.where(first < 0, keeper[0], doc[first]), np.where(first < 0, keeper[1], start[first])
        early = (h1 == opening[0]) & (h2 == opening[1])
        yield _rows(batch, np.flatnonzero(early), OPEN, kd[early], ks[early])
        again = ~early & ~new & ((doc > kd) | (doc == kd) & (start > ks))
        yield _rows(batch, np.flatnonzero(again), FOUND, kd[again], ks[again])
        keeper, last = (kd[-1], ks[-1]), (h1[-1], h2[-1])
        tail = batch.slice(batch.num_rows - 1)
    if last is not None:
        yield _rows(tail, np.array([0]), EDGE, np.array([keeper[0]]), np.array([keeper[1]]))


def _rows(batch: pa.RecordBatch, at: np.ndarray, kind: int, keeper_id: np.ndarray, keeper_start: np.ndarray) -> pa.RecordBatch:
    own = batch.take(pa.array(at, pa.int64()))
    more = [pa.array(np.full(len(at), kind, np.int32)), pa.array(keeper_id.astype(np.int64)), pa.array(keeper_start.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*own.columns, *more], [*own.schema.names, "kind", "keeper_id", "keeper_start"])


def again(every: DataFrame) -> DataFrame:
    """Occurrences of units after the first of their digest: doc_id, place, start, end, words, first.

    One range shuffle by (digest, id, start), which cuts through a digest of any
    number of occurrences; what a cut separates is settled by the first and last
    digest of each range, two rows a range.
    """
    order = ["h1", "h2", "doc_id", "start"]
    names = [c.split()[0] for c in OCCURRENCE.split(", ")]
    ranged = every.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = C.settle(ranged.mapInArrow(C.tidy(_in_ranges), REPEAT), "repeats")
    edges = rows.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min(F.struct(F.col("keeper_id").alias("doc_id"), F.col("keeper_start").alias("start"))).alias("first"))
    late = rows.where(F.col("kind") == OPEN).join(C.checked(edges, "range-edges"), ["h1", "h2"]).where(F.struct("doc_id", "start") > F.col("first"))
    found = rows.where(F.col("kind") == FOUND).withColumn("first", F.struct(F.col("keeper_id").alias("doc_id"), F.col("keeper_start").alias("start")))
    keep = ["doc_id", "place", "start", "end", "words", "first"]
    return found.select(*keep).union(late.select(*keep))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS, unit_words: int = UNIT_WORDS, long_run: int = LONG_RUN) -> DataFrame:
    """Spans to remove: doc_id, start, end, words, keeper_id, keeper_start."""
    C.whole_id(df, id_col)
    every = C.settle(units(df, id_col, text_col, unit), "units")
    repeated = again(every).withColumn("island", F.col("place") - F.dense_rank().over(W.partitionBy("doc_id").orderBy("place")))
    one = repeated.groupBy("doc_id", "island", "place").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("words").alias("words"), F.min("first").alias("first"))
    run = one.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.sum(F.when(F.col("words") >= unit_words, F.col("words")).otherwise(0)).alias("solid"), F.min_by("first", "place").alias("first"))
    return run.where((F.col("solid") >= min_words) | (F.col("words") >= long_run)).select("doc_id", "start", "end", "words", F.col("first.doc_id").alias("keeper_id"), F.col("first.start").alias("keeper_start"))


def cut(text: str, removed: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in removed:
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def remove(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that lose something: doc_id, text (what stays), removed (spans with original offsets)."""
    C.whole_id(df, id_col)
    slim = C.narrow(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    spans, few = C.measured(spans, "spans")
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "words", "keeper_id", "keeper_start"))).alias("removed"))
    joined = slim.join(F.broadcast(lists) if few else lists.hint("merge"), "doc_id")  # with few spans no text is shuffled
    schema = "doc_id long, text string, removed array<struct<start:int,end:int,words:long,keeper_id:long,keeper_start:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("removed")
            flat = col.flatten()
            a, b = flat.field("start").to_pylist(), flat.field("end").to_pylist()
            sizes = col.value_lengths().to_pylist()
            out, k = [], 0
            for text, n in zip(batch.column("text").to_pylist(), sizes):
                out.append(None if text is None else cut(text, list(zip(a[k : k + n], b[k : k + n]))))
                k += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), col], ["doc_id", "text", "removed"])

    return joined.select("doc_id", "text", "removed").mapInArrow(C.tidy(run), schema)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS, unit_words: int = UNIT_WORDS, long_run: int = LONG_RUN) -> DataFrame:
    """Documents with repeated passages: what stays of them and what was removed where."""
    return remove(df, repeats(df, id_col, text_col, unit, min_words, unit_words, long_run), id_col, text_col)


def sql(table: str = "documents", min_words: int = MIN_WORDS, unit_words: int = UNIT_WORDS, long_run: int = LONG_RUN) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with u as (select doc_id, unnest(u) as raw, unnest(range(1, len(u) + 1)) as i
           from (select doc_id, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+') as u from {table} where text is not null)),
o as (select doc_id, i, raw, (sum(length(raw)) over w - length(raw))::bigint as "start", (sum(length(raw)) over w)::bigint as "end",
        trim(regexp_replace(translate(raw, '{upper}', '{lower}'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' ') as norm
      from u window w as (partition by doc_id order by i rows unbounded preceding)),
p as (select *, len(string_split(norm, ' ')) as words, row_number() over (partition by doc_id order by i) as place from o where norm <> ''),
f as (select *, first_value(doc_id) over g as kd, first_value("start") over g as ks from p window g as (partition by norm order by doc_id, "start")),
r as (select *, place - row_number() over (partition by doc_id order by place) as island from f where doc_id <> kd or "start" <> ks),
s as (select doc_id, min("start") as "start", max("end") as "end", sum(words)::bigint as words, arg_min(kd, place) as keeper_id, arg_min(ks, place) as keeper_start
      from r group by doc_id, island having sum(case when words >= {unit_words} then words else 0 end) >= {min_words} or sum(words) >= {long_run})
select doc_id, "start"::integer as "start", "end"::integer as "end", words, keeper_id, keeper_start::integer as keeper_start from s"""
