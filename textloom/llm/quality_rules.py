"""Repetition coverage: how much of a document lies inside repeated n-grams and lines.

Word hashes come from one polynomial prefix sum over the UTF-8 bytes of an
Arrow chunk; n-gram hashes roll from one length to the next.  An n-gram can
only repeat where its prefix repeats, so each longer length looks at the
positions that the shorter one left.

Defined results: words are runs of bytes other than ASCII white space; lines
are separated by line feeds, trimmed of ASCII white space, blank ones ignored.
Repeats are occurrences after the first in the same document.  Null and empty
texts have zero counts, shares of 0.0 and are kept (nothing repeats in them).
Very long texts are measured whole.  Repeated rows are scored row by row, so there
are no ties; a null doc_id stays null.  An empty table gives an empty result.
Columns are taken by exact name and others, whatever they are called, ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: n-gram length -> largest share of word characters inside repeated n-grams.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of line characters inside repeated lines (the share of lines is only reported).
LINE_CHAR_LIMIT = 0.30


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of occurrences after the first, and of all members of repeated groups."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    later = order[1:][same]
    member = np.zeros(len(keys), bool)
    member[later] = True
    member[order[:-1][same]] = True
    return later, np.flatnonzero(member)


def measure(offsets: np.ndarray, data: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    start, end, doc = C.words_of(offsets, data)
    chars = C.char_index(data)
    width = chars[end] - chars[start]
    total = C.per_doc(doc, n, width)
    word = C.span_hash(data, start, end, C.BASE)
    out = {"n_words": C.per_doc(doc, n), "n_word_chars": total}
    salt = C.mix(np.arange(1, n + 1, dtype=np.uint64) * C.QBASE)
    left, rolled, size = np.arange(len(word)), word, 1
    with np.errstate(over="ignore"):
        for length in sorted(lengths):
            while size < length:
                m = max(0, len(word) - size)
                rolled = rolled[:m] * C.PBASE + word[size : size + m]
                size += 1
            left = left[left + length <= len(word)]
            left = left[doc[left] == doc[left + length - 1]]
            later, member = _repeats(C.mix(rolled[left]) ^ salt[doc[left]])
            step = np.zeros(len(word) + 1, np.int64)
            np.add.at(step, left[later], 1)
            np.add.at(step, left[later] + length, -1)
            inside = np.cumsum(step[:-1]) > 0
            covered = C.per_doc(doc[inside], n, width[inside])
            out[f"dup_{length}gram_share"] = covered / np.maximum(total, 1)
            left = left[member]
    # lines: from the first to the last word between line feeds
    first = np.ones(len(start), bool)
    if len(start):
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        first[1:] = (doc[1:] != doc[:-1]) | (feeds[start[1:]] != feeds[start[:-1]])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(start)) - 1 if len(at) else at
    ls, le, ld = start[at], end[last], doc[at]
    lw = chars[le] - chars[ls]
    later, _ = _repeats(C.span_hash(data, ls, le, C.QBASE) ^ salt[ld])
    lines, line_chars = C.per_doc(ld, n), C.per_doc(ld, n, lw)
    out["n_lines"] = lines
    out["dup_line_share"] = C.per_doc(ld[later], n) / np.maximum(lines, 1)
    out["dup_line_char_share"] = C.per_doc(ld[later], n, lw[later]) / np.maximum(line_chars, 1)
    return out


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None) -> DataFrame:
    """One row a document: counts, shares, and ``keep`` where no share passes its limit."""
    limits = NGRAM_LIMITS if limits is None else limits
    lengths = tuple(sorted(limits))
    slim = C.narrow(df, doc_id=id_col, text=text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "n_word_chars", "n_lines", "dup_line_share", "dup_line_char_share", *(f"dup_{k}gram_share" for k in lengths)]
    schema = f"doc_id {kind}, " + ", ".join(f"{x} {'double' if x.endswith('share') else 'long'}" for x in names) + ", keep boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch):
                got = measure(*C.string_buffers(part.column("text")), lengths)
                keep = got["dup_line_char_share"] <= LINE_CHAR_LIMIT
                for k in lengths:
                    keep &= got[f"dup_{k}gram_share"] <= limits[k]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[x]) for x in names), pa.array(keep)], ["doc_id", *names, "keep"])

    return slim.mapInArrow(C.tidy(run), schema)


def sql(table: str = "documents", limits: dict[int, float] | None = None) -> str:
    limits = NGRAM_LIMITS if limits is None else limits
    lengths = sorted(limits)
    ahead = ", ".join(f"lead(word, {k}) over o as w{k}" for k in range(1, max(lengths)))
    gram = lambda n: f"case when w{n - 1} is not null then concat_ws(' ', word, {', '.join(f'w{k}' for k in range(1, n))}) end"
    again = ", ".join(f"{gram(n)} is not null and row_number() over (partition by doc_id, {gram(n)} order by i) > 1 as a{n}" for n in lengths)
    inside = ", ".join(f"max(a{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as c{n}" for n in lengths)
    each = ", ".join(f"coalesce(sum(width) filter (where c{n}), 0) as s{n}" for n in lengths)
    test = " and ".join(f"coalesce(s{n} / total, 0) <= {v}" for n, v in sorted(limits.items()))
    return f"""
with p as (select doc_id, word, length(word) as width, i
           from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i
                 from (select doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+') as words from {table}))),
q as (select doc_id, i, regexp_replace(raw, '^[ \\t\\x0b\\f\\r]+|[ \\t\\x0b\\f\\r]+$', '', 'g') as line
      from (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as i from {table})),
h as (select doc_id, i, word, width, {ahead} from p window o as (partition by doc_id order by i)),
g as (select doc_id, i, width, {again} from h),
c as (select doc_id, width, {inside} from g),
s as (select doc_id, count(*) as n_words, sum(width) as total, {each} from c group by doc_id),
l as (select doc_id, length(line) as width, row_number() over (partition by doc_id, line order by i) > 1 as again from q where line <> ''),
m as (select doc_id, count(*) as n_lines, count(*) filter (where again) / count(*) as dl, coalesce(sum(width) filter (where again), 0) / sum(width) as dc from l group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(total, 0)::bigint as n_word_chars, coalesce(n_lines, 0)::bigint as n_lines,
  coalesce(dl, 0)::double as dup_line_share, coalesce(dc, 0)::double as dup_line_char_share,
  {", ".join(f"coalesce(s{n} / total, 0)::double as dup_{n}gram_share" for n in lengths)},
  coalesce(dc, 0) <= {LINE_CHAR_LIMIT} and {test} as keep
from {table} d left join s using (doc_id) left join m using (doc_id)"""
