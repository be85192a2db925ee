from __future__ import annotations

import re
from collections import defaultdict

import duckdb

from textloom.llm import passage_dedup as P


def unit_list(text, unit="sentence"):
    """(start, end, normal form, words) of units with a word."""
    pattern = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+" if unit == "sentence" else r"[^\n]*\n+|[^\n]+"
    out = []
    for m in re.finditer(pattern, text or ""):
        folded = "".join(c.lower() if c.isascii() else c for c in m.group())
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", folded)
        if words:
            out.append((m.start(), m.end(), " ".join(words), len(words)))
    return out


def brute(rows, unit="sentence", min_words=P.MIN_WORDS, unit_words=P.UNIT_WORDS):
    first = {}
    units = {i: unit_list(t, unit) for i, t in rows if i is not None and t is not None}
    for i in sorted(units):
        for a, _, norm, _ in units[i]:
            first.setdefault(norm, (i, a))
    out = []
    for i, us in units.items():
        run = []
        for u in [*us, None]:
            if u is not None and first[u[2]] != (i, u[0]):
                run.append(u)
                continue
            if sum(x[3] for x in run if x[3] >= unit_words) >= min_words or sum(x[3] for x in run) >= P.LONG_RUN:
                out.append((i, run[0][0], run[-1][1], sum(x[3] for x in run), *first[run[0][2]]))
            run = []
    return sorted(out)


def test_against_brute_force(documents, texts):
    for unit in ("sentence", "line"):
        got = sorted(tuple(r) for r in P.repeats(documents, unit=unit).collect())
        assert got == brute(list(texts.items()), unit)
        assert got


def test_offsets_point_into_the_original(documents, texts):
    spans = defaultdict(list)
    for r in brute(list(texts.items())):
        spans[r[0]].append(r)
    got = P.dedup(documents).collect()
    assert {r.doc_id for r in got} == set(spans)
    for r in got:
        want, at = "", 0
        for s in sorted(spans[r.doc_id]):
            want += texts[r.doc_id][at : s[1]]
            at = s[2]
        assert r.text == want + texts[r.doc_id][at:]
        assert [tuple(x) for x in r.removed] == sorted(s[1:] for s in spans[r.doc_id])
        for x in r.removed:
            gone = {u[2] for u in unit_list(texts[r.doc_id][x.start : x.end])}
            assert unit_list(texts[x.keeper_id][x.keeper_start :])[0][2] in gone


def test_planted_passage(spark):
    passage = " ".join(f"Planted word number {i} stands here." for i in range(12))
    rows = [(i, f"Opening {i} of a document. {passage} Closing {i} words.") for i in range(1, 6)] + [(9, "Nothing to see here at all. Move on now.")]
    got = {r.doc_id: r for r in P.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2, 3, 4, 5}
    for i, r in got.items():
        assert r.text == f"Opening {i} of a document. Closing {i} words."
        assert [x.keeper_id for x in r.removed] == [1]


def test_sql(documents, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    assert sorted(tuple(r) for r in P.repeats(documents).collect()) == sorted(con.execute(P.sql()).fetchall())


def test_messy_and_empty(messy, empty):
    rows = sorted({(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect() if r.doc_id is not None})
    got = sorted(tuple(r) for r in P.repeats(messy, min_words=4).collect())
    assert got == brute(rows, min_words=4) and got
    # both rows that share an id lose the span
    assert sorted(r.doc_id for r in P.dedup(messy, min_words=4).collect()) == sorted([5, 5, 6, 9, 1])
    assert P.repeats(empty).count() == 0 and P.dedup(empty).count() == 0


def test_ranges_may_cut_through_a_digest(spark):
    """A digest of a third of all rows spreads over many ranges; keepers are those of the whole table."""
    hot = "this sentence is in every third document and has more than twenty words so that it counts as a passage to be removed at once now."
    rows = [(i, hot if i % 3 == 0 else f"own text {i}.") for i in range(600)]
    every = P.units(spark.createDataFrame(rows, "doc_id long, text string"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in (("spark.sql.shuffle.partitions", "37"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        got = sorted((r.doc_id, r.start, r.first.doc_id) for r in P.again(every).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == [(i, 0, 0) for i in range(3, 600, 3)]
