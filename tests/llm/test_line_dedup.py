from __future__ import annotations

from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import line_dedup as L


def brute(rows, min_docs):
    """(doc_id, text) -> text without the frequent lines that other documents own."""
    where = defaultdict(set)
    for i, t in rows:
        if t is not None and i is not None:
            for x in t.split("\n"):
                if x.strip(" \t\r"):
                    where[x.strip(" \t\r")].add(i)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        seen, keep = set(), []
        for raw in t.split("\n"):
            x = raw.strip(" \t\r")
            often = len(where.get(x, ())) >= min_docs
            if not x or x not in seen and (not often or min(where[x]) == i):
                keep.append(raw)
            seen.add(x)
        out.append((i, "\n".join(keep)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=400))
@settings(max_examples=60, deadline=None)
def test_perfect_hash_is_minimal_and_perfect(keys):
    keys = np.array(keys, np.uint64)
    ph = L.PerfectHash.build(keys)
    assert ph.n == len(keys)
    assert sorted(ph.index(keys).tolist()) == list(range(len(keys)))


def test_shard_round_trip_and_strangers():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 50_000, np.uint64)
    prints, counts, owners = rng.integers(0, 2**32, 50_000, np.uint32), rng.integers(1, 9, 50_000), rng.integers(-5, 10**12, 50_000)
    shard = L.Shard(L.pack_shard(keys, prints, counts, owners))
    n, o = shard.probe(keys, prints)
    assert (n == counts).all() and (o == owners).all()
    n, _ = shard.probe(rng.integers(2**63, 2**64 - 1, 50_000, np.uint64), prints)
    assert (n == 0).sum() > 49_990
    with pytest.raises(ValueError):
        L.PerfectHash.build(np.array([7, 7], np.uint64))


def test_hashes_equal_sparks(spark, messy):
    assert {r.s % 2**64 for r in spark.range(1).select(F.xxhash64(F.lit(1)).alias("s")).collect()} == {L.SEED2}
    for r in messy.select("text", F.xxhash64(F.lit(1), "text").alias("h"), F.xxhash64("text").alias("k")).where("text is not null").collect():
        assert xxhash.xxh64_intdigest(r.text.encode(), L.SEED2) == r.h % 2**64
        assert xxhash.xxh64_intdigest(r.text.encode(), 42) == r.k % 2**64


@pytest.mark.parametrize("min_docs, shard_keys", [(2, 64), (8, 64), (L.MIN_DOCS, L.SHARD_KEYS)])
def test_against_brute_force(documents, texts, min_docs, shard_keys):
    shards = L.build(documents, shard_keys=shard_keys)
    assert (shards.bits > 1) == (shard_keys == 64)
    got = L.clean(documents, shards, min_docs=min_docs)
    assert got.columns == documents.columns
    assert ordered((r.doc_id, r.text) for r in got.collect()) == ordered(brute(list(texts.items()), min_docs))


def test_sql(documents, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    got = L.clean(documents, L.build(documents), report=True)
    assert ordered(map(tuple, got.collect())) == ordered(con.execute(L.sql()).fetchall())


def test_messy_and_empty(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    for min_docs in (2, 3):
        got = L.clean(messy, L.build(messy), min_docs=min_docs)
        assert got.columns == messy.columns
        assert ordered((r.doc_id, r.text) for r in got.collect()) == ordered(brute(rows, min_docs))
    assert L.clean(empty, L.build(empty)).count() == 0


def test_owner_is_the_smallest_id_and_ties_do_not_matter(spark):
    rows = [(i, f"own {i}\nboilerplate\n\tboilerplate  ") for i in range(30, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in L.clean(df, L.build(df)).collect()}
    assert got.pop(1) == "own 1\nboilerplate"
    assert got == {i: f"own {i}" for i in range(2, 31)}


def test_long_lines_go_at_every_repeat(spark):
    """Shared by two documents, in rows without id; within one document every line goes; short lines keep the rule of min_docs."""
    long, other, han = "a passage of five words", "words that one text repeats", "汉字没有空格"
    rows = [
        (3, f"head 3\n{long}\nshort one"),
        (1, f"head 1\n{long}\nshort one\nshort one"),
        (2, f"{other}\nhead 2\n\t{other}  \n{other}\n{han}"),
        (4, f"{han}\nhead 4\nonly here is this line"),
        (None, f"{long}\nhead n\nnobody owns these five words\nnobody owns these five words"),
        (5, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in L.clean(df, L.build(df), min_docs=8, long_words=L.LONG_WORDS).collect()}
    assert got == {
        1: f"head 1\n{long}\nshort one",
        2: f"{other}\nhead 2\n{han}",
        3: "head 3\nshort one",
        4: "head 4\nonly here is this line",
        None: "head n\nnobody owns these five words",
        5: None,
    }


def test_pipeline_removes_every_repeat_of_a_long_line(spark, documents):
    import corpus_pipeline

    seen = defaultdict(int)
    for r in corpus_pipeline.near(spark, corpus_pipeline.lines(spark, documents, ""), "").select("text").collect():
        for x in r.text.split("\n"):
            if L.is_long(L.trimmed(x), L.LONG_WORDS):
                seen[L.trimmed(x)] += 1
    assert seen and max(seen.values()) == 1
