from __future__ import annotations

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from textloom.llm import mixing as M
from textloom.llm.queries import BUDGET_SHARE, WEIGHTS


def brute(rows, weights, share, default=1.0, seed=M.SEED):
    """Virtual finish times source by source, then one sorted pass."""
    docs = []
    for i, text, source in rows:
        w = weights.get(source, default)
        if w > 0:
            h = hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
            n = len([x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x])
            docs.append((source, h, i, n, w))
    null_first = lambda x: (x is not None, x or 0)
    docs.sort(key=lambda d: (d[0] is not None, d[0] or "", d[1], null_first(d[2])))
    clock: Counter = Counter()
    timed = []
    for source, h, i, n, w in docs:
        clock[source] += n
        timed.append((clock[source] / w, source is not None, source or "", h, null_first(i), i, source, n))
    timed.sort(key=lambda t: t[:5])
    budget = math.floor(sum(t[7] for t in timed) * share)
    out, total = [], 0
    for t in timed:
        total += t[7]
        if total <= budget:
            out.append((t[5], t[6], t[7], t[0], total))
    return out


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("weights, share", [(WEIGHTS, BUDGET_SHARE), ({}, 0.3), ({"src0": 0.0, "src1": 5.0}, 1.0)])
def test_against_brute_force(documents, weights, share):
    want = brute(rows_of(documents), weights, share)
    got = [(r.doc_id, r.source, r.n_tokens, r.finish, r.mixed_tokens) for r in M.queue(documents, weights, share).collect()]
    assert sorted(got) == sorted(want)
    assert {r.doc_id for r in M.select(documents, weights, share).collect()} == {x[0] for x in want}


def test_sql(documents, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.execute(M.sql(WEIGHTS, BUDGET_SHARE)).fetchall()
    got = [tuple(r) for r in M.queue(documents, WEIGHTS, BUDGET_SHARE).collect()]
    assert sorted(got) == sorted(want)


def test_shares_follow_weights(spark):
    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.source for r in M.queue(df, {"s0": 3.0, "s1": 1.0}, 0.5).collect())
    assert got["s0"] / got["s1"] == pytest.approx(3, rel=0.01)
    assert sum(got.values()) == 2000


def test_messy_and_empty(messy, empty):
    rows = rows_of(messy)
    got = [(r.doc_id, r.source, r.n_tokens, r.finish, r.mixed_tokens) for r in M.queue(messy, WEIGHTS, 1.0).collect()]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows, WEIGHTS, 1.0), key=key)
    picked = M.select(messy, WEIGHTS, 1.0)
    assert picked.columns == messy.columns and picked.count() == len(rows)
    assert M.queue(empty, WEIGHTS, 0.5).count() == 0 and M.select(empty, WEIGHTS, 0.5).count() == 0


def test_cuts_without_a_broadcast(documents, monkeypatch):
    want = sorted(r.doc_id for r in M.select(documents, WEIGHTS, 0.4).collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(r.doc_id for r in M.select(documents, WEIGHTS, 0.4).collect()) == want


def test_ranges_stay_even_under_extreme_weights(spark):
    """One source of tiny weight stretches the finish times; ranges go by rank, so none is crowded."""
    rows = [(i, "w " * (1 + i % 7), "rare" if i % 50 == 0 else "usual") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = M.queue(df, {"rare": 1e-6}, 1.0).select("doc_id", "source", "n_tokens", "h", "finish")
    cut = M._running(docs, ["finish", "source", "h", "doc_id"], 4000, [], "t", 200)
    sizes = [r.n for r in cut.groupBy("slice").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) > 10 and max(sizes) < 2 * 4000 / len(sizes)
    got = M.queue(df, {"rare": 1e-6}, 1.0, slice_rows=200)
    assert sorted((r.doc_id, r.source, r.n_tokens, r.finish, r.mixed_tokens) for r in got.collect()) == sorted(brute(rows, {"rare": 1e-6}, 1.0))


def test_absolute_budget(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s") for i in range(100)], "doc_id long, text string, source string")
    assert M.queue(df, {}, budget_tokens=255).count() == 25 and M.select(df, {}, budget_tokens=255).count() == 25
