"""Texts longer than a window or block give what one window gives."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa

from textloom.operators import graph, linking, newword
from textloom.operators.lexicon import Lexicon

TEXTS = ["ab cabba 甲乙abc " * 9, "x", "", " ", "abcabcabc甲乙丙" * 7, "nul\0\0x nul\0"]


def test_links_across_windows(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    lex = Lexicon().add_typed_words({"t": ["abc", "甲乙", "ca", "乙丙a"]})
    want = sorted(map(tuple, linking.links_table(df, lex).collect()))
    for size in (64, 1, 5, 16):
        for keys in (0, 20_000):
            monkeypatch.setattr(linking, "PAGE", 3 * size)
            monkeypatch.setattr(linking, "WINDOW", size)
            monkeypatch.setattr(linking, "KEYS", keys)
            assert sorted(map(tuple, linking.link_by_join(df, lex.joined_df(spark)).collect())) == want


def counted(rows, *columns):
    out = Counter()
    for batch in rows:
        for r in batch.to_pylist():
            out[tuple(r[c] for c in columns[:-1])] += r[columns[-1]]
    return out


def test_grams_and_neighbours_across_blocks(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    pieces = newword.normalised(df, r"[^\p{L}\x{0}]+")
    rows = pieces.orderBy("doc_id").select("t", "is_first", "is_last").toArrow()
    text = "".join(rows["t"].to_pylist())
    grams, near = Counter(), Counter()
    for p in range(len(text)):
        for k in (1, 2, 3):
            g = text[p : p + k]
            if len(g) == k and " " not in g:
                grams[(g,)] += 1
                if p:
                    near[g, "left", text[p - 1]] += 1
                if p + k < len(text):
                    near[g, "right", text[p + k]] += 1
    words = spark.createDataFrame(list(grams), "text string")
    assert {(r.text,): r.n for r in newword.gram_counts(pieces, 3).collect()} == grams
    for probes in (0, 10**6):
        monkeypatch.setattr(newword, "PROBES", probes)
        assert {(r.text, r.side, r.near): r.c for r in newword.neighbour_counts(pieces, words).collect()} == near
    known = {k: newword.known_hashes([g for (g,) in grams if len(g) == k]) for k in (1, 2, 3)}
    for size in (1 << 21, 40, 16, 3, 1):  # blocks of texts, and parts of one
        monkeypatch.setattr(newword, "CHUNK_CHARS", size)
        assert counted(newword.gram_rows(rows.to_batches(), 3), "text", "n") == grams
        for keys in (None, known):
            assert counted(newword.neighbour_rows(rows.to_batches(), 3, keys), "text", "side", "near", "c") == near


def test_pairs_of_large_sets(monkeypatch):
    rng = random.Random(1)
    sets = [sorted(rng.sample("abcdefghijklmnopqrst", rng.randint(0, 20))) for _ in range(30)] + [[]]
    want = Counter((u, v) for s in sets for i, u in enumerate(s) for v in s[i + 1 :])
    batch = pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string()))], ["s"])
    for size in (1 << 21, 50, 7, 1):
        monkeypatch.setattr(graph, "PAIRS", size)
        assert counted(graph._pairs(iter([batch, batch.slice(3, 2), batch.slice(0, 0)])), "u", "v", "n") == want + Counter((u, v) for s in sets[3:5] for i, u in enumerate(s) for v in s[i + 1 :])
