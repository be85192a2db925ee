from __future__ import annotations

import re

import pytest

from textloom.llm import quality_rules as Q


def brute(text, lengths=tuple(Q.NGRAM_LIMITS)):
    text = text or ""
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    total = sum(map(len, words))
    out = {"n_words": len(words), "n_word_chars": total}
    for n in lengths:
        seen, inside = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                inside |= set(range(i, i + n))
            seen.add(g)
        out[f"dup_{n}gram_share"] = sum(len(words[i]) for i in inside) / max(total, 1)
    lines = [x for x in (x.strip(" \t\x0b\f\r") for x in text.split("\n")) if x]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out["n_lines"] = len(lines)
    out["dup_line_share"] = len(again) / max(len(lines), 1)
    out["dup_line_char_share"] = sum(map(len, again)) / max(sum(map(len, lines)), 1)
    out["keep"] = out["dup_line_char_share"] <= Q.LINE_CHAR_LIMIT and all(out[f"dup_{n}gram_share"] <= v for n, v in Q.NGRAM_LIMITS.items())
    return out


def same(row, want):
    for k, v in want.items():
        assert row[k] == pytest.approx(v, abs=1e-12), (k, row[k], v)


def test_against_brute_force(documents, texts):
    got = Q.score(documents).collect()
    assert len(got) == len(texts)
    for r in got:
        same(r, brute(texts[r.doc_id]))


def test_repeats_and_clean_text(spark):
    spam = "buy cheap pills online now today " * 30
    lines = "the same line\n" * 20
    rows = [(1, spam), (2, lines), (3, " ".join(f"word{i}" for i in range(300)))]
    got = {r.doc_id: r for r in Q.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        same(got[i], brute(t))
    assert [got[i].keep for i in (1, 2, 3)] == [False, False, True]


def test_messy_and_empty(messy, empty):
    got = sorted(Q.score(messy).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    by = {r.doc_id: r for r in got}
    for i in (2, 3, 4):
        assert (by[i].n_words, by[i].n_lines, by[i].keep, by[i].dup_5gram_share) == (0, 0, True, 0.0)
    same(by[1], brute("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu\nshared line of all\n" + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".upper()))
    assert by[7].n_word_chars == 3_070_000
    assert Q.score(empty).count() == 0
