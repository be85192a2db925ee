"""Queries that SQL can't express, over whole tables against plain Python."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from textloom.operators import graph
from textloom.plans import catalogue, catalogue_more

WORD = re.compile(r"[^\W_]+")
STOP = set(catalogue.STOP)


@pytest.fixture(scope="module")
def run(spark, data):
    return lambda name: catalogue.QUERIES[name](spark, data).collect()


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def talks(spark, data):
    out = defaultdict(list)
    for r in spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect():
        out[r.conv_id].append((r.turn, r.text))
    return out


def words(text):
    return WORD.findall((text or "").lower())


def rank(near, n, rounds=100):
    """Power iteration over dictionaries of weights."""
    x = [1 / n] * n
    out = [sum(near[i].values()) for i in range(n)]
    for _ in range(rounds):
        last, x = x, [0.15 / n] * n
        lost = 0.85 * sum(v for v, o in zip(last, out) if o < 1e-12) / n
        for i in range(n):
            x[i] += lost
            if out[i] >= 1e-12:
                for j, w in near[i].items():
                    x[j] += 0.85 * last[i] * w / out[i]
        if sum(abs(a - b) for a, b in zip(x, last)) < n * 1e-6:
            break
    return x


def textrank(blocks):
    near, order = defaultdict(Counter), {}
    for b in blocks:
        for u, v in zip(b, b[1:]):
            i, j = order.setdefault(u, len(order)), order.setdefault(v, len(order))
            near[i][j] += 1
            if i != j:
                near[j][i] += 1
    return {w: r for (w, _), r in zip(order.items(), rank(near, len(order)))} if order else {}


def same_top(rows, want, k):
    """The k best words, ties apart."""
    assert len(rows) == min(k, len(want))
    best = sorted(want.values(), reverse=True)
    for r, value in zip(sorted(rows, key=lambda r: r.rank), best):
        assert r.score == pytest.approx(value, abs=1e-5) and want[r.word] == pytest.approx(value, abs=1e-5)


def by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_textrank(run, texts):
    got = by(run("textrank_topk"), "doc_id")
    for d, t in texts.items():
        same_top(got[d], textrank([[w for w in words(t) if len(w) >= 2 and w not in STOP]]), 5)


def test_textrank_within_sentences(run, texts):
    got = by(run("textrank_sentences"), "doc_id")
    for d, t in texts.items():
        sents = re.sub(r"([.!?]['\"”’)\]]*)[ \t\n\x0b\f\r]+", "\\1\0", t or "").split("\0")
        same_top(got[d], textrank([[w for w in words(s) if len(w) >= 2 and w not in STOP] for s in sents]), 5)


def cut(text):
    """English sentences, trimmed."""
    return [s for s in (x.strip(" \t\n\x0b\f\r") for x in re.sub(r"([.!?]['\"”’)\]]*)[ \t\n\x0b\f\r]+", "\\1\0", text or "").split("\0")) if s]


def overlap(a, b):
    return len(set(a) & set(b)) / (math.log2(len(a)) + math.log2(len(b))) if len(a) > 1 and len(b) > 1 else 0.0


def importance(sents, sim):
    near = defaultdict(Counter)
    for i in range(len(sents)):
        for j in range(i + 1, len(sents)):
            if w := sim(sents[i], sents[j]):
                near[i][j] = near[j][i] = w
    return rank(near, len(sents))


def fast_importance(sents):
    """``importance`` by overlap, pairs found through their shared words."""
    near, where = defaultdict(Counter), defaultdict(list)
    for i, s in enumerate(sents):
        for w in set(s) if len(s) > 1 else ():
            for j in where[w]:
                near[i][j] += 1
            where[w].append(i)
    out = defaultdict(Counter)
    for i, row in near.items():
        for j, n in row.items():
            out[i][j] = out[j][i] = n / (math.log2(len(sents[i])) + math.log2(len(sents[j])))
    return rank(out, len(sents))


@pytest.mark.parametrize("name, k, maxlen", [("summary_topk", 3, 2000), ("summary_custom", 2, math.inf)])
def test_summaries(run, talks, texts, name, k, maxlen):
    groups = talks if name == "summary_custom" else {d: list(enumerate(cut(t))) for d, t in texts.items()}
    got = by(run(name), "conv_id" if name == "summary_custom" else "doc_id")
    for c, turns in groups.items():
        own = [(n, t, words(t)) for n, t in turns if words(t)]
        if name == "summary_custom":
            own = [(n, t, [w[:5] for w in ws]) for n, t, ws in own]
        value = fast_importance([x[2] for x in own]) if name == "summary_topk" else importance([x[2] for x in own], catalogue_more._shared_words)
        used, want = 0, []
        for i in sorted(range(len(own)), key=lambda i: -round(value[i], 9))[:k]:
            used += len(own[i][1])
            if used > maxlen:
                break
            want.append(value[i])
        rows = sorted(got[c], key=lambda r: r["rank"])
        assert [r.importance for r in rows] == pytest.approx(want, abs=1e-5)
        assert len({r.sent_id for r in rows}) == len(rows) and all(r.text == dict(turns)[r.sent_id] for r in rows)


def test_mmr_never_repeats_a_sentence(run, texts):
    """Greedy choice by importance and distance to what was said, for documents of up to 40 sentences."""
    got, seen = by(run("mmr_summary"), "doc_id"), 0
    for d, t in texts.items():
        sents = [s.strip(" \t\n\x0b\f\r") for s in re.sub(r"([.!?]['\"”’)\]]*)[ \t\n\x0b\f\r]+", "\\1\0", t or "").split("\0")]
        own = [w for w in map(words, filter(None, sents)) if w]
        if not 3 < len(own) <= 40:
            continue
        value = importance(own, overlap)

        def cos(a, b):
            x, y = Counter(a), Counter(b)
            norm = lambda c: math.sqrt(sum(v * v for v in c.values())) + 1e-5
            return sum(v * y[w] for w, v in x.items()) / norm(x) / norm(y)

        rows = sorted(got[d], key=lambda r: r["rank"])
        said, left = [], list(range(len(own)))
        for step, r in enumerate(rows):
            top = max(value[i] for i in left)
            e = {i: math.exp(value[i] - top) for i in left}
            score = {i: (value[i] if not step else 0.6 * e[i] / sum(e.values()) - 0.4 * cos(said, own[i])) for i in left}
            mine = [i for i in left if words(r.text) == own[i]]
            assert mine and max(score[i] for i in mine) == pytest.approx(max(score.values()), abs=1e-5)
            left.remove(mine[0])
            said += own[mine[0]]
        seen += 1
    assert seen > 20


def test_html_entities(run, spark, data):
    want = {r.page_id: html.unescape(r.html) for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert {r.page_id: r.cleaned for r in run("clean_html_unescape")} == want


def test_communities_have_no_better_move(run):
    part = {r.node: r.community for r in run("entity_communities")}
    edges = [(r.u, r.v, r.weight) for r in run("entity_graph")]
    assert {x for u, v, _ in edges for x in (u, v)} <= set(part)
    total = sum(w for _, _, w in edges)
    degree = Counter()
    for u, v, w in edges:
        degree[u] += w
        degree[v] += w

    def quality(p):
        inside, mass = Counter(), Counter()
        for u, v, w in edges:
            inside[p[u]] += w * (p[u] == p[v])
        for x, d in degree.items():
            mass[p[x]] += d
        return sum(inside[c] / total - (mass[c] / 2 / total) ** 2 for c in set(p.values()))

    best = quality(part)
    assert all(quality(part | {x: c}) <= best + 1e-9 for x in part for c in [*set(part.values()), x])


def longest_at(text, p, known):
    return max((m for m in known if text.startswith(m, p)), key=len, default=None)


def test_frequent_entities_decide(run, texts):
    lex = catalogue.AMBIGUOUS
    known = lex.candidates()
    for r in run("link_freq"):
        count = Counter({e: 2 for e, t in lex.types.items() if t == "ending"})

        def choose(m):
            best = max(known[m], key=lambda c: count[c[0]])  # noqa: B023
            count[best[0]] += 1  # noqa: B023
            return best

        text, p, want = texts[r.doc_id], 0, []
        while p < len(text):
            m = longest_at(text, p, known)
            if m is None:
                p += 1
                continue
            rivals = {m: (p, choose(m))}
            for q in range(p + 1, p + len(m)):
                if other := longest_at(text, q, known):
                    rivals[other] = (q, choose(other))
            name = max(rivals, key=lambda x: count[rivals[x][1][0]])
            at, (entity, etype) = rivals[name]
            want.append((at, at + len(name), name, entity, etype))
            p = at + len(name)
        assert [tuple(x) for x in r.links] == want


def test_latest_entities_decide(run, talks):
    lex = catalogue.AMBIGUOUS
    known = lex.candidates()
    want = Counter()
    for turns in talks.values():
        latest = {}
        for n, text in turns:
            p, links = 0, []
            while p < len(text or ""):
                m = longest_at(text, p, known)
                if m is None:
                    p += 1
                    continue
                entity, etype = next((c for c in known[m] if c[0] == latest.get(m)), known[m][0])
                latest |= {s: entity for s, e in lex.pairs if e == entity}
                links.append((p, p + len(m), m, entity, etype))
                p += len(m)
            want[n, str(links)] += 1
    assert Counter((r.doc_id, str([tuple(x) for x in r.links])) for r in run("link_latest")) == want


def test_paragraphs_tile_the_sentences(run, texts):
    got = by(run("auto_paragraphs"), "doc_id")
    for d, t in texts.items():
        rows = sorted(got[d], key=lambda r: r.para)
        assert [r.para for r in rows] == list(range(len(rows)))
        assert " ".join(r.text for r in rows).split() == (t or "").split()
        lines = [x for x in (t or "").split("\n") if x.strip()]
        assert len(rows) <= max(1, len(lines))  # ends of paragraphs are ends of lines


def test_entities_by_vectors(run, texts):
    """Counts, context and sub-word vectors, cosines, communities: all in dictionaries."""
    sents = []
    for t in texts.values():
        sents += [re.findall(r"[^\W_]+", s) for s in re.sub(r"([.!?]['\"”’)\]]*)[ \t\n\x0b\f\r]+", "\\1\0", t or "").split("\0")]
    name = lambda w: re.fullmatch("[A-Z][a-z]{5,}", w)
    n = Counter((w.lower(), "人名" if w.endswith("a") else "地名") for s in sents for w in s if name(w))
    named = sorted(((w, t, c) for (w, t), c in n.items() if c >= 5), key=lambda x: (-x[2], x[0], x[1]))
    dim = 50
    sign = lambda f: (zlib.crc32(f.encode()) % dim, 1 if zlib.crc32(f.encode()) >> 31 else -1)
    vec, length, whole, size = defaultdict(lambda: [0] * dim), Counter(), [0] * dim, 0
    keys = {x[0] for x in named}
    for s in sents:
        own = [0] * dim
        for w in s:
            k, v = sign(f"w:{w.lower()}")
            own[k] += v
        size += len(s)
        whole = [a + b for a, b in zip(whole, own)]
        for w, tf in Counter(x.lower() for x in s if x.lower() in keys).items():
            vec[w] = [a + tf * b for a, b in zip(vec[w], own)]
            length[w] += tf * len(s)
    unit = lambda v: [x / max(math.sqrt(sum(y * y for y in v)), 1e-12) for x in v]

    def vector(w):
        context = unit([a - length[w] / size * b for a, b in zip(vec[w], whole)])
        sub = [0] * dim
        for f in {f"<{w}>"[a : a + k] for k in range(1, 5) for a in range(len(w) + 3 - k)}:
            k, v = sign(f)
            sub[k] += v
        return unit([a + b for a, b in zip(context, unit(sub))])

    vectors = [vector(w) for w, _, _ in named]
    edges = [(i, j, 1.0) for j in range(len(named)) for i in range(j) if named[i][1] == named[j][1] and sum(a * b for a, b in zip(vectors[i], vectors[j])) > 0.9]
    label = graph.louvain(len(named), edges)
    want = defaultdict(set)
    for (w, t, _), c in zip(named, label):
        want[c, t].add(w)
    got = defaultdict(set)
    for r in run("entity_discover_nfl"):
        got[r.entity].add(r.mention)
        assert r.n in [c for w, _, c in named if w == r.mention]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
