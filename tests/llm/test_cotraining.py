from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from textloom.llm import cotraining as Q


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


def test_held_out_accuracy(documents, labels):
    model = Q.fit(documents, labels.where("doc_id % 3 <> 0"))
    got = Q.score(documents, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = sum((r.p_quality >= 0.5) == (r.quality == 1) for r in got)
    base = max(sum(r.quality == 1 for r in got), sum(r.quality == 0 for r in got))
    assert right >= 0.8 * len(got) and right >= base
    assert all(0 <= r.p_quality <= 1 for r in got)


def views(n, seed, flip=0.1):
    """Two noisy views of a hidden class."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    see = lambda: np.where(rng.random(n) < flip, 1 - y, y)
    one = np.stack([see() for _ in range(6)], 1).astype(np.float32)
    two = np.stack([see() for _ in range(4)], 1).astype(np.float32)
    return one, two, y


def test_views_exchange_labels_and_combine():
    xt, xp, y = views(60, 1)
    ut, up, _ = views(3000, 2)
    zt, zp, z = views(3000, 3)
    model = Q.train(xt, xp, y, ut, up)
    assert len(model.exchanged) >= 1 and all(a + b > 0 for a, b in model.exchanged[:1])
    t, p, both = model.score(zt, zp)
    acc = lambda q: float(((q >= 0.5) == z).mean())
    assert acc(both) >= max(acc(t), acc(p)) - 0.005 and acc(both) > 0.95


def test_pseudo_labels_go_to_the_other_view_once():
    xt, xp, y = views(60, 1)
    view = Q.Logistic().fit(xt, y).calibrate(xt, y)
    ut, _, _ = views(500, 2)
    free = np.ones(500, bool)
    at, label = Q.sure_ones(view, ut, free, 0.9, 30)
    assert len(at) == len(set(at.tolist())) and len(at) <= 60
    p = Q.sigmoid(view.logit(ut))
    assert all((p[i] >= 0.9) if k else (p[i] <= 0.1 + 1e-9) for i, k in zip(at, label))
    free[at] = False
    again, _ = Q.sure_ones(view, ut, free, 0.9, 30)
    assert not set(again.tolist()) & set(at.tolist())


def test_calibration_follows_the_share():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 1)).astype(np.float32)
    y = (rng.random(4000) < Q.sigmoid(2 * x[:, 0] - 1)).astype(int)
    view = Q.Logistic().fit(x, y).calibrate(x, y)
    p = Q.sigmoid(view.logit(x))
    for lo in (0.0, 0.25, 0.5, 0.75):
        own = (p >= lo) & (p < lo + 0.25)
        assert p[own].mean() == pytest.approx(y[own].mean(), abs=0.05)


def test_labels_that_cannot_train(spark, documents):
    no = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    got = Q.score(documents, Q.fit(documents, no)).collect()
    assert all(r.p_quality is None and r.keep for r in got) and len(got) == documents.count()
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    assert {r.p_quality for r in Q.score(documents, Q.fit(documents, one)).collect()} == {1.0}


def test_messy_and_empty(spark, messy, empty, documents, labels):
    model = Q.fit(documents, labels)
    got = Q.score(messy, model).collect()
    assert len(got) == 12 and all(0 <= r.p_quality <= 1 for r in got)
    assert len({r.p_quality for r in got if r.doc_id == 5}) == 1
    assert Q.score(empty, model).count() == 0
    own = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (9, 1), (7, 0), (3, 1), (8, 1)], "doc_id long, quality int")
    assert Q.score(messy, Q.fit(messy, own)).count() == 12
    assert Q.score(empty, Q.fit(empty, own)).count() == 0


def test_every_unlabelled_document_takes_part(documents, labels):
    """The exchange over tables equals the one in memory over all unlabelled documents."""
    part = labels.where("doc_id % 2 = 0")
    rows = documents.join(part.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "text", "source", "lang", "n_chars", "quality").toArrow().combine_chunks().sort_by("doc_id")
    xt, xp = Q._views(rows.to_batches()[0])
    have = np.array([v is not None for v in rows["quality"].to_pylist()])
    y = np.array([v for v in rows["quality"].to_pylist() if v is not None])
    want = Q.train(xt[have], xp[have], y, xt[~have], xp[~have], rounds=2, add=None)
    got = Q.fit(documents, part, rounds=2)
    assert len(got.exchanged) == len(want.exchanged)
    for a, b in zip(got.exchanged, want.exchanged):
        assert a == pytest.approx(b, rel=0.05, abs=5)
    p, q = (m.score(xt, xp)[2] for m in (got, want))
    assert np.abs(p - q).mean() < 0.02 and ((p >= 0.5) == (q >= 0.5)).mean() > 0.98


def test_the_exchange_has_no_cap(spark):
    good, bad = "A calm sentence about rivers and hills.", "BUY NOW!!! $$$ 000 CLICK"
    rows = [(i, (good, bad)[i % 2] + f" {i}", f"src{i % 2}", "en", 40) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    assert Q.fit(df, marks).exchanged[0] == (2880, 2880)


def plain_features(text):
    """The content view of one document, by loops over its bytes."""
    raw = (text or "").encode()
    out = [0.0] * (Q.TEXT_DIM + Q.SHAPES)
    if not raw:
        return out
    m = 0xFFFFFFFF
    grams = Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA77 & m) ^ (c * 0xC2B2AE3D & m)
        grams[((h ^ h >> 15) * 0x2C1B3C6D & m) >> 22] += 1
    for k, n in grams.items():
        out[k] = (n / sum(grams.values())) ** 0.5
    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", raw)
    share = lambda ok: sum(map(ok, raw)) / len(raw)
    out[Q.TEXT_DIM :] = [
        share(lambda x: 65 <= x <= 90), share(lambda x: 48 <= x <= 57), share(lambda x: 32 < x < 48 and x not in (44, 46) or 57 < x < 65 or 122 < x < 128), share(lambda x: x == 10),
        sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), len(set(words)) / max(1, len(words)), min(len(raw) / max(1, len(words)), 40) / 40, 1.0,
    ]
    return out


def newton(x, y, ridge=Q.RIDGE):
    """Balanced ridge logistic regression, solved to its only optimum by damped Newton steps; weights, then bias."""
    c = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a = np.append(x, np.ones((len(x), 1)), 1).astype(float)
    damp = np.append(np.full(x.shape[1], ridge), 0.0)
    z = np.zeros(a.shape[1])
    loss = lambda z: (c * np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ z))).sum() + 0.5 * (damp * z * z).sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ z))
        step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + np.diag(damp + 1e-9), a.T @ (c * (p - y)) + damp * z)
        rate = 1.0
        while loss(z - rate * step) > loss(z) and rate > 1e-6:
            rate /= 2
        z = z - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return z


def nesterov(x, y, ridge=Q.RIDGE, steps=300):
    """The same objective by 300 accelerated gradient steps from zero, row weights spelled out."""
    a = np.append(x, np.ones((len(x), 1)), 1).astype(float)
    c = np.array([0.5 / (y == v).sum() for v in y])
    z = past = np.zeros(a.shape[1])
    rate = 4 / (1 + max(float(r @ r) for r in x))
    for k in range(steps):
        ahead = z if k == 0 else z + (k - 1) / (k + 2) * (z - past)
        slope = a.T @ (c * (1 / (1 + np.exp(-a @ ahead)) - y)) + np.append(ridge * ahead[:-1], 0)
        past, z = z, ahead - rate * slope
    return z


def test_against_another_implementation(documents, labels):
    """Features by loops, fits spelled out, labels exchanged in dictionaries, views combined by hand."""
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    known = {r.doc_id: r.quality for r in labels.collect()}
    xt = np.array([plain_features(r.text) for r in rows])
    xp = np.zeros((len(rows), Q.PAGE_DIM))
    for i, r in enumerate(rows):
        for kind, v in (("source", r.source), ("lang", r.lang), ("size", None if r.n_chars is None else int(math.log2(max(1, r.n_chars))))):
            xp[i, xxhash.xxh32_intdigest(f"{kind}={v!r}") % Q.PAGE_DIM] = 1
    have = np.array([r.doc_id in known for r in rows])
    y = np.array([known.get(r.doc_id, 0) for r in rows])
    own = np.flatnonzero(have)
    cal, fit = own[::3], np.array([i for k, i in enumerate(own) if k % 3])
    given = {"text": {}, "page": {}}  # labels that each view was given by the other
    views = {}
    for step in range(2):
        for name, x in (("text", xt), ("page", xp)):
            at = np.array([*fit, *given[name]])
            solve = newton if name == "text" and step else nesterov
            z = solve(x[at], np.array([*y[fit], *given[name].values()]))
            s = x @ z[:-1] + z[-1]
            pos, neg = (y[cal] == 1).sum(), (y[cal] == 0).sum()
            target = np.where(y[cal] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
            w = np.zeros(2)
            a = np.stack([s[cal], np.ones(len(cal))], 1)
            for _ in range(20_000):  # Platt's sigmoid, by plain descent
                w = w - 4 / (a * a).sum() * (a.T @ (1 / (1 + np.exp(-a @ w)) - target))
            views[name] = np.clip(s * w[0] + w[1], -30, 30)
        if step == 1:
            break
        for name, other in (("text", "page"), ("page", "text")):
            p = 1 / (1 + np.exp(-views[name]))
            given[other] |= {i: int(p[i] >= 0.5) for i in range(len(rows)) if not have[i] and max(p[i], 1 - p[i]) >= Q.SURE}
    prior = y[own].mean()
    want = 1 / (1 + np.exp(-np.clip(views["text"] + views["page"] - np.log(prior / (1 - prior)), -30, 30)))
    got = {r.doc_id: r.p_quality for r in Q.score(documents, Q.fit(documents, labels, rounds=1)).collect()}
    have_p = np.array([got[r.doc_id] for r in rows])
    assert np.abs(have_p - want).mean() < 0.03 and ((have_p >= 0.5) == (want >= 0.5)).mean() > 0.97


def test_many_labels_join_by_a_shuffle(documents, labels, monkeypatch):
    """Beyond the limit of a broadcast the labelled documents are left out by a join, with the same result."""
    want = Q.fit(documents, labels, rounds=1).exchanged
    monkeypatch.setattr(Q.C, "measured", lambda df, name: (Q.C.settle(df, name), False))
    assert Q.fit(documents, labels, rounds=1).exchanged == want
