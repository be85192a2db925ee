"""Quality classifier by co-training two views of a document.

The content view sees the text only: hashed byte trigrams and a few shape
shares.  The page view sees metadata only: source, language and length bucket,
one-hot and hashed.  Both are logistic regressions.  They start from labelled
documents; each round every view labels all unlabelled documents it is sure of
(calibrated probability beyond ``SURE``) for the *other* view, each once, and
both are fitted again.  Platt calibration on held-out labels
turns both scores into probabilities, and the views combine as independent
evidence: logit p = logit p_text + logit p_page - logit prior.

Fitting uses at most ``LABELLED`` labelled documents (smallest hashes of doc_id),
a documented bound on fitting only, and every unlabelled one.  Features of the
unlabelled are written once to shared storage, text features as half floats; a
page view's features are a cell (the set of its slots, at most PAGE_DIM cubed of
them), so counts by cell and label are all that the page view is fitted on, and
the text view is fitted by quasi-Newton steps whose loss and gradient are summed
over all executors.  Scoring is one narrow pass over every document and all of
its text.

Labelled ids are broadcast where a check of their size allows it; more of them
meet the features, not the text, in a shuffled join.

Defined results: null labels and documents with contradicting label rows don't
train; repeated label rows count once.  Without labels of both classes the
score is the share of the only class (null without any) and ``keep`` is true.
Null and empty texts have zero content features; null metadata is a value of
its own.  Texts count whole, however long.  Unlabelled rows that share an id or
have none take part each.  Rows are scored one by one, so repeated rows get
equal scores and there are no ties; of labelled rows that share an id one takes
part, and the sample's ties in the hash go to the smaller id.  An empty table
of documents gives an empty result, an empty table of labels scores of null.
Columns are taken by exact name, others are ignored, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LABELLED, ROUNDS, SURE, THRESHOLD = 4000, 4, 0.9, 0.5
TEXT_DIM, PAGE_DIM, SHAPES = 1024, 96, 8
#: A fit of the text view ends when the loss is within about GAP of its least, or after PASSES.
RIDGE, PASSES, GAP = 1e-3, 20, 1e-5


def content_features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rows of TEXT_DIM root trigram shares (unit length) and SHAPES shares."""
    n = len(offsets) - 1
    out = np.zeros((n, TEXT_DIM + SHAPES), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) > 2:
        v = data.astype(np.uint32)
        h = (v[:-2] * np.uint32(0x9E3779B1)) ^ (v[1:-1] * np.uint32(0x85EBCA77)) ^ (v[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> 15)) * np.uint32(0x2C1B3C6D)
        inside = doc[:-2] == doc[2:]
        slot = doc[:-2][inside] * TEXT_DIM + (h[inside] >> np.uint32(22)).astype(np.int64)
        counts = np.bincount(slot, minlength=n * TEXT_DIM).reshape(n, TEXT_DIM)
        out[:, :TEXT_DIM] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.bincount(doc[mask], minlength=n) / size
    out[:, TEXT_DIM] = share((data >= 65) & (data <= 90))
    out[:, TEXT_DIM + 1] = share((data >= 48) & (data <= 57))
    out[:, TEXT_DIM + 2] = share((data > 32) & (data < 48) & (data != 44) & (data != 46) | (data > 57) & (data < 65) | (data > 122) & (data < 128))
    out[:, TEXT_DIM + 3] = share(data == 10)
    start, end, wdoc = C.words_of(offsets, data)
    words = np.maximum(np.bincount(wdoc, minlength=n), 1)
    h = C.span_hash(data, start, end, C.BASE)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    out[:, TEXT_DIM + 4] = np.bincount(wdoc[again], minlength=n) / words
    _, first = np.unique(h ^ C.mix(wdoc.astype(np.uint64) + np.uint64(1)), return_index=True)
    out[:, TEXT_DIM + 5] = np.bincount(wdoc[first], minlength=n) / words
    out[:, TEXT_DIM + 6] = np.minimum(size / words, 40) / 40
    out[:, TEXT_DIM + 7] = 1.0
    return out


def page_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One-hot hashes of the metadata values; null is a value."""
    out = np.zeros((len(source), PAGE_DIM), np.float32)
    known: dict[tuple, int] = {}
    for i, row in enumerate(zip(source, lang, n_chars)):
        size = None if row[2] is None else int(np.log2(max(1, row[2])))
        for kind, v in (("source", row[0]), ("lang", row[1]), ("size", size)):
            k = known.get((kind, v))
            if k is None:
                k = known[kind, v] = xxhash.xxh32_intdigest(f"{kind}={v!r}") % PAGE_DIM
            out[i, k] = 1.0
    return out


@dataclass
class Logistic:
    """Ridge logistic regression, balanced classes, accelerated gradient descent."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0  # Platt
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 300, times: np.ndarray | None = None) -> Logistic:
        """``times``: how often each row counts."""
        x = x.astype(np.float64)
        times = np.ones(len(y)) if times is None else times
        share = (y * times).sum() / times.sum()
        c = times * np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / times.sum()
        rate = 4.0 / (np.max((x * x).sum(1)) + 1)
        w, b = np.zeros(x.shape[1]), 0.0
        vw, vb = w.copy(), b
        for k in range(steps):
            g = c * (1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y)
            nw, nb = vw - rate * (x.T @ g + ridge * vw), vb - rate * g.sum()
            m = k / (k + 3)
            vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
        self.weights, self.bias = w, b
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.astype(np.float32) + self.bias

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """Platt's sigmoid with his smoothed targets, by Newton steps that are halved until the loss falls."""
        s = self.raw(x).astype(np.float64)
        pos, neg = y.sum(), (1 - y).sum()
        t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a = np.stack([s, np.ones_like(s)], 1)
        z = np.array([0.0, np.log((pos + 1) / (neg + 1))])
        loss = lambda z: (np.logaddexp(0, a @ z) - t * (a @ z)).sum() + 0.5e-6 * (z @ z)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
            h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-6 * np.eye(2)
            d = np.linalg.solve(h, a.T @ (p - t) + 1e-6 * z)
            now = loss(z)
            while loss(z - d) > now and np.abs(d).max() > 1e-10:
                d = d / 2
            z = z - d
            if np.abs(d).max() < 1e-8:
                break
        self.slope, self.shift = float(z[0]), float(z[1])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.raw(x) * self.slope + self.shift, -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class CoTrained:
    text: Logistic | None
    page: Logistic | None
    prior: float | None  # share of good documents
    exchanged: list[tuple[int, int]] = field(default_factory=list)  # labels given by (text, page) each round

    def score(self, xt: np.ndarray, xp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the page view and both."""
        zt, zp = self.text.logit(xt), self.page.logit(xp)
        base = np.log(self.prior / (1 - self.prior))
        return sigmoid(zt), sigmoid(zp), sigmoid(np.clip(zt + zp - base, -30, 30))


def sure_ones(view: Logistic, x: np.ndarray, free: np.ndarray, sure: float, add: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unlabelled documents the view is sure of (the surest ``add`` a class, all without it) and the labels it gives."""
    p = sigmoid(view.logit(x))
    at, label = [], []
    for y, conf in ((1, p), (0, 1 - p)):
        own = np.flatnonzero(free & (conf >= sure))
        own = own[np.argsort(-conf[own], kind="stable")][:add]
        at.append(own)
        label.append(np.full(len(own), y))
    return np.concatenate(at), np.concatenate(label)


def halves(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows to fit on and to calibrate on."""
    held = np.arange(len(y)) % 3 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    return ~held, held if held.any() else ~held


def train(xt: np.ndarray, xp: np.ndarray, y: np.ndarray, ut: np.ndarray, up: np.ndarray, rounds: int = ROUNDS, add: int | None = 150, sure: float = SURE) -> CoTrained:
    """Co-training on labelled (xt, xp, y) and unlabelled (ut, up) features in memory; ``fit`` does the same over tables, as with ``add`` None."""
    if not len(y) or len(set(y.tolist())) < 2:
        return CoTrained(None, None, float(y.mean()) if len(y) else None)
    fit, cal = halves(y)
    more = {"text": (ut[:0], y[:0]), "page": (up[:0], y[:0])}
    free = {"text": np.ones(len(ut), bool), "page": np.ones(len(up), bool)}
    exchanged = []
    for k in range(rounds + 1):
        text = Logistic().fit(np.concatenate([xt[fit], more["text"][0]]), np.concatenate([y[fit], more["text"][1]])).calibrate(xt[cal], y[cal])
        page = Logistic().fit(np.concatenate([xp[fit], more["page"][0]]), np.concatenate([y[fit], more["page"][1]])).calibrate(xp[cal], y[cal])
        if k == rounds or not len(ut):
            break
        a, la = sure_ones(text, ut, free["page"], sure, add)
        b, lb = sure_ones(page, up, free["text"], sure, add)
        more["page"] = np.concatenate([more["page"][0], up[a]]), np.concatenate([more["page"][1], la])
        more["text"] = np.concatenate([more["text"][0], ut[b]]), np.concatenate([more["text"][1], lb])
        free["page"][a] = False
        free["text"][b] = False
        exchanged.append((len(a), len(b)))
        if not len(a) + len(b):
            break
    return CoTrained(text, page, float(np.clip(y.mean(), 1e-6, 1 - 1e-6)), exchanged)


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    xt = content_features(*C.string_buffers(part.column("text")))
    return xt, page_features(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _cells(xp: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.packbits(xp > 0, axis=1)]


def _pages(cells: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), PAGE_DIM // 8), axis=1).astype(np.float32)


def loss_and_gradient(at: np.ndarray, x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Gradient by weight and bias, then the loss, of rows that weigh ``c``."""
    z = np.clip((x @ at[:-1].astype(x.dtype)).astype(np.float64) + at[-1], -30, 30)
    g = c * (sigmoid(z) - y)
    return np.concatenate([(g.astype(x.dtype) @ x).astype(np.float64), [g.sum(), (c * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum()]])


class Unlabelled:
    """Stored features (cell, xt) of all unlabelled documents; every method is one pass over them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def cells(self) -> dict[bytes, int]:
        """Documents a cell."""
        return {bytes(r.cell): r.n for r in self.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    @staticmethod
    def _parts(batches: Iterator[pa.RecordBatch], own: dict[bytes, int] | None = None) -> Iterator[tuple[list[bytes], np.ndarray]]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                cells = part.column("cell").to_pylist()
                xt = part.column("xt")
                if own is not None:
                    keep = [i for i, c in enumerate(cells) if c in own]
                    cells, xt = [cells[i] for i in keep], xt.take(pa.array(keep, pa.int64()))
                if cells:
                    yield cells, np.frombuffer(b"".join(xt.to_pylist()), np.float16).reshape(len(cells), -1).astype(np.float32)

    def sure(self, views: list[Logistic], sure: float) -> dict[tuple[bytes, int], int]:
        """Documents by cell and label that the last of ``views`` is sure of and none before was."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count: Counter = Counter()
            for cells, xt in Unlabelled._parts(batches):
                free = np.ones(len(cells), bool)
                for view in views:
                    at, label = sure_ones(view, xt, free, sure)
                    free[at] = False
                count.update((cells[i], y) for i, y in zip(at.tolist(), label.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in count], pa.binary()), pa.array([y for _, y in count], pa.int32()), pa.array(list(count.values()), pa.int64())], ["cell", "y", "n"])

        got = self.rows.mapInArrow(C.tidy(run), "cell binary, y int, n long").groupBy("cell", "y").agg(F.sum("n").alias("n")).collect()  # at most two rows a cell
        return {(bytes(r.cell), r.y): r.n for r in got}

    def gradient(self, at: np.ndarray, label: dict[bytes, int], weight: tuple[float, float]) -> np.ndarray:
        """loss_and_gradient of the documents in labelled cells, summed over all executors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(at) + 1)
            for cells, xt in Unlabelled._parts(batches, label):
                y = np.array([label[c] for c in cells])
                total += loss_and_gradient(at, xt, y, np.where(y == 1, weight[1], weight[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

        got = self.rows.mapInArrow(C.tidy(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # a row a weight
        out = np.zeros(len(at) + 1)
        out[got["k"].to_numpy()] = got["v"].to_numpy()
        return out

    def fit(self, start: Logistic, x: np.ndarray, y: np.ndarray, label: dict[bytes, int], count: dict[bytes, int], ridge: float = RIDGE) -> Logistic:
        """Logistic.fit of the labelled rows and all documents in labelled cells: L-BFGS on the labelled rows' curvature."""
        n = np.array([(y == k).sum() + sum(count[c] for c, v in label.items() if v == k) for k in (0, 1)], float)
        weight = tuple(0.5 / n)
        own, damp = np.where(y == 1, weight[1], weight[0]), np.append(np.full(x.shape[1], ridge), 0.0)
        x64 = x.astype(np.float64)

        def f(at: np.ndarray) -> tuple[float, np.ndarray]:
            total = loss_and_gradient(at, x64, y, own) + self.gradient(at, label, weight)
            return total[-1] + 0.5 * (damp * at * at).sum(), total[:-1] + damp * at

        at = np.append(start.weights, start.bias)
        p = sigmoid(np.clip(x64 @ at[:-1] + at[-1], -30, 30))
        ones = np.append(x64, np.ones((len(x64), 1)), 1)
        c = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        inverse = np.linalg.inv((ones * (c * p * (1 - p))[:, None]).T @ ones + np.diag(damp + 1e-6))
        value, g = f(at)
        past: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(PASSES):
            q, steps = g.copy(), []
            for s, d in reversed(past):
                steps.append(s @ q / (s @ d))
                q -= steps[-1] * d
            q = inverse @ q
            for (s, d), k in zip(past, reversed(steps)):
                q += (k - d @ q / (s @ d)) * s
            slope = g @ q
            if slope < 2 * GAP:
                break
            rate = 1.0
            new, ng = f(at - q)
            while new > value - 1e-4 * rate * slope and rate > 1e-3:
                rate /= 4
                new, ng = f(at - rate * q)
            if new >= value:
                break
            if (-rate * q) @ (ng - g) > 1e-14:
                past.append((-rate * q, ng - g))
            at, value, g = at - rate * q, new, ng
        return Logistic(at[:-1], float(at[-1]))


def exchange(xt: np.ndarray, xp: np.ndarray, y: np.ndarray, pool: Unlabelled, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """``train`` with the unlabelled documents in storage."""
    fit, cal = halves(y)
    count = pool.cells()
    cells = list(count)
    pages = _pages(cells)
    by_page: dict[bytes, int] = {}  # labels that the page view gave, which are those of whole cells
    by_text: dict[tuple[bytes, int], int] = {}
    texts: list[Logistic] = []
    exchanged = []
    text, page = Logistic().fit(xt[fit], y[fit]), Logistic().fit(xp[fit], y[fit])
    for k in range(rounds + 1):
        text.calibrate(xt[cal], y[cal])
        page.calibrate(xp[cal], y[cal])
        if k == rounds or not cells:
            break
        texts.append(text)
        given = pool.sure(texts, sure)
        at, label = sure_ones(page, pages, np.array([c not in by_page for c in cells]), sure)
        new = {cells[i]: int(v) for i, v in zip(at, label)}
        exchanged.append((sum(given.values()), sum(count[c] for c in new)))
        if not sum(exchanged[-1]):
            break
        by_page |= new
        for c, n in given.items():
            by_text[c] = by_text.get(c, 0) + n
        if new:
            text = pool.fit(text, xt[fit], y[fit], by_page, count)
        if given:
            page = Logistic().fit(np.concatenate([xp[fit], _pages([c for c, _ in by_text])]), np.concatenate([y[fit], [v for _, v in by_text]]), times=np.concatenate([np.ones(fit.sum()), list(by_text.values())]))
    return CoTrained(text, page, float(np.clip(y.mean(), 1e-6, 1 - 1e-6)), exchanged)


def fit(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    docs = C.narrow(documents, doc_id="doc_id", text="text", source="source", lang="lang", n_chars="n_chars")
    marks = C.narrow(labels, doc_id="doc_id", y="quality").where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"))
    marks, few = C.measured(marks, "marks")
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    known = marks.join(ids, "doc_id").orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(labelled)
    sample = docs.join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])  # at most ``labelled`` rows
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch):
                xt, xp = _views(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([x.tobytes() for x in xt], pa.binary()), pa.array([x.tobytes() for x in xp], pa.binary())], ["doc_id", "y", "xt", "xp"])

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch):
                xt, xp = _views(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_cells(xp), pa.binary()), pa.array([x.tobytes() for x in xt.astype(np.float16)], pa.binary())], ["doc_id", "cell", "xt"])

    got = sample.mapInArrow(C.tidy(run), f"doc_id {kind}, y int, xt binary, xp binary").toArrow().sort_by("doc_id")  # at most ``labelled`` rows
    y = (got["y"].to_numpy() > 0).astype(np.int64)
    rows = lambda c, w: np.frombuffer(b"".join(got[c].to_pylist()), np.float32).reshape(-1, w)
    xt, xp = rows("xt", TEXT_DIM + SHAPES), rows("xp", PAGE_DIM)
    if len(set(y.tolist())) < 2:
        return train(xt, xp, y, xt[:0], xp[:0])
    shape, marked = f"doc_id {kind}, cell binary, xt binary", marks.select("doc_id")
    if few:
        rest = docs.join(F.broadcast(marked), "doc_id", "left_anti").mapInArrow(C.tidy(slim), shape)
    else:  # features cross the shuffle of this join, never text
        rest = docs.mapInArrow(C.tidy(slim), shape).join(marked.hint("merge"), "doc_id", "left_anti")
    return exchange(xt, xp, y, Unlabelled(C.settle(rest.select("cell", "xt"), "unlabelled")), rounds, sure)


def score(documents: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, p_text, p_page, p_quality, keep."""
    slim = C.narrow(documents, doc_id="doc_id", text="text", source="source", lang="lang", n_chars="n_chars")
    kind = slim.schema["doc_id"].dataType.simpleString()
    if model.text is None:
        p = F.lit(model.prior).cast("double")
        return slim.select("doc_id", p.alias("p_text"), p.alias("p_page"), p.alias("p_quality"), F.lit(True).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.text_chunks(batch):
                t, p, both = model.score(*_views(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.float64)) for x in (t, p, both)), pc.greater_equal(pa.array(both.astype(np.float64)), threshold)], ["doc_id", "p_text", "p_page", "p_quality", "keep"])

    return slim.mapInArrow(C.tidy(run), f"doc_id {kind}, p_text double, p_page double, p_quality double, keep boolean")
