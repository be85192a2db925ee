from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict

import pytest

from textloom.llm import language_id as L


def words_of(text):
    out, now = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def grams(word, n):
    w = f" {word} "
    got = [w[i : i + n] for i in range(len(w) - n + 1)]
    return [g for g in got if n > 1 or g != " "]


class Brute:
    """The same model with dictionaries."""

    def __init__(self, rows, min_count):
        self.count = defaultdict(Counter)
        for text, lang in rows:
            for w in words_of(text):
                self.count[lang, 0][w] += 1
                for n in range(1, L.MAX_GRAM + 1):
                    self.count[lang, n].update(grams(w, n))
        self.langs = sorted({k[0] for k in self.count})
        self.total = {k: sum(c.values()) for k, c in self.count.items()}
        for k, c in self.count.items():
            self.count[k] = Counter({x: n for x, n in c.items() if n >= min_count})

    def cost(self, lang, n, item):
        c = self.count[lang, n][item]
        return min(L.PENALTY, -math.log10(c / self.total[lang, n])) if c else L.PENALTY

    def word(self, w):
        for n, items in [(0, [w])] + [(n, grams(w, n)) for n in range(L.MAX_GRAM, 0, -1)]:
            known = [x for x in items if any(self.count[k, n][x] for k in self.langs)]
            if known:
                return [sum(self.cost(k, n, x) for x in known) / len(known) for k in self.langs], n > 0
        return [L.PENALTY] * len(self.langs), True

    def score(self, text):
        got = [self.word(w) for w in words_of(text or "")]
        if not got:
            return "und", 0.0, 0.0, 0, 0
        mean = [sum(c[k] for c, _ in got) / len(got) for k in range(len(self.langs))]
        order = sorted(mean)
        return self.langs[mean.index(order[0])], order[0], order[1] - order[0], len(got), sum(u for _, u in got)


TRAIN = [(1, "the cat and the dog sat on the mat with the bird", "en"), (2, "der hund und die katze sitzen auf der matte", "de"), (3, "le chien et le chat sont sur le tapis", "fr"), (4, "an old man went down to the sea", "en")]


@pytest.mark.parametrize("min_count", [1, 2])
def test_against_brute_force(spark, min_count):
    df = spark.createDataFrame(TRAIN, "doc_id long, text string, lang string")
    brute = Brute([r[1:] for r in TRAIN], min_count)
    tests = ["The dogs went", "katzen und hunde", "chiens, chats… zebra", "xqz", "", "123 !!", "ÉTÉ matte cat", "q", None]
    got = {r.doc_id: r for r in L.detect(spark.createDataFrame([(i, t, None) for i, t in enumerate(tests)], "doc_id long, text string, lang string"), L.fit(df, min_count=min_count)).collect()}
    for i, t in enumerate(tests):
        r = got[i]
        lang, cost, margin, n, unseen = brute.score(t)
        assert (r.n_words, r.n_unseen) == (n, unseen)
        assert r.cost == pytest.approx(cost) and r.margin == pytest.approx(margin)
        assert r.pred_lang == lang or margin < 1e-9
        assert r.keep == (n > 0 and margin >= L.MIN_MARGIN and cost <= L.MAX_COST) or abs(margin - L.MIN_MARGIN) < 1e-9


def test_whole_table_against_brute_force(spark, documents, texts):
    """Production parameters, every document; no list is cut, however many words and n-grams there are."""
    rows = [(r.text, r.lang) for r in documents.select("text", "lang").collect()]
    assert len(rows) <= L.TRAIN_DOCS
    brute = Brute(rows, L.MIN_COUNT)
    model = L.fit(documents)
    assert [len(model.levels[n][0]) for n in range(L.MAX_GRAM + 1)] == [len({x for (_, m), c in brute.count.items() if m == n for x in c}) for n in range(L.MAX_GRAM + 1)]
    for r in L.detect(documents, model).collect():
        lang, cost, margin, n, unseen = brute.score(texts[r.doc_id])
        assert (r.n_words, r.n_unseen) == (n, unseen)
        assert r.cost == pytest.approx(cost) and r.margin == pytest.approx(margin)
        assert r.pred_lang == lang or margin < 1e-9


def test_held_out_accuracy(spark, documents):
    train, held = documents.where("doc_id % 2 = 0"), documents.where("doc_id % 2 = 1")
    got = L.detect(held, L.fit(train)).where("n_words >= 5").collect()
    assert sum(r.lang == r.pred_lang for r in got) >= 0.95 * len(got)
    kept = L.keep_known(held, L.fit(train))
    assert kept.columns == held.columns and kept.count() >= 0.9 * len(got)


def test_messy_and_empty(messy, empty):
    got = L.detect(messy, L.fit(messy, min_count=1)).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    for i in (2, 3, 4):
        assert (by[i].pred_lang, by[i].cost, by[i].margin, by[i].keep) == ("und", 0.0, 0.0, False)
    assert by[6].pred_lang == "en" and by[7].pred_lang == "fr"
    kept = L.keep_known(messy, L.fit(messy, min_count=1))
    assert kept.columns == messy.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    model = L.fit(empty)
    assert L.detect(empty, model).count() == 0
    assert {r.pred_lang for r in L.detect(messy, model).collect()} == {"und"}
    assert L.keep_known(messy, model).count() == 0


def test_one_language_has_no_rival(spark):
    df = spark.createDataFrame([(1, "only one language here", "en")], "doc_id long, text string, lang string")
    (r,) = L.detect(df, L.fit(df, min_count=1)).collect()
    assert r.pred_lang == "en" and r.keep
