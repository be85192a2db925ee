"""Graphs, sentiment, keywords, summaries, new words, entities, parsing, question answering."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import discover, graph, keyword, kgqa, newword, parse, sentiment, summary
from textloom.operators.lexicon import Lexicon


def tokens(spark, docs, flags=None):
    rows = [(i, p, w, (flags or {}).get(w, "x")) for i, words in enumerate(docs) for p, w in enumerate(words)]
    return spark.createDataFrame(rows, "doc_id long, pos int, word string, flag string")


# -- graphs --


def edges_of(df):
    return {(r.u, r.v): r.weight for r in df.collect()}


def test_pair_counts_are_distinct_a_document(spark):
    items = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, None), (3, "a")], "doc_id long, item string")
    assert edges_of(graph.pair_counts(items)) == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert edges_of(graph.pair_counts(items, 2)) == {("a", "b"): 2}


def test_ego_graph_thresholds(spark):
    items = spark.createDataFrame([(d, x) for d, s in enumerate(["xab", "xab", "xac", "ab", "xbc"]) for x in s], "doc_id long, item string")
    assert edges_of(graph.ego_graph(items, "x")) == {("a", "x"): 3, ("b", "x"): 3, ("c", "x"): 2, ("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert edges_of(graph.ego_graph(items, "x", 3)) == {("a", "x"): 3, ("b", "x"): 3}
    assert edges_of(graph.ego_graph(items, "x", 3, 2)) == {("a", "x"): 3, ("b", "x"): 3, ("a", "b"): 2}
    assert edges_of(graph.ego_graph(items, "nobody")) == {}


def test_pagerank_matrix_and_table_agree(spark):
    rng = np.random.default_rng(0)
    w = {}
    for a, b in rng.integers(0, 12, (30, 2)):
        if a != b:
            w[tuple(sorted((int(a), int(b))))] = int(rng.integers(1, 5))
    m = np.zeros((12, 12))
    for (a, b), x in w.items():
        m[a, b] = m[b, a] = x
    used = np.flatnonzero(m.sum(1))
    want = dict(zip(used.tolist(), graph.pagerank_matrix(m[np.ix_(used, used)], tol=1e-12)))
    df = spark.createDataFrame([(f"{a:02}", f"{b:02}", x) for (a, b), x in w.items()], "u string, v string, weight long")
    got = {int(r.node): r.rank for r in graph.pagerank(df, iterations=40).collect()}
    assert got == pytest.approx(want, abs=1e-4) and sum(got.values()) == pytest.approx(1)
    assert graph.pagerank_matrix(np.zeros((0, 0))).size == 0


def test_louvain_finds_cliques():
    edges = [(a, b, 1.0) for base in (0, 5, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 5, 1.0), (9, 10, 1.0)]
    label = graph.louvain(15, edges)
    assert label == [0] * 5 + [1] * 5 + [2] * 5
    assert graph.louvain(3, []) == [0, 1, 2]


# -- sentiment --

OPINIONS = ["good fine star".split(), "good fine great team".split(), "bad poor team limit".split(), "bad limit poor".split()]


def test_sentiment_scores(spark):
    t = tokens(spark, OPINIONS)
    got = {r.word: r.score for r in sentiment.build_sent_dict(t, ["good"], ["bad"], 1, "+-1").collect()}
    assert got["fine"] == 1.0 and got["team"] == 0.0 and got["limit"] == -1.0
    raw = {r.word: r.score for r in sentiment.build_sent_dict(t, ["good"], ["bad"], 1).collect()}
    n, df = 4, Counter(w for d in OPINIONS for w in set(d))
    both = lambda a, b: sum(a in d and b in d for d in OPINIONS)
    pmi = lambda a, b: math.log2(both(a, b) * n / (df[a] * df[b])) if both(a, b) else 0.0
    assert raw == pytest.approx({w: pmi(w, "good") - pmi(w, "bad") for w in df})
    unit = {r.word: r.score for r in sentiment.build_sent_dict(t, ["good"], None, 2, "0-1").collect()}
    assert set(unit) == {w for w in df if df[w] >= 2} and max(unit.values()) == 1.0
    docs = spark.createDataFrame([(0,), (1,), (9,)], "doc_id long")
    table = spark.createDataFrame([("fine", 1.0), ("team", 0.0), ("poor", -1.0)], "word string, score double")
    assert {r.doc_id: r.score for r in sentiment.analyse(t, table, docs).collect()} == {0: 1.0, 1: 0.5, 9: 0.0}
    assert {r.doc_id: r.scores for r in sentiment.analyse(t, table, docs, avg=False).collect()}[1] == [0.0, 1.0]


def test_sentiment_errors(spark):
    t = tokens(spark, OPINIONS)
    for options in ({"method": "other"}, {"scale": "2"}, {"pos_seeds": ["nowhere"]}):
        with pytest.raises(ValueError):
            sentiment.build_sent_dict(t, **options)
    stop = spark.createDataFrame([("team",)], "w string")
    assert "team" not in {r.word for r in sentiment.build_sent_dict(t, ["good"], ["bad"], 1, stopwords=stop).collect()}


# -- keywords --


def test_tfidf(spark):
    docs = ["aa aa bb".split(), "bb cc".split(), "bb dd".split()]
    got = {(r.doc_id, r.word): r.score for r in keyword.extract(tokens(spark, docs), 2).collect()}
    assert got[0, "aa"] == pytest.approx(2 / 3 * (math.log(4 / 2) + 1)) and got[0, "bb"] == pytest.approx(1 / 3)
    own = spark.createDataFrame([("aa", 3.0)], "word string, idf double")
    assert {r.word for r in keyword.extract(tokens(spark, docs), 2, idf=own).collect()} == {"aa"}
    with pytest.raises(ValueError):
        keyword.extract(tokens(spark, docs), 2, "magic")


def test_filters_come_before_windows(spark):
    t = tokens(spark, ["aa x bb the cc".split()], {"aa": "n", "bb": "n", "cc": "v", "x": "n"})
    stop = spark.createDataFrame([("the",)], "w string")
    own = keyword.filter_tokens(t, 2, stopwords=stop)
    assert [(r.a, r.b) for r in keyword.window_pairs(own).collect()] == [("aa", "bb"), ("bb", "cc")]
    assert {(r.a, r.b) for r in keyword.window_pairs(own, 3).collect()} == {("aa", "bb"), ("bb", "cc"), ("aa", "cc")}
    assert {r.word for r in keyword.filter_tokens(t, 2, ["n"]).collect()} == {"aa", "bb"}


def test_textrank_prefers_the_hub(spark):
    words = "hub aa hub bb hub cc hub dd".split()
    got = keyword.extract(tokens(spark, [words]), 3, "textrank").collect()
    assert got[0].word == "hub" and [r.rank for r in got] == [1, 2, 3]
    assert keyword.textrank_words([["alone"]]) == [] and keyword.textrank_words([]) == []


def test_sparse_ranks_equal_the_dense_ones():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.zipf(1.6, 300) % 60]
    names = list(dict.fromkeys(words))
    m = np.zeros((len(names), len(names)))
    for x in (1, 2):
        for a, b in zip(words, words[x:]):
            a, b = names.index(a), names.index(b)
            m[a, b] = m[b, a] = m[a, b] + 1
    got = dict(keyword.textrank_words([words], 3, True))
    assert got == pytest.approx(dict(zip(names, graph.pagerank_matrix(m).tolist())), abs=1e-9)
    sents = [[f"w{k}" for k in rng.zipf(1.6, rng.integers(0, 9)) % 60] for _ in range(80)]
    assert summary.overlap_rank(sents) == pytest.approx(graph.pagerank_matrix(summary.overlap_matrix(sents)), abs=1e-9)


def test_textrank_of_a_long_document_takes_no_square_of_its_words():
    import tracemalloc

    tracemalloc.start()
    assert len(keyword.textrank_words([[f"w{i}" for i in range(6000)]])) == 6000
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_rank_queries_read_documents(spark, data):
    from textloom.plans import catalogue

    for name in ("textrank_topk", "mmr_summary"):
        df = catalogue.QUERIES[name](spark, data)
        assert "doc_id" in df.columns and df.select("doc_id").distinct().count() > 100


def test_keyword_evaluation(spark):
    f = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, word string")
    t = spark.createDataFrame([(1, "a"), (2, "d")], "doc_id long, word string")
    r = keyword.evaluate(f, t).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx((1 / 3, 1 / 2, 0.4))


# -- summaries --


def test_summary(spark):
    sents = [["a", "b", "c"], ["a", "b", "d"], ["x", "y"], ["a", "b"], []]
    picked = summary.summarise(sents, [3] * 5, 2)
    assert len(picked) == 2 and {i for i, _ in picked} <= {0, 1, 3}
    assert len(summary.summarise(sents, [3] * 5, 5)) == 4  # never the one without words
    assert len(summary.summarise(sents, [3] * 5, 5, maxlen=7)) == 2
    apart = [i for i, _ in summary.summarise(sents, [3] * 5, 2, avoid_repeat=True)]
    assert 2 in apart
    assert summary.summarise([["only"]], [4], 3) and summary.summarise([[]], [0], 3) == [] and summary.summarise([["only"]], [4], 3, avoid_repeat=True)
    with pytest.raises(ValueError):
        summary.summarise(sents, [3] * 5, 0)
    matrix = summary.overlap_matrix(sents[:4])
    assert all(matrix[i, j] == pytest.approx(summary.overlap(sents[i], sents[j])) for i in range(4) for j in range(4) if i != j)
    df = spark.createDataFrame([(1, i, " ".join(s), s) for i, s in enumerate(sents)], "doc_id long, sent_id int, text string, words array<string>")
    assert [r.sent_id for r in summary.summary(df, 2).orderBy("rank").collect()] == [i for i, _ in summary.summarise(sents, [5, 5, 3, 3, 0], 2)]
    own = summary.summarise(sents, [3] * 5, 1, sim=lambda a, b: float("x" in a or "x" in b))
    assert own[0][0] == 2
    pairs = {(r.a, r.b): r.weight for r in summary.similar_pairs(df).collect()}
    assert pairs == pytest.approx({(i, j): matrix[i, j] for i in range(4) for j in range(i + 1, 4) if matrix[i, j]})


# -- new words --


def test_new_words_against_brute_force(spark):
    rng = np.random.default_rng(3)
    filler = [chr(0x4E00 + k) for k in range(60)]
    texts = ["".join(str(rng.choice(["葡萄", "珊瑚"])) + "".join(rng.choice(filler, rng.integers(1, 3))) for _ in range(30)) + ("，" if d % 2 else "") for d in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.text: r for r in newword.discover(df, 3, auto_param=False, min_freq=1e-3, min_entropy=1.0, min_aggregation=3).collect()}
    import re

    t = re.sub("[，\n]+", " ", "\n".join(texts))
    grams = [(t[p : p + k], t[p - 1 : p] if p else "", t[p + k : p + k + 1]) for p in range(len(t)) for k in (1, 2, 3) if p + k <= len(t) and " " not in t[p : p + k]]
    freq = {g: c / len(t) for g, c in Counter(g for g, _, _ in grams).items()}

    def ent(word, side):
        c = Counter(x[side] for x in grams if x[0] == word and x[side])
        return -sum(v / c.total() * math.log(v / c.total()) for v in c.values())

    want = {}
    for w, f in freq.items():
        if len(w) > 1 and f > 1e-3:
            agg = min(f / (freq[w[:i]] * freq[w[i:]]) for i in range(1, len(w)))
            if agg > 3 and ent(w, 1) > 1.0 and ent(w, 2) > 1.0:
                want[w] = (f, ent(w, 1), ent(w, 2), agg)
    assert {"葡萄", "珊瑚"} <= set(want) and set(got) == set(want)
    for w, x in want.items():
        r = got[w]
        assert (r.freq, r.left_ent, r.right_ent, r.agg) == pytest.approx(x)
        assert r.score == pytest.approx(math.log10(x[3]) * x[0] * (x[1] + x[2]))
    seeded = newword.discover(df, 3, auto_param=False, min_freq=1e-3, min_entropy=1.0, min_aggregation=3, threshold_seeds=["葡萄"], excluding=spark.createDataFrame([("珊瑚",)], "w string"))
    assert all(r.score > 0.9 * got["葡萄"].score and r.text != "珊瑚" for r in seeded.collect())
    assert newword.averages(newword.discover(df.where("false"))).first().avg_len == 0.0
    p = newword.auto_parameters(10_000)
    assert (p["min_entropy"], p["min_aggregation"]) == pytest.approx((math.log(10_000) / 10, 100 / 15))


# -- entities --


def test_entity_types_and_discovery(spark):
    flags = {"王明": "nr", "王明老师": "nr", "青山": "ns", "青山县": "nsf", "跑": "v"}
    t = tokens(spark, [["王明", "跑", "青山"], ["王明老师", "青山县", "王明"], ["青山", "王明老师", "青山县"]], flags)
    assert {(r.doc_id, r.entity, r.etype) for r in discover.entities(t).collect()} >= {(0, "王明", "人名"), (0, "青山", "地名"), (1, "青山县", "地名")}
    mentions, types, counts = discover.entity_discover(t, "NERP", 1)
    assert {frozenset(m) for m in mentions.values()} == {frozenset({"王明", "王明老师"}), frozenset({"青山", "青山县"})}
    assert set(types.values()) == {"人名", "地名"} and counts["王明"] == 2
    m2, _, _ = discover.entity_discover(t, "NFL", 1, threshold=0.999)
    assert {frozenset(m) for m in m2.values()} == {frozenset({"王明", "王明老师"}), frozenset({"青山", "青山县"})}
    own = discover.trained_vectors(t, dim=8, min_count=1)
    m3, _, _ = discover.entity_discover(t, "NFL", 1, threshold=1.1, vectors=own)
    assert set(map(frozenset, m3.values())) == set(map(frozenset, m2.values())) and own(["王明", "no such word"]).shape == (2, 8)
    rows = {(r.entity, r.etype, r.mention, r.n) for r in discover.entity_table(t, method="NERP", min_count=1).collect()}
    assert rows == {(e, types[e], m, counts[m]) for e, own in mentions.items() for m in own}
    with pytest.raises(ValueError):
        discover.entity_discover(t, "other")


def test_syllables_merge_names_of_one_type():
    sound = {"武磊": ("wu", "lei"), "吴磊": ("wu", "lei"), "吴力": ("wu", "li"), "乌类": ("wu", "lei")}
    named = [("武磊", "人名", 9), ("吴磊", "人名", 3), ("吴力", "人名", 2), ("乌类", "地名", 2)]
    out, _, _ = discover.merge(named, {}, list(range(4)), sound.get)
    assert {frozenset(v) for v in out.values()} == {frozenset({"武磊", "吴磊"}), frozenset({"吴力"}), frozenset({"乌类"})}
    out, types, _ = discover.merge(named, {}, list(range(4)), sound.get, {"li": ["lei"]}, 1)
    assert frozenset({"武磊", "吴磊", "吴力"}) in {frozenset(v) for v in out.values()} and types["武磊_人名"] == "人名"


# -- parsing and question answering --

REL = {"sv": parse.SUBJECT, "vo": parse.OBJECT, "att": parse.ATTRIBUTE, "cmp": parse.COMPLEMENT, "pob": parse.PREPOSITION, "root": "核心关系"}


def arcs(*rows):
    return [{"id": i, "word": w, "tag": t, "rel": REL.get(r, r), "head": h} for i, w, t, r, h in rows]


def test_triples():
    a = arcs((0, "老", "a", "att", 1), (1, "猫", "n", "sv", 2), (2, "吃", "v", "root", -1), (3, "小", "a", "att", 4), (4, "鱼", "n", "vo", 2))
    assert parse.triples_of(a) == [("老猫", "吃", "小鱼")]
    assert parse.triples_of(a, "None") == [("猫", "吃", "鱼")]
    assert parse.triples_of(a, "exclude_entity", {"n"}) == [("猫", "吃", "鱼")]
    b = arcs((0, "他", "r", "sv", 1), (1, "住", "v", "root", -1), (2, "在", "p", "cmp", 1), (3, "城里", "n", "pob", 2))
    assert parse.triples_of(b) == [("他", "住在", "城里")]
    assert parse.triples_of([]) == []
    loop = arcs((0, "甲", "n", "att", 1), (1, "乙", "v", "att", 0), (2, "丙", "n", "vo", 1))
    assert parse.triples_of(loop) == []  # a cycle ends
    with pytest.raises(ValueError):
        parse.triples_of(a, "some")


def test_masked_arcs_get_their_entities(spark):
    df = spark.createDataFrame([(arcs((0, "#球员#", "x", "sv", 1), (1, "跑", "v", "root", -1)), [(0, 3, "武球王", "武磊", "球员")])], "arcs array<struct<id:int,word:string,tag:string,rel:string,head:int>>, links array<struct<l:int,r:int,surface:string,entity:string,etype:string>>")
    for std, want in ((False, "武球王"), (True, "武磊")):
        (r,) = df.select(parse.with_entities(F.col("arcs"), F.col("links"), std).alias("a")).collect()
        assert (r.a[0].word, r.a[0].tag, r.a[1].word) == (want, "球员", "跑")


def test_question_answering(spark):
    facts = [("甲国", "签订", "丙约"), ("甲国", "签订", "乙约"), ("甲国", "签订", "乙约"), ("乙国", "位于", "东洲")]
    qa = kgqa.KGQA(spark.createDataFrame(facts, "s string, v string, o string"), Lexicon().add_typed_words({"国家": ["甲国", "乙国"]}))
    assert qa.kg.count() == 3
    assert qa.answer("甲国签订了什么？") == "丙约、乙约" or qa.answer("甲国签订了什么？") == "乙约、丙约"
    assert qa.answer("乙国和东洲什么关系") == "位于" and qa.answer("你是谁") == kgqa.NOTHING and qa.answer("签订位于") == kgqa.NOTHING
    qa.add_template((kgqa.ENTITY, kgqa.PREDICATE), "#国家#签订了哪些", lambda found, rows: f"{found[0]}:{len(rows)}")
    assert qa.answer("甲国签订了哪些") == "甲国:2"
    assert {tuple(r) for r in kgqa.pattern(qa.kg, v="签订").collect()} == {("甲国", "乙约"), ("甲国", "丙约")}
    assert kgqa.pattern(qa.kg, v="签订", limit=1).count() == 1
    assert kgqa.edit_distance("abcd", "acbd") == 1 and kgqa.edit_distance("", "ab") == 2
    assert kgqa.match_template("abc", ["abd", "abe"]) == "abd"


def test_pairs_counted_in_blocks(spark, monkeypatch):
    rows = [(d, f"w{(d * 7 + i * i) % 40}") for d in range(30) for i in range(12)] + [(3, "é"), (4, "é"), (3, "Z"), (4, "Z")]
    items = spark.createDataFrame(sorted(set(rows)), "doc_id long, item string")
    want = sorted(map(tuple, graph.pair_counts(items, 2).collect()))
    for size in (5, 100):
        monkeypatch.setattr(graph, "BLOCK_ITEMS", size)
        names = items.select("item").distinct()
        assert sorted(map(tuple, graph.block_pair_counts(items, names, names.count(), 2).collect())) == want
    plain = sorted(map(tuple, graph.ego_graph(items, "w3", 2).collect()))
    monkeypatch.setattr(graph, "FEW_ITEMS", 0)
    monkeypatch.setattr(graph, "BLOCK_ITEMS", 5)
    assert sorted(map(tuple, graph.ego_graph(items, "w3", 2).collect())) == plain


def test_textrank_of_blocks_is_that_of_tokens_without_a_shuffle(spark, monkeypatch):
    blocks = [[["a", "b", "a"], ["c", "b"]], [["x"]], [], None, [["a", "c", "c", "d", "a"]], [["b", "a"], []]]
    docs = spark.createDataFrame(list(enumerate(blocks)), "doc_id long, blocks array<array<string>>")
    for size, window in ((1, 2), (1 << 15, 2), (6, 3)):
        monkeypatch.setattr(keyword, "RANKED_WORDS", size)
        df = keyword.textrank_blocks(docs, 3, window)
        got = {d: [(r.word, r.score) for r in sorted((x for x in df.collect() if x.doc_id == d), key=lambda r: r.rank)] for d in range(6)}
        for d, own in enumerate(blocks):
            want = keyword.textrank_words(own or [], window, True)[:3]
            assert [w for w, _ in got[d]] == [w for w, _ in want] and [s for _, s in got[d]] == pytest.approx([s for _, s in want])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_so_pmi_shuffles_a_document_once(spark):
    rows = [(d, w) for d in range(8) for w in ("good", f"w{d % 2}", "good")] + [(None, "good"), (None, "w0")]
    tokens = spark.createDataFrame(rows, "doc_id long, word string")
    df = sentiment.build_sent_dict(tokens, ["good"], [], 1)
    assert {r.word for r in df.collect()} == {"good", "w0", "w1"}
    # the words of documents meet their seeds without a join by document
    assert "doc_id" not in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_blocks_of_similar_names(spark, monkeypatch):
    monkeypatch.setattr(discover, "BLOCK", 2)
    vectors = np.array([[1, i % 3 == 0] for i in range(40)], float)
    got = {(r.u, r.v) for r in discover.similar_names(spark, ["a"] * 40, vectors, 0.99).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if (i % 3 == 0) == (j % 3 == 0)}


def test_summaries_of_documents_shuffle_no_text(spark, data):
    """Before, sentences with their words went through a shuffle by document, and pandas took one document at a time."""
    from textloom.plans import catalogue

    for name in ("summary_topk", "mmr_summary"):
        text = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in text and "Aggregate" not in text and "MapGroups" not in text and "FlatMapGroups" not in text


def test_summaries_of_rows_and_of_documents_agree(spark):
    docs = [(1, ["a b c.", "a b d.", None, "x y.", "a b.", "", "a b c."]), (2, []), (3, None), (4, ["solo"])]
    rows = [(d, i, t, None if t is None else [w.strip(".") for w in t.split()]) for d, own in docs for i, t in enumerate(own or [])]
    flat = spark.createDataFrame(rows, "doc_id long, sent_id int, text string, words array<string>")
    whole = spark.createDataFrame([(d, None if own is None else [x[1:] for x in rows if x[0] == d]) for d, own in docs], "doc_id long, sents array<struct<sent_id: int, text: string, words: array<string>>>")
    for options in ({"k": 3}, {"k": 4, "avoid_repeat": True}, {"k": 5, "maxlen": 12}, {"k": 2, "sim": summary.overlap}):
        a, b = (sorted(map(tuple, f(x, **options).collect())) for f, x in ((summary.summary, flat), (summary.summary_docs, whole)))
        assert a == b and {x[0] for x in a} == {1, 4}
        own = [t.replace(".", "").split() if t else [] for t in docs[0][1]]
        want = summary.summarise(own, [len(t or "") for t in docs[0][1]], options["k"], options.get("maxlen", math.inf), options.get("avoid_repeat", False), options.get("sim"))
        assert [i for i, _ in want] == [x[1] for x in sorted(a, key=lambda x: x[4]) if x[0] == 1]
    # sentences 0 and 6 are equal: the first comes first, and not both where repeats are avoided
    assert [i for i, _ in summary.summarise(own, [9] * 7, 2, avoid_repeat=True)] in ([0, 3], [1, 3], [4, 3])
    for n in (summary.DENSE, summary.DENSE + 1):  # by the matrix, and by words
        sents = [[f"w{(i * j) % 31}" for j in range(i % 7)] for i in range(n)]
        assert summary.overlap_rank(sents) == pytest.approx(graph.pagerank_matrix(summary.overlap_matrix(sents)), abs=1e-9)


def _plain_tfidf(docs, k):
    n, df = sum(1 for own in docs.values() if own), Counter(w for own in docs.values() for w in set(own))
    out = set()
    for d, own in docs.items():
        score = {w: round(c / len(own) * (math.log((1 + n) / (1 + df[w])) + 1), 6) for w, c in Counter(own).items()}
        out |= {(d, w, score[w], i + 1) for i, w in enumerate(sorted(score, key=lambda w: (-score[w], w))[:k])}
    return out


@pytest.mark.parametrize("known", [1 << 20, 20, 0])
def test_tfidf_of_documents(spark, monkeypatch, known):
    """All frequencies known to the workers, some, none: the same rows.  Ties go by name, repeated ids are one document."""
    monkeypatch.setattr(keyword, "KNOWN_WORDS", known)
    monkeypatch.setattr(keyword, "COUNTED_TOKENS", 50)
    rng = np.random.default_rng(7)
    docs = {d: [f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 40)) % 90] for d in range(60)}
    rows = [(d, own) for d, own in docs.items()] + [(100, ["b", "a"]), (100, ["a", "c", "d", "e"]), (101, None), (102, [])]
    docs[100] = ["b", "a", "a", "c", "d", "e"]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>")
    want = _plain_tfidf(docs, 3)
    for got in (keyword.tfidf_words(df, 3, 6), keyword.tfidf(df.select("doc_id", F.explode("words").alias("word")), 3, decimals=6)):
        got = [(r.doc_id, r.word, round(r.score, 6), r["rank"]) for r in got.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_keywords_of_documents_shuffle_no_token(spark, data):
    """Before, tokens met their counts, frequencies and ranks in five shuffles."""
    from textloom.plans import catalogue, catalogue_more  # noqa: F401

    for name in ("tfidf_topk", "keywords_by_tag"):
        text = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in text and not any(x in text for x in ("Join", "Window", "Aggregate"))
    text = keyword.evaluate(*(spark.createDataFrame([(1, "a")], "doc_id long, word string") for _ in "ft"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text
    empty = spark.createDataFrame([], "doc_id long, word string")
    assert tuple(keyword.evaluate(empty, empty).first()) == (None, None, None)
    assert keyword.tfidf_words(spark.createDataFrame([], "doc_id long, words array<string>"), 3).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 5])
def test_window_pairs_of_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(keyword, "PAIR_TOKENS", limit)
    monkeypatch.setattr(keyword, "PAIR_ROWS", limit)
    rng = np.random.default_rng(3)
    docs = [[f"w{x}" for x in rng.zipf(1.5, n) % 9] for n in (0, 1, 2, 3, 30, 8)] + [None, ["é", "é", "é"]]
    want = Counter((a, b) for own in docs if own for x in (1, 2) for a, b in zip(own, own[x:]))
    df = spark.createDataFrame([(own,) for own in docs], "words array<string>").repartition(2)
    got = [tuple(r) for r in keyword.window_pair_counts(df, 3).collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_window_pairs_shuffle_counts_only(spark, data):
    """Before, every token was shuffled to a window of its document."""
    from textloom.plans import catalogue

    text = catalogue.QUERIES["window_pairs"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "Window" not in text
