from __future__ import annotations

import re
import time
import urllib.parse

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import clean
from textloom.operators import linking as K
from textloom.operators import retrieve as R
from textloom.operators import tokenize as T
from textloom.operators.lexicon import Lexicon
from textloom.operators.tokenize import Dictionary
from textloom.plans import batches

LEX = Lexicon().add_entities({"武磊": ["武磊", "武球王"], "郜林": ["郜林"], "前锋": ["前锋"], "上海上港": ["上港"]}, {"武磊": "球员", "郜林": "球员", "前锋": "位置", "上海上港": "球队"})
DOCS = [(0, "武磊真棒！"), (1, "郜林今天没有进球。"), (2, "武球王是最强前锋。"), (3, "上港派出武磊，对面是郜林，两人都是前锋"), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def fold(lexicon, strategy, texts, **seeds):
    linker = K.Linker(K.Matcher(lexicon.candidates()), K._mentions_of(lexicon), K.seeded(strategy, lexicon, **seeds))
    return [[(l, r, e) for l, r, _, e, _ in linker.link(t)] for t in texts]


def test_longest_mention_from_left_to_right(docs):
    got = [tuple(r) for r in K.links_table(docs, LEX).where("doc_id = 3").orderBy("l").collect()]
    assert [(l, r, e) for _, l, r, _, e, _ in got] == [(0, 2, "上海上港"), (4, 6, "武磊"), (10, 12, "郜林"), (17, 19, "前锋")]


@given(st.text(alphabet="ab甲乙.", max_size=40), st.sets(st.text(alphabet="ab甲乙.", min_size=1, max_size=4), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_scan_is_greedy_and_without_overlap(text, mentions):
    m = K.Matcher({x: [(x, "t")] for x in mentions})
    spans, at, want = list(m.scan(text)), 0, []
    while at < len(text):
        hit = max((x for x in mentions if text.startswith(x, at)), key=len, default=None)
        if hit:
            want.append((at, at + len(hit)))
        at += len(hit or "x")
    assert spans == want and all(text[a:b] in mentions for a, b in spans)


def test_join_and_regex_agree_with_the_udf(docs):
    by_udf = sorted(tuple(r) for r in K.links_table(docs, LEX).collect())
    assert sorted(tuple(r) for r in K.link_by_join(docs, LEX.joined_df(docs.sparkSession)).collect()) == by_udf
    surfaces = docs.select("doc_id", F.explode(K.surfaces(F.col("text"), LEX))).collect()
    assert sorted(map(tuple, surfaces)) == sorted((r[0], r[3]) for r in by_udf)


def test_join_links_long_mentions(spark):
    """Longer than max_len, over a window's edge, with a shorter mention inside, and one of which only the start is there."""
    long, other = "The Extraordinarily Long Name of an Organisation, Limited", "The Extraordinarily Long Name of a Title of a Book"
    lex = Lexicon().add_entities({"org": [long], "book": [other], "name": ["Long Name"]})
    rows = [(1, f"x {long} y"), (2, "z" * (K.WINDOW - 20) + f" {long} {other}"), (3, other[:-1]), (4, None), (5, f"{long[:40]} {long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, K.link_by_join(df, lex.joined_df(spark)).collect()))
    assert got == sorted(map(tuple, K.links_table(df, lex).collect()))
    assert [r[3] for r in got if r[0] == 2] == [long, other]


def test_latest_mention_decides():
    lex = Lexicon().add_entities({"甲师傅": ["甲师傅", "师傅"], "乙师傅": ["乙师傅", "师傅"]})
    assert fold(lex, "latest", ["乙师傅早。师傅忙吗"]) == [[(0, 3, "乙师傅"), (5, 7, "乙师傅")]]
    assert fold(lex, "latest", ["谢谢师傅"], latest={"师傅": "乙师傅"}) == [[(2, 4, "乙师傅")]]
    assert fold(lex, "None", ["谢谢师傅"]) == [[(2, 4, "乙师傅")]]  # lexicographically first: 乙 < 甲


def test_frequency_decides_between_candidates_and_overlaps():
    lex = Lexicon().add_entities({"甲": ["站长"], "乙": ["站长"]})
    assert fold(lex, "freq", ["站长"], entity_freq={"甲": 5, "乙": 3}) == [[(0, 2, "甲")]]
    lex = Lexicon().add_entities({"老站长": ["老站长"], "长河": ["长河水"]})
    assert fold(lex, "freq", ["老站长河水"], entity_freq={"老站长": 3, "长河": 5}) == [[(2, 5, "长河")]]
    lex = Lexicon().add_entities({"小石城": ["小石城"], "石城": ["石城"]}, {"小石城": "人名", "石城": "地名"})
    assert fold(lex, "freq", ["叫小石城"], type_freq={"地名": -1}) == [[(1, 4, "小石城")]]
    with pytest.raises(ValueError):
        K.seeded("newest", lex)


def test_memory_is_scoped(spark):
    lex = Lexicon().add_entities({"甲师傅": ["甲师傅", "师傅"], "乙师傅": ["乙师傅", "师傅"]})
    df = spark.createDataFrame([(1, 1, "甲师傅"), (1, 2, "师傅"), (2, 3, "师傅")], "room int, doc_id long, text string")
    got = {r.doc_id: [x.entity for x in r.links] for r in K.link_with_memory(df, lex, "latest", scope_col="room").collect()}
    assert got == {1: ["甲师傅"], 2: ["甲师傅"], 3: ["乙师傅"]}
    alone = {r.doc_id: [x.entity for x in r.links] for r in K.link_with_memory(df, lex, "latest").collect()}
    assert alone[2] == ["乙师傅"]


def test_keep_all_gives_every_candidate(spark):
    lex = Lexicon().add_entities({"李一": ["李某"], "李二": ["李某"]}, {"李一": "运动员", "李二": "歌手"})
    df = spark.createDataFrame([(1, "李某和李某")], "doc_id long, text string")
    (r,) = df.select(K.link_all(F.col("text"), lex, spark).alias("x")).collect()
    assert [[c.entity for c in x.cands] for x in r.x] == [["李一", "李二"]] * 2


def test_mask_and_standard_names(docs, spark):
    d = docs.withColumn("x", K.link(F.col("text"), LEX, spark))
    got = {r.doc_id: (r.m, r.s) for r in d.select("doc_id", K.mask(F.col("text"), F.col("x")).alias("m"), K.standardise(F.col("text"), F.col("x")).alias("s")).collect()}
    assert got[2] == ("#球员#是最强#位置#。", "武磊是最强前锋。")
    assert got[4] == ("", "") and got[5] == (None, None)


def test_fuzzy_candidates_and_recheck(spark):
    words = spark.createDataFrame([("吴磊", ["wu", "lei"]), ("吴力", ["wu", "li"]), ("别人", ["bie", "ren"])], "word string, syllables array<string>")
    mentions = spark.createDataFrame([("武磊", ["wu", "lei"])], "mention string, syllables array<string>")
    near = spark.createDataFrame([("li", "lei")], "p string, neighbor string")
    for tolerance, want in ((0, {"吴磊"}), (1, {"吴磊", "吴力"})):
        assert {r.word for r in K.pinyin_candidates(words, mentions, near, tolerance).collect()} == want
    chars = K.char_candidates(words, mentions)
    assert {tuple(r) for r in chars.collect()} == {("吴磊", "武磊")}
    assert K.char_candidates(words, mentions, 0).count() == 0
    tokens = spark.createDataFrame([(1, "武磊", "球员", 0, 2, True), (1, "和", "c", 2, 3, False), (1, "吴磊", "nr", 3, 5, False)], "doc_id long, word string, flag string, l int, r int, is_entity boolean")
    lex = Lexicon().add_typed_words({"球员": ["武磊"]})
    links = K.links_table(spark.createDataFrame([(1, "武磊和吴磊")], "doc_id long, text string"), lex)
    got = K.recheck(tokens, links, chars, lex.joined_df(spark)).orderBy("l").collect()
    assert [(r.l, r.r, r.entity) for r in got] == [(0, 2, "武磊"), (3, 5, "武磊")]
    assert K.candidate_spans(tokens, chars).collect()[0].mentions == ["武磊"]
    assert K.lookup(spark.createDataFrame([("武磊",), ("谁",)], "mention string"), lex.joined_df(spark)).where("entity is null").count() == 1


def test_link_filter(spark):
    row = [([(0, 2, "ab", "e", "t"), (3, 4, "d", "e", "t"), (4, 6, "ef", "e", "t")], ["v", "d", "n", "n", "n", "v"])]
    df = spark.createDataFrame(row, "links array<struct<l:int,r:int,surface:string,entity:string,etype:string>>, tags array<string>")
    (r,) = df.select(K.filter_links(F.col("links"), F.col("tags")).alias("x")).collect()
    assert [(x.l, x.r) for x in r.x] == [(4, 6)]


# -- the lexicon --


def test_lexicon_is_immutable_and_additive():
    a = Lexicon().add_new_words(["甲", "乙"])
    b = a.add_new_entity("丙", "小丙", "人名").add_new_mentions({"甲": ["阿甲"]})
    assert set(a.types) == {"甲", "乙"} and a.types["甲"] == "新词"
    assert b.mention2entity("阿甲") == ("甲", "新词") and b.mention2entity("这是小丙吗") == ("丙", "人名")
    assert b.mention2entity("无") == (None, None)
    assert b.remove_mention("阿甲").mention2entity("阿甲") == ("甲", "新词")
    assert "丙" not in b.remove_entity("丙").types and b.clear().pairs == frozenset()
    assert b.add_typed_words({"城市": ["甲"]}).types["甲"] == "城市"
    assert b.tag_of("人名") == "nr" and b.tag_of("城市") == "n"
    with pytest.raises(KeyError):
        a.add_new_mentions({"没有": ["x"]})
    for bad in ("位,置", "a|b", "类型。"):
        with pytest.raises(ValueError):
            a.add_new_entity("x", "x", bad)


def test_lexicon_files(spark, tmp_path):
    LEX.save_text(spark, f"{tmp_path}/t")
    again = Lexicon.load_text(spark, f"{tmp_path}/t")
    assert (again.types, again.pairs) == (LEX.types, LEX.pairs)
    LEX.save(spark, f"{tmp_path}/p")
    again = Lexicon.load(spark, f"{tmp_path}/p")
    assert (dict(again.types), again.pairs) == (dict(LEX.types), LEX.pairs)


# -- retrieval --


def test_index_counts_and_search(docs):
    index = R.build_index(docs, LEX)
    assert {tuple(r) for r in R.entity_counts(index, LEX).collect()} == {("武磊", 3), ("郜林", 2), ("前锋", 2), ("上海上港", 1)}
    assert {tuple(r) for r in R.entity_counts(index.where("doc_id in (2, 3)"), LEX, ["球员"]).collect()} == {("武磊", 2), ("郜林", 1)}
    for query, want in (("武磊", [0, 2, 3]), ("武磊 郜林", [3]), ("#球员# 前锋", [2, 3]), ("", []), ("没有", []), (["武磊", "#位置#"], [2, 3])):
        assert [r.doc_id for r in R.search(docs, index, query).collect()] == want
    assert {r.term: r.doc_ids for r in R.postings(index).collect()}["#球员#"] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        R.build_index(docs, Lexicon())


# -- segmentation --

WORDS = Dictionary({"今天": (50, "t"), "没有": (60, "v"), "进球": (20, "v"), "是": (90, "v"), "最": (30, "d"), "最强": (25, "a"), "派出": (9, "v"), "对面": (9, "f")})


def test_entities_are_single_tokens(docs, spark):
    got = {r.doc_id: r.t for r in docs.select("doc_id", T.posseg(F.col("text"), LEX, spark, WORDS).alias("t")).collect()}
    assert [(t.word, t.flag) for t in got[2]] == [("武球王", "球员"), ("是", "v"), ("最强", "a"), ("前锋", "位置"), ("。", "x")]
    for i, text in DOCS:
        assert got[i] is None if text is None else "".join(t.word for t in got[i]) == text
    named = {r.doc_id: r.t for r in docs.select("doc_id", T.seg(F.col("text"), LEX, spark, WORDS, {"是", "前锋", "。"}, standard_name=True, return_sent=True).alias("t")).collect()}
    assert named[2] == "武磊 最强 前锋"  # entities are never stop words


def test_dictionary_path_is_the_most_probable(spark):
    assert Dictionary({"北京": (100, None), "京城": (2, None), "城里": (100, None)}).cut("北京城里") == ["北京", "城里"]
    assert WORDS.cut("abc12甲") == ["abc", "12", "甲"] and WORDS.cut("") == []
    table = spark.createDataFrame([("今天", 50, "t")], "word string, freq long, pos string")
    assert Dictionary.from_table(table).tag("今天") == "t"
    with pytest.raises(ValueError):
        Dictionary.from_table(table.union(table), limit=1)
    tokens = spark.createDataFrame([("ab c",)], "text string").select("text", T.posseg(F.col("text"), Lexicon(), spark).alias("t"))
    (r,) = tokens.select(T.char_tags(F.col("t"), F.col("text")).alias("x")).collect()
    assert r.x == ["eng", "eng", None, "eng"]


def test_many_mentions_that_begin_alike_meet_by_their_whole_text(spark):
    lex = Lexicon().add_entities({f"Customer#{i:05d}": [f"Customer#{i:05d}"] for i in range(300)} | {"Cu": ["Cu"], "C": ["C"]})
    texts = {1: "Does Customer#00007 know Customer#00299?", 2: "Customer#0000 C Cu", 3: "CuCustomer#00001"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    joined = K.link_by_join(docs, lex.joined_df(spark))
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, K.links_table(docs, lex).collect()))
    conditions = [x for x in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert conditions and not any("StartsWith" in x for x in conditions)


def test_filter_links_tags_a_text_once(spark):
    df = spark.createDataFrame([("ab CD " * 3000,)], "text string").withColumn("x", K.link(F.col("text"), Lexicon().add_typed_words({"t": ["CD", "ab"]}), spark))
    tag = lambda c: F.when(c.rlike("[A-Z]"), F.lit("n")).otherwise(F.lit("v"))
    whole = K.filter_links(F.col("x"), F.transform(F.split("text", ""), tag))
    own = K.filter_links(F.col("x"), lambda x: F.transform(F.split(x["surface"], ""), tag))
    begun = time.time()
    (r,) = df.select(whole.alias("a"), own.alias("b")).collect()
    assert [x.surface for x in r.a] == ["CD"] * 3000 and r.a == r.b and time.time() - begun < 60  # hours where each link tags the text


def test_matcher_by_regex_and_by_steps_agree(monkeypatch):
    cands = {m: [(m, "t")] for m in ("a", "ab", "abc", "b.", "c+d", "中文")}
    text = "abcab.ac+d中文中b.xabx"
    fast = list(K.Matcher(cands).scan(text))
    monkeypatch.setattr(K, "ALTERNATIVES", 0)
    assert fast == list(K.Matcher(cands).scan(text)) and len(fast) > 5


def test_python_over_text_goes_in_pieces(spark, monkeypatch):
    texts = [None, "", "a" * 50, "moron b", "tion x" * 9]
    got = [list(batches.pieces(pa.array(texts, pa.string()), n)) for n in (1, 100, 10**6)]
    assert got[0] == [(i, i + 1) for i in range(5)] and got[2] == [(0, 5)] and [b for _, b in got[1]][-1] == 5
    sizes = []
    monkeypatch.setattr(batches, "PIECE_BYTES", 64)
    f = batches.in_pieces(lambda own: sizes.append(len(own)) or pa.array(own, pa.string()), pa.string())
    assert f(pa.array(texts, pa.string())).to_pylist() == texts and len(sizes) > 1 and f(pa.array([], pa.string())).to_pylist() == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    own = df.select("doc_id", F.explode(T.posseg(F.col("text"), LEX, spark)).alias("t")).select("doc_id", "t.*")
    table = T.posseg_table(df, LEX)
    assert table.schema == own.schema and sorted(map(str, table.collect())) == sorted(map(str, own.collect()))


def test_percent_decoding_sends_python_hard_texts_only(spark):
    df = spark.createDataFrame([("a%20b+c",), ("50% off %41",), (None,), ("plain",), ("%FF",)], "t string")
    got = [r[0] for r in df.select(clean.percent_decode(F.col("t"))).collect()]
    assert got == [None if r.t is None else urllib.parse.unquote(r.t) for r in df.collect()]
    plan = df.select(clean.percent_decode(F.col("t"))).where("true")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan[plan.index("ArrowEvalPython") :]


def test_spans_of_documents(spark, monkeypatch):
    """Before, a window a document shuffled every token."""
    texts = {1: "  ab, cde é f", 2: "", 3: None, 4: "..", 5: "😀ab" + "cd ef" * 40, 6: "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {(d, i, m.group(), m.start(), m.end()) for d, t in texts.items() for i, m in enumerate(re.finditer("[A-Za-z]+", t or ""))}
    for rows in (1 << 16, 3):
        monkeypatch.setattr(T, "SPAN_ROWS", rows)
        got = T.spans_table(df, pattern="[A-Za-z]+")
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert {tuple(r) for r in T.spans_table(df, pattern="[A-Za-z]+", sizes=[1, 3]).collect()} == {x for x in want if len(x[2]) in (1, 3)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
