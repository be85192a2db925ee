"""Queries over the driver tables, one for each operator family, with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clean, patterns, segment, similarity
from ..operators import discover, graph, keyword, kgqa, linking, newword, paragraphs, parse, retrieve, sentiment, summary, tokenize
from ..operators.lexicon import Lexicon
from .small import local, repeated, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STOP = ["the", "of", "and", "de", "la", "der", "und", "el", "los", "is", "to", "in"]
POS_SEEDS, NEG_SEEDS = ["and", "licensed", "rights"], ["idiot", "moron", "worthless", "disgusting"]
LEXICON = Lexicon().add_entities(
    {"insult": ["idiot", "moron"], "scorn": ["worthless", "disgusting"], "apache": ["Apache License", "Apache License, Version 2.0"], "rights": ["All rights reserved"], "ment": ["ment", "mente"], "keit": ["keit", "heit"], "cion": ["ción"], "tion": ["tion", "edtion"]},
    {"insult": "toxic", "scorn": "toxic", "apache": "legal", "rights": "legal", "ment": "suffix", "keit": "suffix", "cion": "suffix", "tion": "suffix"},
)
#: A surface shared by two entities, for the candidate operators.
AMBIGUOUS = LEXICON.add_new_entity("tion2", "tion", "ending")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# -- cleaning --


def gsub(text: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"


def cleaning(name: str, expression: Callable[[Column], Column], sql: str, source: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, expression(F.col(column)).alias("cleaned"))

    run.__name__ = name
    register(f"select {key}, {sql} as cleaned from {source}" if sql else None)(run)


_SPACE = r"[ \t\n\x0b\f\r]"
_PUNCT_RE2 = clean.char_class(clean.PUNCTUATION)
_PICTO = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in clean.PICTOGRAPHS) + "]+"
_STRIP = rf"^{_SPACE}+|{_SPACE}+$"
_AT = r"(?:回复)?(?://)?\s*@\S*?\s*(?::|：| |$)"
_default = "text"
for _p, _n in ((r"[\x{200b}-\x{200d}]", ""), (r"\\u200[b-d]", ""), (clean.TAG, ""), (r"\[(.+?)\]\(\S+\)", r"\1"), (r"\[\S{1,6}?\]", ""), (_PICTO, ""), ("(?i)" + clean.URL, ""), (clean.EMAIL, ""), (_AT, " "), (rf"({_SPACE})+", r"\1"), ("转发微博", ""), (_STRIP, "")):
    _default = gsub(_default, _p, _n)

cleaning("clean_default", clean.clean_text, _default)
cleaning("clean_email_at", lambda t: clean.replace(clean.replace(t, clean.EMAIL), r"(?U)(?d)(?:回复)?(?://)?\s*@\S*?\s*(?::|：| |$)", " "), gsub(gsub("text", clean.EMAIL), _AT, " "))
cleaning("clean_space", lambda t: clean.strip(clean.replace(t, r"(?U)(\s)+", "$1")), gsub(gsub("text", rf"({_SPACE})+", r"\1"), _STRIP))
cleaning("clean_linesep", lambda t: F.replace(t, F.lit("\n"), F.lit(" ")), "replace(text, chr(10), ' ')")
cleaning("clean_topic", lambda t: clean.replace(t, "(?d)#.+#"), gsub("text", "#.+#"))
cleaning("clean_puncts", lambda t: clean.replace(t, clean.char_class(clean.PUNCTUATION)), gsub("text", _PUNCT_RE2))
cleaning("clean_stop_terms", lambda t: F.replace(F.replace(t, F.lit("tion"), F.lit("")), F.lit("idiot"), F.lit("")), "replace(replace(text, 'tion', ''), 'idiot', '')")
cleaning("clean_markdown", lambda t: clean.replace(t, r"(?U)(?d)\[(.+?)\]\(\S+\)", "$1"), gsub("text", r"\[(.+?)\]\(\S+\)", r"\1"))
cleaning("clean_emoticon", lambda t: clean.replace(clean.replace(t, r"(?U)\[\S{1,6}?\]"), _PICTO), gsub(gsub("text", r"\[\S{1,6}?\]"), _PICTO))
cleaning("clean_zero_width", lambda t: clean.replace(clean.replace(t, r"[\x{200b}-\x{200d}]"), r"\\u200[b-d]"), gsub(gsub("text", r"[\x{200b}-\x{200d}]"), r"\\u200[b-d]"))
cleaning("clean_custom_regex", lambda t: clean.clean_text(t, custom_regex=[r"\d{3,}", r"\|"], remove_tags=False, emoji=False, weibo_at=False, email=False, remove_url=False, markdown_hyperlink=False), gsub(gsub(gsub(gsub("text", r"\d{3,}"), r"\|"), rf"({_SPACE})+", r"\1"), _STRIP))
cleaning("clean_translate", lambda t: clean.to_simplified(t, {"é": "e", "ü": "u", "ñ": "n"}), "translate(text, 'éüñ', 'eun')")
cleaning("only_han", clean.only_han, gsub("text", r"[^\x{4e00}-\x{9fa5}]"))
cleaning("clean_tags", lambda t: clean.replace(t, clean.TAG), gsub("html", clean.TAG), "pages", "page_id", "html")
cleaning("clean_url", lambda t: clean.replace(t, "(?i)" + clean.URL), gsub("html", "(?i)" + clean.URL), "pages", "page_id", "html")
cleaning("clean_url_encode", clean.percent_encode, "replace(replace(url_encode(url), '%2F', '/'), '*', '%2A')", "pages", "page_id", "url")
# Spark's own form encoding, in which blanks are plus signs, is decoded
cleaning("clean_url_decode", lambda t: clean.percent_decode(F.url_encode(t)), "replace(html, ' ', '+')", "pages", "page_id", "html")
cleaning("clean_html_unescape", clean.unescape_html, "", "pages", "page_id", "html")

# -- segmentation --

_cut = "text"
for _p, _n in ((r"([。！？?!])([^”’)\]）】])", r"\1" + "\n" + r"\2"), (r"(\.{3,})([^”’)\]）】….])", r"\1" + "\n" + r"\2"), (r"(…+)([^”’)\]）】….])", r"\1" + "\n" + r"\2"), (r"([。！？?!]|\.{3,}|…+)([”’)\]）】])([^，。！？?….])", r"\1\2" + "\n" + r"\3"), (r"\s+$", "")):
    _cut = gsub(_cut, _p, _n)


@register(f"""with s as (select doc_id, trim({gsub("x", _STRIP)}) as sentence, i from (select doc_id, unnest(string_split({_cut}, chr(10))) as x, unnest(range(len(string_split({_cut}, chr(10))))) as i from documents))
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::integer as pos, sentence from s where sentence <> ''""")
def cut_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(segment.cut_sentences(F.col("text"))).alias("pos", "sentence"))


@register("""with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?][''"”’)\\]]*)[ \\t\\n\\x0b\\f\\r]+', '\\1\u0001', 'g'), '\u0001')) as x, generate_subscripts(string_split(regexp_replace(text, '([.!?][''"”’)\\]]*)[ \\t\\n\\x0b\\f\\r]+', '\\1\u0001', 'g'), '\u0001'), 1) as i from documents),
t as (select doc_id, i, regexp_replace(x, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g') as sentence from s)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::integer as pos, sentence from t where sentence <> ''""")
def cut_sentences_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(segment.cut_sentences(F.col("text"), language="en")).alias("pos", "sentence"))


@register(f"select doc_id, (p / 500)::integer as pos, substring(t, p + 1, 500) as chunk from (select doc_id, t, unnest(range(0, length(t), 500)) as p from (select doc_id, {gsub('text', _STRIP)} as t from documents))")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(segment.chunks(F.col("text"), 500)).alias("pos", "chunk"))


TOK = r"(select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents))"


@register(f"select doc_id, word, count(*) as tf from {TOK} group by all")
def tokens_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.tokens_table(docs(spark, sf_dir)).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


@register(f"select word, count(distinct doc_id) as df, count(*) as cf from {TOK} group by all")
def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tokenize.tokens_table(docs(spark, sf_dir)).groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return one.groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


@register(f"select doc_id, count(*) as n from {TOK} where word not in {_STOP_SQL} group by all")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.without(tokenize.tokens_table(docs(spark, sf_dir)), STOP).groupBy("doc_id").agg(F.count("*").alias("n"))


@register()
def auto_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.cut_paragraphs(docs(spark, sf_dir), language="en", stopwords=set(STOP))


# -- rules --

RULES = [(patterns.all_english(), patterns.ends_with("tion"), patterns.with_length(8)), (patterns.starts_with("re"), patterns.contains("ing")), patterns.contains("^idiot$")]


@register(r"select distinct word from (select unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as word from documents) where (regexp_full_match(word, '[a-zA-Z]*') and suffix(word, 'tion') and length(word) = 8) or (prefix(word, 're') and regexp_matches(word, 'ing')) or word = 'idiot'")
def rules_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenize.tokens_table(docs(spark, sf_dir), lower=False)
    return newword.find_with_rules(words, patterns.any_of(RULES))


@register(r"""select count(*) filter (where regexp_full_match(word, '[a-zA-Z]*')) as all_english, count(*) filter (where regexp_full_match(word, '[a-zA-Z0-9]*')) as all_english_or_num,
  count(*) filter (where regexp_matches(word, '^[A-Z]')) as upper_first, count(*) filter (where prefix(word, 'th')) as starts, count(*) filter (where suffix(word, 'ing')) as ends,
  count(*) filter (where regexp_matches(word, 'e.e')) as contains, count(*) filter (where length(word) = 5) as with_length from (select unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as word from documents)""")
def pattern_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"all_english": patterns.all_english(), "all_english_or_num": patterns.all_english_or_num(), "upper_first": patterns.upper_first(), "starts": patterns.starts_with("th"), "ends": patterns.ends_with("ing"), "contains": patterns.contains("e.e"), "with_length": patterns.with_length(5)}
    words = tokenize.tokens_table(docs(spark, sf_dir), lower=False)
    return words.agg(*(F.count_if(r(F.col("word"))).alias(k) for k, r in rules.items()))


# -- linking and retrieval --

_ALT = "|".join(sorted({m for m, _ in LEXICON.pairs}, key=lambda m: (-len(m), m))).replace(".", r"\.")
_LEX = "(values " + ", ".join(f"('{m}', '{e}', '{LEXICON.types[e]}')" for m, e in sorted(LEXICON.pairs)) + ") as lex(mention, entity, etype)"
_SPLIT = f"""(select doc_id, i, surface, l::integer as l, (l + length(surface))::integer as r from (
  select doc_id, i, surface, sum(length(gap)) over w + coalesce(sum(length(surface)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as l
  from (select doc_id, unnest(s) as surface, unnest(g[1:len(s)]) as gap, unnest(range(len(s))) as i from (select doc_id, regexp_extract_all(text, '{_ALT}') as s, regexp_split_to_array(text, '{_ALT}') as g from documents))
  window w as (partition by doc_id order by i rows unbounded preceding)))"""
_FOUND = f"(select distinct doc_id, entity, etype from (select doc_id, unnest(regexp_extract_all(text, '{_ALT}')) as mention from documents) join {_LEX} using (mention))"
_INDEX = f"(select entity as term, doc_id from {_FOUND} union select '#' || etype || '#', doc_id from {_FOUND})"


@register(f"select doc_id, l, r, surface, entity, etype from {_SPLIT} join {_LEX} on surface = mention")
def link_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.links_table(docs(spark, sf_dir), LEXICON)


@register(f"select doc_id, l, r, surface, entity, etype from {_SPLIT} join (select * from {_LEX} union all select 'tion', 'tion2', 'ending') on surface = mention")
def link_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = docs(spark, sf_dir).select("doc_id", F.explode(linking.link_all(F.col("text"), AMBIGUOUS, spark)).alias("x")).select("doc_id", "x.*")
    return got.select("doc_id", "l", "r", "surface", F.explode("cands").alias("c")).select("doc_id", "l", "r", "surface", "c.*")


@register(f"select doc_id, l, r, surface, entity, etype from {_SPLIT} join {_LEX} on surface = mention")
def link_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_by_join(docs(spark, sf_dir), LEXICON.joined_df(spark))


@register()
def link_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_with_memory(docs(spark, sf_dir), AMBIGUOUS, "freq", type_freq={"ending": 2})


@register()
def link_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return linking.link_with_memory(d, AMBIGUOUS, "latest", scope_col="conv_id", id_col="turn")


@register(f"select term, doc_id from {_INDEX}")
def inv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.build_index(docs(spark, sf_dir), LEXICON)


@register(f"select entity, count(distinct doc_id) as n from {_FOUND} group by entity")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.entity_counts(retrieve.build_index(docs(spark, sf_dir), LEXICON, with_type=False), LEXICON)


@register(f"select entity, count(distinct doc_id) as n from {_FOUND} where etype = 'suffix' group by entity")
def entity_counts_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.entity_counts(retrieve.build_index(docs(spark, sf_dir), LEXICON), LEXICON, ["suffix"])


@register(f"select doc_id, text from documents where doc_id in (select doc_id from {_FOUND} where entity = 'insult' intersect select doc_id from {_FOUND} where entity = 'tion')")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return retrieve.search(d, retrieve.build_index(d, LEXICON), "insult tion")


@register(f"select doc_id, text from documents where doc_id in (select doc_id from {_INDEX} where term = '#legal#' intersect select doc_id from {_INDEX} where term = 'ment')")
def search_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return retrieve.search(d, retrieve.build_index(d, LEXICON), "#legal# ment")


_TOKENS_SEEN = f"(select distinct word from {TOK} where length(word) = 5)"
_WORDS5 = ["idiot", "moron", "thing", "ating", "heeat"]


@register("select w.word, m.mention from " + _TOKENS_SEEN + " w, (values " + ", ".join(f"('{w}')" for w in _WORDS5) + ") m(mention) where " + " + ".join(f"(substring(w.word, {i}, 1) <> substring(m.mention, {i}, 1))::int" for i in range(1, 6)) + " <= 1")
def fuzzy_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenize.tokens_table(docs(spark, sf_dir)).where(F.length("word") == 5).select("word").distinct()
    return linking.char_candidates(words, local(spark, [(w,) for w in _WORDS5], "mention string"))


# -- graphs --

_EDGES = "select a.entity as u, b.entity as v, count(*) as weight from {f} a join {f} b on a.doc_id = b.doc_id and a.entity < b.entity group by all having count(*) >= {n}"


@register(_EDGES.format(f=_FOUND, n=2))
def entity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_graph(retrieve.entity_docs(docs(spark, sf_dir), LEXICON), 2)


@register(_EDGES.format(f=_FOUND, n=2))
def entity_graph_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_graph_from_index(retrieve.build_index(docs(spark, sf_dir), LEXICON, with_type=False), LEXICON.entities_df(spark), 2)


@register(_EDGES.format(f=f"(select * from {_FOUND} where etype = 'suffix')", n=0))
def entity_graph_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_graph(retrieve.entity_docs(docs(spark, sf_dir), LEXICON), used_types=["suffix"])


def _ego_sql(items: str, center: str, low: int, other: int) -> str:
    return f"""with i as (select distinct doc_id, item from {items}), o as (select * from i where doc_id in (select doc_id from i where item = '{center}')),
e as (select a.item as u, b.item as v, count(*) as weight from o a join o b on a.doc_id = b.doc_id and a.item < b.item group by all),
k as (select * from e where weight >= case when '{center}' in (u, v) then {low} else {other} end),
n as (select '{center}' as node union select case when u = '{center}' then v else u end from k where '{center}' in (u, v))
select u, v, weight from k where u in (select node from n) and v in (select node from n)"""


@register(_ego_sql(f"(select doc_id, entity as item from {_FOUND})", "insult", 1, 3))
def entity_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = retrieve.entity_docs(docs(spark, sf_dir), LEXICON).select("doc_id", F.col("entity").alias("item"))
    return graph.ego_graph(items, "insult", 1, 3)


@register(_ego_sql(f"(select doc_id, word as item from {TOK} where word not in {_STOP_SQL})", "idiot", 4, 4))
def word_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tokenize.without(tokenize.tokens_table(docs(spark, sf_dir)), STOP).select("doc_id", F.col("word").alias("item"))
    return graph.ego_graph(items, "idiot", 4)


# -- sentiment --

_SEEDS = "(values " + ", ".join([f"('{w}', 1)" for w in POS_SEEDS] + [f"('{w}', -1)" for w in NEG_SEEDS]) + ") as seeds(seed, sgn)"
_PMI = f"""with dw as (select distinct doc_id, word from {TOK}), n as (select count(distinct doc_id) as n from dw), c as (select word, count(*) as c from dw group by word having count(*) >= 5),
s as (select seed, sgn, c as cs from {_SEEDS} join c on seed = word), p as (select a.word, seed, sgn, cs, count(*) as co from dw a join (select doc_id, seed, sgn, cs from dw join s on word = seed) h using (doc_id) group by all),
r as (select c.word, coalesce(sum(sgn * log2(co * n::double / (c * cs))), 0.0) as score from c left join p using (word), n group by c.word)"""


def _dict(spark: SparkSession, sf_dir: str, scale: str) -> DataFrame:
    return sentiment.build_sent_dict(tokenize.words_table(docs(spark, sf_dir)), POS_SEEDS, NEG_SEEDS, 5, scale)


def _rounded(df: DataFrame, column: str = "score") -> DataFrame:
    # adding zero turns -0.0 into 0.0
    return df.withColumn(column, F.round(column, 6) + F.lit(0.0))


@register(_PMI + " select word, round(score, 6) + 0.0 as score from r")
def so_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_dict(spark, sf_dir, "None"))


_BOUNDS = ", b as (select greatest(max(score), 0) as hi, least(min(score), 0) as lo from r)"
_PM1 = "case when score > 0 then score / hi when score < 0 then score / -lo else 0 end"


@register(_PMI + _BOUNDS + f" select word, round({_PM1}, 6) + 0.0 as score from r, b")
def so_pmi_scaled_pm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_dict(spark, sf_dir, "+-1"))


@register(_PMI + _BOUNDS + " select word, round((score - lo) / (hi - lo), 6) + 0.0 as score from r, b")
def so_pmi_scaled_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_dict(spark, sf_dir, "0-1"))


_DOC_SCORE = f", z as (select word, {_PM1} as score from r, b), d as (select doc_id, avg(score) as score from dw join z using (word) group by doc_id)"


def _doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return sentiment.analyse(tokenize.words_table(d), _dict(spark, sf_dir, "+-1"), d)


@register(_PMI + _BOUNDS + _DOC_SCORE + " select doc_id, round(coalesce(score, 0), 6) + 0.0 as score from documents left join d using (doc_id)")
def doc_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_doc_scores(spark, sf_dir))


@register(_PMI + _BOUNDS + _DOC_SCORE + f" select entity as term, round(avg(coalesce(score, 0)), 6) + 0.0 as score, count(*) as n from {_FOUND} left join d using (doc_id) group by entity")
def entity_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieve.build_index(docs(spark, sf_dir), LEXICON, with_type=False)
    return _rounded(retrieve.entity_sentiment(index, _doc_scores(spark, sf_dir)))


# -- keywords --


@register(f"""with t as (select doc_id, word, count(*) as tf from {TOK} where length(word) >= 2 group by all), n as (select count(distinct doc_id) as n from t), f as (select word, count(*) as df from t group by word),
s as (select doc_id, word, round(tf / sum(tf) over (partition by doc_id) * (ln((1 + n) / (1 + df)) + 1), 6) as score from t join f using (word), n)
select doc_id, word, score, rank::integer as rank from (select *, row_number() over (partition by doc_id order by score desc, word) as rank from s) where rank <= 5""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.tfidf_words(docs(spark, sf_dir).select("doc_id", keyword.allowed(segment.words(F.col("text"))).alias("words")), 5, 6)


@register(f"""with t as (select *, lead(word, 1) over w as b1, lead(word, 2) over w as b2 from {TOK} where word not in {_STOP_SQL} window w as (partition by doc_id order by pos))
select a, b, count(*) as n from (select word as a, b1 as b from t union all select word, b2 from t) where b is not null group by all""")
def window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = keyword.allowed(segment.words(F.col("text")), STOP, 0)
    return keyword.window_pair_counts(docs(spark, sf_dir).select(own.alias("words")), 3)


@register()
def textrank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(keyword.allowed(segment.words(F.col("text")), STOP))
    return keyword.textrank_blocks(docs(spark, sf_dir).select("doc_id", own.alias("blocks")), 5)


@register(f"with h as (select length(word) as length, count(*) as n from (select distinct word from {TOK}) group by 1) select length::integer as length, n, sum(n) over (order by length) / sum(n) over () as share from h")
def word_length_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.length_histogram(tokenize.tokens_table(docs(spark, sf_dir)).select("word").distinct())


# -- summaries --

_CONV = r"(select conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as words from conversations)"


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("sent_id"), "text", segment.words(F.col("text")).alias("words"))


@register(f"""with s as (select conv_id, turn, words, len(words) as n from {_CONV}), t as (select distinct conv_id, turn, n, unnest(words) as w from s where n > 1)
select a.conv_id, a.turn as a, b.turn as b, round(count(*) / (log2(a.n) + log2(b.n)), 6) as weight from t a join t b on a.conv_id = b.conv_id and a.w = b.w and a.turn < b.turn group by a.conv_id, a.turn, b.turn, a.n, b.n""")
def summary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.similar_pairs(_sents(spark, sf_dir), "conv_id"), "weight")


@register(f"""with s as (select conv_id, turn, words, lead(turn) over w as next, lead(words) over w as other from {_CONV} window w as (partition by conv_id order by turn)),
x as (select conv_id, turn, w, count(*) as c from (select conv_id, turn, unnest(words) as w from {_CONV}) group by all), nrm as (select conv_id, turn, sqrt(sum(c * c)) + 1e-5 as z from x group by all),
d as (select a.conv_id, a.turn, b.turn as other, sum(a.c * b.c) as dot from x a join x b on a.conv_id = b.conv_id and a.w = b.w group by all)
select s.conv_id, s.turn, round(coalesce(dot, 0) / (coalesce(n1.z, 1e-5) * coalesce(n2.z, 1e-5)), 6) as cosine,
  case when len(s.words) <= 1 or len(s.other) <= 1 then 0 else round(len(list_intersect(s.words, s.other)) / (log2(len(s.words)) + log2(len(s.other))), 6) end as overlap
from s left join d on s.conv_id = d.conv_id and s.turn = d.turn and s.next = d.other left join nrm n1 on s.conv_id = n1.conv_id and s.turn = n1.turn left join nrm n2 on s.conv_id = n2.conv_id and s.next = n2.turn where s.next is not null""")
def summary_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("sent_id")
    s = _sents(spark, sf_dir).withColumn("other", F.lead("words").over(w)).where("other is not null")
    return s.select("conv_id", F.col("sent_id").alias("turn"), F.round(similarity.bag_cosine(F.col("words"), F.col("other")), 6).alias("cosine"), F.round(similarity.token_overlap(F.col("words"), F.col("other")), 6).alias("overlap"))


def _doc_summary(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    d = docs(spark, sf_dir)
    cut = segment.cut_sentences(F.col("text"), language="en")
    if not repeated(d, "doc_id"):
        sents = F.transform(cut, lambda t, i: F.struct(i.alias("sent_id"), t.alias("text"), segment.words(t).alias("words")))
        return summary.summary_docs(d.select("doc_id", sents.alias("sents")), **options)
    sents = d.select("doc_id", F.posexplode(cut).alias("sent_id", "text"))
    return summary.summary(sents.withColumn("words", segment.words(F.col("text"))), **options)


@register()
def summary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_summary(spark, sf_dir, k=3, maxlen=2000)


@register()
def mmr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_summary(spark, sf_dir, k=3, avoid_repeat=True)


# -- new words --

#: On Latin text ASCII letters must not separate: everything but letters and digits does.
LATIN = r"[^\p{L}\p{N}]+"
_NORM = f"regexp_replace(string_agg(coalesce(text, ''), chr(10) order by doc_id), '{LATIN}', ' ', 'g')"
_GRAMS = f"""with c as (select {_NORM} as t from documents), n as (select length(t) as len from c),
r as (select unnest(string_split(t, ' ')) as w from c), q as (select w, row_number() over () as id from r), p as (select w, id, unnest(range(1, length(w) + 1)) as p from q where w <> ''),
g as (select substring(w, p, k) as text, case when p > 1 then substring(w, p - 1, 1) else ' ' end as "left", case when p + k <= length(w) then substring(w, p + k, 1) else ' ' end as "right" from (select w, p, unnest(range(1, least(4, length(w) - p + 1) + 1)) as k from p))"""


@register(_GRAMS + " select text, count(*) as n, count(*) / any_value(len) as freq from g, n group by text having count(*) >= 20")
def ngram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = newword.normalised(docs(spark, sf_dir), LATIN)
    length = pieces.agg(F.sum(F.length("t")).alias("len"))
    n = newword.gram_counts(pieces, 4).where("n >= 20")
    return n.crossJoin(F.broadcast(length)).select("text", "n", (F.col("n") / F.col("len")).alias("freq"))  # one row is broadcast


_ENT = "select text, ln(sum(c)) - sum(c * ln(c)) / sum(c) as h from (select text, {s}, count(*) as c from g join f using (text) where {s} <> '' group by text, {s}) group by text"


@register(_GRAMS + f""", k as (select text, count(*) / any_value(len) as freq from g, n group by text), x as (select text, freq, unnest(range(1, length(text))) as i from k where length(text) > 1 and freq > 5e-5),
f as (select x.text, any_value(x.freq) as freq, min(x.freq / (a.freq * b.freq)) as agg from x join k a on a.text = substring(x.text, 1, i) join k b on b.text = substring(x.text, i + 1) group by x.text having min(x.freq / (a.freq * b.freq)) > 5),
l as ({_ENT.format(s='"left"')}), e as ({_ENT.format(s='"right"')})
select text, round(freq, 9) as freq, round(l.h, 6) as left_ent, round(e.h, 6) as right_ent, round(agg, 6) as agg, round(log10(agg) * freq * (l.h + e.h), 9) as score from f join l using (text) join e using (text) where l.h > 1.4 and e.h > 1.4 and not regexp_full_match(text, '[0-9]+')""")
def new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = newword.discover(docs(spark, sf_dir), 4, auto_param=False, min_freq=5e-5, min_entropy=1.4, min_aggregation=5, separators=LATIN)
    return w.select("text", F.round("freq", 9).alias("freq"), *(F.round(c, 6).alias(c) for c in ("left_ent", "right_ent", "agg")), F.round("score", 9).alias("score"))


# -- knowledge --

_KG = "(select distinct s, v, o from (select c_name as s, 'lives_in' as v, n_name as o from customer join nation on c_nationkey = n_nationkey union all select n_name, 'part_of', r_name from nation join region on n_regionkey = r_regionkey union all select n_name, 'part_of', r_name from nation join region on n_regionkey = r_regionkey))"


def _kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    lives = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("s"), F.lit("lives_in").alias("v"), F.col("n_name").alias("o"))
    part = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.lit("part_of").alias("v"), F.col("r_name").alias("o"))
    return kgqa.build_kg(lives.union(part).union(part))


@register(f"select s, v, o from {_KG}")
def kg_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kg(spark, sf_dir)


@register(f"select s from {_KG} where v = 'part_of' and o = (select min(r_name) from region)")
def kg_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "region").agg(F.min("r_name").alias("o"))
    return kgqa.pattern(_kg(spark, sf_dir), v="part_of").join(first, "o").select("s")


