"""Queries for resources, the lexicon's operations, entity discovery and question answering, with DuckDB SQL.

Resource queries write a file in the reader's format to shared storage first and read it back through the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, segment
from ..operators import discover, graph, keyword, kgqa, linking, newword, parse, retrieve, sentiment, summary, tokenize
from ..operators.lexicon import Lexicon
from ..sources import model, resources
from .catalogue import _ALT, _BOUNDS, _DOC_SCORE, _FOUND, _GRAMS, _LEX, _PMI, _SPLIT, _WORDS5, AMBIGUOUS, LATIN, LEXICON, NEG_SEEDS, POS_SEEDS, STOP, TOK, _ENT, _kg, _KG, _rounded, _sents, docs, gsub, register, table
from .cut import settle, shared_path
from .small import local

# -- resources --


def _put(spark: SparkSession, df: DataFrame, name: str) -> str:
    """Writes a one-column frame as text lines to shared storage; these are small files of one part."""
    path = shared_path(spark, name)
    df.coalesce(1).write.text(path)
    return path


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.tokens_table(docs(spark, sf_dir)).where(F.length("word") == 8).select("word")


@register(f"select distinct word, case when suffix(word, 'ing') then 'pos' else 'neg' end as polarity from {TOK} where length(word) = 8 and (suffix(word, 'ing') or suffix(word, 'ed'))")
def source_sentiment_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    lists = _words(spark, sf_dir).agg(F.array_sort(F.collect_set(F.when(w.endswith("ing"), w))).alias("pos"), F.array_sort(F.collect_set(F.when(w.endswith("ed"), w))).alias("neg"))
    return resources.sentiment_lexicon(spark, _put(spark, lists.select(F.to_json(F.struct("pos", "neg")).alias("value")), "senti"))


@register("select distinct c_name as word from customer union select r_name from region union select n_name from nation")
def source_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three layouts: a JSON list, a JSON object with a list, lines."""
    regions = table(spark, sf_dir, "region").agg(F.to_json(F.collect_list("r_name")).alias("value"))
    nations = table(spark, sf_dir, "nation").agg(F.to_json(F.create_map(F.lit("words"), F.collect_list("n_name"))).alias("value"))
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"))
    out = [resources.stopwords(spark, _put(spark, df, "stop")) for df in (regions, nations, names)]
    return out[0].union(out[1]).union(out[2]).distinct()


_SURE_STOP = ["the", "of", "and", "to", "in", "is", "on", "that", "with", "was"]


@register(f"select word, count(*) as n from {TOK} where word in ('" + "', '".join(_SURE_STOP) + "') group by word")
def source_english_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of corpus words that the shipped English list has, of ten that any such list has."""
    stop = resources.english_stopwords(spark)
    tokens = tokenize.tokens_table(docs(spark, sf_dir)).where(F.col("word").isin(_SURE_STOP))
    return tokens.join(stop, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


@register("select r_name as etype, n_name as word from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')")
def source_typed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.typed_words(spark, _put(spark, _typed_json(spark, sf_dir), "typed"), ["ASIA", "EUROPE"])


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def _typed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _nations(spark, sf_dir).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("w"))
    return lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r_name", "w"))))).alias("value"))


@register("select (row_number() over (order by item_id) - 1)::bigint as doc_id, text from benchmark")
def source_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("x"))
    return resources.chapters(spark, _put(spark, texts.select(F.to_json(F.transform("x", lambda t: t["text"])).alias("value")), "chapters"))


@register("select n_name as mention, n_name as entity, r_name as etype from nation join region on n_regionkey = r_regionkey union all select 'N' || n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def source_entity_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nations(spark, sf_dir)
    own = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.array("n_name", F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))))))).alias("m"), F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "r_name")))).alias("t"))
    mentions, types = resources.entity_dict(spark, _put(spark, own.select(F.concat(F.lit("["), "m", F.lit(","), "t", F.lit("]")).alias("value")), "entities"))
    return mentions.join(types, "entity").select("mention", "entity", "etype")


@register("select r_name as p, n_name as neighbor from nation join region on n_regionkey = r_regionkey")
def source_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.neighbours(spark, _put(spark, _typed_json(spark, sf_dir), "neighbours"))


@register("select r_name as ch, min(n_name) as syllable from nation join region on n_regionkey = r_regionkey group by r_name")
def source_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.readings(spark, _put(spark, _typed_json(spark, sf_dir), "readings"))


@register(f"select word, cf as freq, 'n' as pos from (select word, count(*) as cf from {TOK} group by word) where cf > 20 and cf < 2000")
def source_word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokenize.tokens_table(docs(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("cf"))
    lines = counted.select(F.concat_ws(" ", "word", F.col("cf").cast("string"), F.lit("n")).alias("value"))
    path = shared_path(spark, "freq")
    lines.union(local(spark, [("a line of another shape",)], "value string")).write.text(path)
    return resources.word_frequencies(spark, path, 20, 2000, with_pos=True)


@register("select sha256(string_agg(n_name, chr(10) order by n_nationkey) || chr(10)) as sha256, sum(length(n_name) + 1)::bigint as bytes from nation")
def source_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is fetched from one storage to another and its checksum read."""
    names = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("value"))
    path = _put(spark, names, "names")
    (first,) = resources.checksums(spark, f"{path}/part-*").collect()
    copy = resources.fetch_shared(spark, f"{path}/{first.name}", shared_path(spark, "fetched") + ".txt", first.sha256)
    return resources.checksums(spark, copy).select("sha256", "bytes")


@register("select n_nationkey, n_name from nation")
def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lines")
    table(spark, sf_dir, "nation").write.json(path)
    return resources.json_lines(spark, path, "n_nationkey long, n_name string")


@register("select x as text, count(*) as n from (select trim(x, ' \t\n\x0b\x0c\r') as x from (select unnest(string_split(text, chr(10))) as x from documents)) where length(x) > 0 group by x".replace("' \t\n\x0b\x0c\r'", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"))
def source_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "text")
    docs(spark, sf_dir).where("text is not null").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return resources.text_lines(spark, path, clean.strip).groupBy("text").agg(F.count("*").alias("n"))


@register(f"select mention, entity, etype from {_LEX}")
def lexicon_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved as text and loaded again; names with blanks can't be told apart in that format, so they are masked."""
    path = shared_path(spark, "lexicon")
    safe = LEXICON.clear().add_entities({e: [m.replace(" ", "␠") for m, x in LEXICON.pairs if x == e] for e in LEXICON.types}, LEXICON.types)
    safe.save_text(spark, path)
    back = Lexicon.load_text(spark, path)
    return back.joined_df(spark).select(F.replace("mention", F.lit("␠"), F.lit(" ")).alias("mention"), "entity", "etype")


@register(_PMI + f" select 'word' as kind, word as a, null::varchar as b, round(score, 6) + 0.0 as n from r union all select 'mention', mention, entity, 0.0 from {_LEX} union all select 'count', 'tion', null, 7.0 union all select 'latest', 'tion', 'tion', 0.0")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon, sentiment dictionary and linking memory saved and loaded."""
    path = shared_path(spark, "model")
    scores = sentiment.build_sent_dict(tokenize.words_table(docs(spark, sf_dir)), POS_SEEDS, NEG_SEEDS)
    model.save(spark, model.Model(LEXICON, scores, linking.Memory("freq&latest", {"tion": 7}, {"tion": "tion"})), path)
    m = model.load(spark, path)
    row = "kind string, a string, b string, n double"
    words = _rounded(m.sentiment).select(F.lit("word").alias("kind"), F.col("word").alias("a"), F.lit(None).cast("string").alias("b"), F.col("score").alias("n"))
    rest = [("mention", a, b, 0.0) for a, b in sorted(m.lexicon.pairs)] + [("count", e, None, float(n)) for e, n in m.memory.counts.items()] + [("latest", s, e, 0.0) for s, e in m.memory.latest.items()]
    return words.union(local(spark, rest, row))


# -- operations on a lexicon, read from tables --

_N = "nation join region on n_regionkey = r_regionkey"
_BASE = f"(select n_name as mention, n_name as entity, r_name as etype from {_N} union select 'N' || n_nationkey, n_name, r_name from {_N})"


def _base(spark: SparkSession, sf_dir: str) -> Lexicon:
    n = _nations(spark, sf_dir)
    mentions = n.select(F.col("n_name").alias("mention"), F.col("n_name").alias("entity")).union(n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), "n_name"))
    return Lexicon.from_tables(n.select(F.col("n_name").alias("entity"), F.col("r_name").alias("etype")), mentions)


def _names(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Nations of each region: the tables have 25 and 5 rows at any scale."""
    return {r.r_name: sorted(r.n) for r in _nations(spark, sf_dir).groupBy("r_name").agg(F.collect_list("n_name").alias("n")).collect()}


@register(f"select * from {_BASE} where entity <> 'NATION_1' union all select mention, entity, 'changed' from {_BASE} where entity = 'NATION_1' union all select 'alias', 'NATION_1', 'changed' union all select 'solo', 'solo', 'alone' union all select 'm', 'untyped', '添加词'")
def lexicon_add_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a known entity join its own, a new type wins, entities without mention or type get defaults."""
    return _base(spark, sf_dir).add_entities({"NATION_1": ["alias"], "untyped": ["m"]}, {"NATION_1": "changed", "solo": "alone"}).joined_df(spark)


@register(f"select n_name as mention, n_name as entity, case when n_name = (select min(n_name) from nation) then 'later' else r_name end as etype from {_N}")
def lexicon_typed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = _names(spark, sf_dir)
    return Lexicon().add_typed_words({**by_type, "later": [min(n for own in by_type.values() for n in own)]}).joined_df(spark)


@register("select r_name as mention, r_name as entity, '新词' as etype from region")
def lexicon_new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lexicon().add_new_words(_names(spark, sf_dir)).joined_df(spark)


@register(f"select * from {_BASE} union select r_name || ':' || n_name, n_name, r_name from {_N} union select 'N2', 'NATION_3', (select any_value(etype) from {_BASE} where entity = 'NATION_3')")
def lexicon_new_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {n: [f"{r}:{n}"] for r, own in _names(spark, sf_dir).items() for n in own}
    return _base(spark, sf_dir).add_new_mentions(more).add_new_mentions({"NATION_3": ["N2"]}).joined_df(spark)


@register(f"select mention, entity, case when entity = 'NATION_2' then 'retyped' else etype end as etype from {_BASE} union all select 'two', 'NATION_2', 'retyped' union all select 'fresh', 'fresh', '添加词'")
def lexicon_new_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).add_new_entity("NATION_2", "two", "retyped").add_new_entity("fresh").joined_df(spark)


@register(f"select * from {_BASE} where mention <> 'N4' and entity <> 'NATION_5'")
def lexicon_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).remove_mention("N4").remove_entity("NATION_5").joined_df(spark)


@register("select r_name as etype, 'entity type ''' || r_name || '!'' has the punctuation ''!''' as error from region")
def lexicon_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with punctuation are refused."""
    out = []
    for r in sorted(_names(spark, sf_dir)):
        try:
            Lexicon().add_new_entity("e", etype=f"{r}!")
        except ValueError as e:
            out.append((r, str(e)))
    return local(spark, out, "etype string, error string")


@register("select * from (values ('人名', 'nr'), ('地名', 'ns'), ('机构名', 'nt'), ('其他专名', 'nz')) t(etype, tag) union all select r_name, 'n' from region")
def lexicon_type_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = _base(spark, sf_dir)
    return local(spark, [(t, lex.tag_of(t)) for t in ["人名", "地名", "机构名", "其他专名", *sorted(set(lex.types.values()))]], "etype string, tag string")


@register("select 'en' as language, true as standard_name, 0::bigint as entities, 0::bigint as mentions, (select 2 * count(*) from nation)::bigint as before")
def lexicon_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options stay, entries go; the lexicon before is a value of its own."""
    full = Lexicon(language="en", standard_name=True).add_typed_words(_names(spark, sf_dir)).add_new_mentions({n: [n.lower()] for own in _names(spark, sf_dir).values() for n in own})
    bare = full.clear()
    return local(spark, [(bare.language, bare.standard_name, bare.entities_df(spark).count(), bare.mentions_df(spark).count(), full.mentions_df(spark).count())], "language string, standard_name boolean, entities long, mentions long, before long")


@register(f"select w.mention, entity, etype from (select distinct word as mention from {TOK}) w left join (select mention, min(entity) as entity, any_value(etype) as etype from {_LEX} group by mention) l using (mention)")
def mention_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenize.tokens_table(docs(spark, sf_dir)).select(F.col("word").alias("mention")).distinct()
    return linking.lookup(words, LEXICON.joined_df(spark))


# -- fuzzy linking --

_SEEN5 = f"(select distinct word from {TOK} where length(word) = 5 and regexp_full_match(word, '[a-z]+'))"
_M5 = "(values " + ", ".join(f"('{w}')" for w in _WORDS5) + ") m(mention)"
_SOUND = "translate({}, 'cz', 'ks')"
_DIFF = " + ".join(f"case when substring(a, {i}, 1) = substring(b, {i}, 1) then 0 when (substring(a, {i}, 1), substring(b, {i}, 1)) in (('n', 'm'), ('m', 'n'), ('t', 'd')) then 1 else 9 end" for i in range(1, 6))


@register(f"select word, mention from (select w.word, m.mention, {_SOUND.format('w.word')} as a, {_SOUND.format('m.mention')} as b from {_SEEN5} w, {_M5}) where {_DIFF} <= 1")
def fuzzy_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters stand for characters, ``c`` and ``z`` read like ``k`` and ``s``, and some readings are neighbours."""
    words = tokenize.tokens_table(docs(spark, sf_dir)).where(F.col("word").rlike("^[a-z]{5}$")).select("word").distinct()
    readings = local(spark, [("c", "k"), ("z", "s")], "ch string, syllable string")
    near = local(spark, [("n", "m"), ("m", "n"), ("t", "d")], "p string, neighbor string")
    mentions = linking.syllables(local(spark, [(w,) for w in _WORDS5], "word string"), readings).withColumnRenamed("word", "mention")
    return linking.pinyin_candidates(linking.syllables(words, readings), mentions, near, 1)


@register(f"select w.word, m.mention from {_SEEN5} w, {_M5} where " + " + ".join(f"(substring(w.word, {i}, 1) <> substring(m.mention, {i}, 1))::int" for i in range(1, 6)) + " <= 2")
def fuzzy_char_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenize.tokens_table(docs(spark, sf_dir)).where(F.col("word").rlike("^[a-z]{5}$")).select("word").distinct()
    return linking.char_candidates(words, local(spark, [(w,) for w in _WORDS5], "mention string"), 2)


_AT = """(select doc_id, i as pos, word, (r - length(word))::integer as l, r::integer as r from (select doc_id, i, word, sum(length(gap) + length(word)) over (partition by doc_id order by i rows unbounded preceding) as r
  from (select doc_id, unnest(s) as word, unnest(g[1:len(s)]) as gap, unnest(range(len(s))) as i from (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as s, regexp_split_to_array(text, '[A-Za-z]+') as g from documents))))"""
_NEAR5 = " + ".join(f"(substring(word, {i}, 1) <> substring(m.mention, {i}, 1))::int" for i in range(1, 6))
_CAND = f"(select distinct word, mention from (select distinct word from {_AT} where length(word) = 5) w, {_M5} where {_NEAR5} <= 1)"
_FUZZY = Lexicon().add_typed_words({"fuzzy": _WORDS5})


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of the mentions' lengths with offsets, all of them nouns, and their fuzzy candidates: these have a mention's length."""
    d = docs(spark, sf_dir)
    tokens = tokenize.spans_table(d, pattern="[A-Za-z]+", sizes=map(len, _WORDS5)).withColumn("flag", F.lit("n"))
    five = tokenize.words_table(d, pattern="[A-Za-z]+", lower=False).where(F.length("word") == 5).select("word").distinct()
    return tokens, linking.char_candidates(five, _FUZZY.mentions_df(spark))


@register(f"select doc_id, pos::integer as pos, word, l, r from {_AT}")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.spans_table(docs(spark, sf_dir), pattern="[A-Za-z]+")


@register(f"select doc_id, l, r, string_agg(mention, ',' order by mention) as mentions from {_AT} join {_CAND} using (word) group by doc_id, l, r")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, cands = _tagged(spark, sf_dir)
    return linking.candidate_spans(tokens, cands).withColumn("mentions", F.array_join("mentions", ","))


@register(f"""with links as (select doc_id, l, r, surface, entity, etype from {_SPLIT} join {_LEX} on surface = mention), best as (select word, min(mention) as e from {_CAND} group by word)
select * from links union all select doc_id, l, r, word, e, 'fuzzy' from {_AT} t join best using (word) where not exists (select 1 from links k where k.doc_id = t.doc_id and t.l < k.r and k.l < t.r)""")
def link_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact links, and nouns beside them that a mention differs from by one letter."""
    tokens, cands = _tagged(spark, sf_dir)
    return linking.recheck(tokens, linking.links_table(docs(spark, sf_dir), LEXICON), cands, _FUZZY.joined_df(spark))


@register(f"select doc_id, l, r, surface from {_SPLIT} where length(surface) > 1 and regexp_matches(surface, '[A-Z]')")
def link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with no character but lower-case ones and blanks go, as if these were verbs."""
    d = docs(spark, sf_dir).withColumn("x", linking.link(F.col("text"), LEXICON, spark))
    tags = lambda x: F.transform(F.split(x["surface"], ""), lambda c: F.when(c.rlike("[A-Z]"), F.lit("n")).otherwise(F.lit("v")))
    return d.select("doc_id", F.explode(linking.filter_links(F.col("x"), tags)).alias("x")).select("doc_id", "x.l", "x.r", "x.surface")


_PARTS = f"""(select doc_id, s, g, text from (select doc_id, text, regexp_extract_all(text, '{_ALT}') as s, regexp_split_to_array(text, '{_ALT}') as g from documents))"""


@register(f"""with p as (select doc_id, unnest(s) as surface, unnest(g[1:len(s)]) as gap, unnest(range(len(s))) as i from {_PARTS}),
j as (select doc_id, string_agg(gap || '#' || etype || '#', '' order by i) as m, string_agg(gap || entity, '' order by i) as e from p join {_LEX} on surface = mention group by doc_id)
select doc_id, coalesce(m, '') || g[len(g)] as masked, coalesce(e, '') || g[len(g)] as named from {_PARTS} left join j using (doc_id)""")
def link_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("x", linking.link(F.col("text"), LEXICON, spark))
    return d.select("doc_id", linking.mask(F.col("text"), F.col("x")).alias("masked"), linking.standardise(F.col("text"), F.col("x")).alias("named"))


# -- tokens and sentences --

_RUN = r"(?s)[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|[\s\p{Z}\x0b\x1c-\x1f\x85]+|."


@register(f"""with gaps as (select doc_id, unnest(g) as gap, unnest(range(len(g))) as i, s from {_PARTS}), links as (select doc_id, i, surface, l, r from {_SPLIT}),
placed as (select g.doc_id, g.gap, g.i, coalesce(k.r, 0) as base from gaps g left join links k on g.doc_id = k.doc_id and k.i = g.i - 1),
t as (select doc_id, i, base, unnest(regexp_extract_all(gap, '{_RUN}')) as word, unnest(range(len(regexp_extract_all(gap, '{_RUN}')))) as k from placed),
o as (select doc_id, word, (base + sum(length(word)) over (partition by doc_id, i order by k rows unbounded preceding))::integer as r from t)
select doc_id, word, case when regexp_full_match(word, '[A-Za-z]+') then 'eng' when regexp_full_match(word, '[0-9.]+') then 'm' when not regexp_matches(word, '[\\p{{L}}\\p{{N}}_]') then 'x' end as flag, (r - length(word))::integer as l, r, false as is_entity
from o where not regexp_full_match(word, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+') and word not in ({", ".join(f"'{w}'" for w in STOP)})
union all select doc_id, entity, etype, l, r, true from links join {_LEX} on surface = mention""")
def seg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.posseg_table(docs(spark, sf_dir), LEXICON, stopwords=set(STOP), standard_name=True)


_marks = "text"
for _m in "。！？!?":
    _marks = gsub(_marks, f"\\{_m}+" if _m == "?" else f"{_m}+", _m)


@register(f"select doc_id, {_marks} as text from documents")
def dedup_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", segment.dedup_marks(F.col("text")).alias("text"))


_EN = r"n''t|''(?:s|m|d|ll|re|ve)\b|[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*|\.{3}|[^\s\p{L}\p{N}]"


@register(rf"""select doc_id, unnest(w) as word, unnest(range(len(w)))::integer as pos from (select doc_id, regexp_extract_all(regexp_replace(text, '([A-Za-z])n''t', '\1 n''t', 'g'), '{_EN}') as w from documents)""")
def english_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(segment.english_tokens(F.col("text"))).alias("pos", "word"))


# -- graphs and sentiment --


def _pagerank_sql(edges: str, rounds: int = 20) -> str:
    out = [f"g as ({edges})", "a as (select u as a, v as b, weight::double as w from g union all select v, u, weight from g where u <> v)", "t as (select a, sum(w) as t from a group by a)", "n as (select count(*)::double as n from t)", "r0 as (select a as node, 1 / n as rank from t, n)"]
    for k in range(rounds):
        out.append(f"r{k + 1} as (select t.a as node, 0.85 * coalesce(f, 0) + 0.15 / n as rank from t left join (select b, sum(w / t * rank) as f from a join t using (a) join r{k} on a.a = node group by b) x on x.b = t.a, n)")
    return "with " + ", ".join(out) + f" select node, round(rank, 6) as rank from r{rounds}"


@register(_pagerank_sql(f"select a.entity as u, b.entity as v, count(*) as weight from {_FOUND} a join {_FOUND} b on a.doc_id = b.doc_id and a.entity < b.entity group by all"))
def entity_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(graph.entity_graph(retrieve.entity_docs(docs(spark, sf_dir), LEXICON))).withColumn("rank", F.round("rank", 6))


@register()
def entity_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(graph.entity_graph(retrieve.entity_docs(docs(spark, sf_dir), LEXICON)))


_PM1 = "case when score > 0 then score / hi when score < 0 then score / -lo else 0 end"


@register(_PMI + _BOUNDS + f", z as (select word, round({_PM1}, 6) + 0.0 as score from r, b) select doc_id, coalesce(s, '') as scores from (select doc_id from documents) left join (select doc_id, string_agg(printf('%.6f', score), ',' order by score) as s from dw join z using (word) group by doc_id) using (doc_id)")
def doc_sentiment_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score instead of the mean."""
    d = docs(spark, sf_dir)
    words = settle(tokenize.words_table(d), "doc-words")
    known = _rounded(sentiment.build_sent_dict(words, POS_SEEDS, NEG_SEEDS, 5, "+-1"))
    scores = sentiment.analyse(words, known, d, avg=False)
    return scores.select("doc_id", F.array_join(F.transform("scores", lambda x: F.format_string("%.6f", x)), ",").alias("scores"))


@register(_PMI.replace("values ('and', 1), ('licensed', 1), ('rights', 1)", "values ('license', 1), ('reserved', 1)") + " select word, round(score, 6) + 0.0 as score from r where word in ('license', 'reserved', 'rights', 'idiot', 'und')")
def so_pmi_reseeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sentiment.SentimentModel(tokenize.tokens_table(docs(spark, sf_dir)), tuple(POS_SEEDS), tuple(NEG_SEEDS)).with_pos_seeds(["license", "reserved"])
    return _rounded(m.scores_of(["license", "reserved", "rights", "idiot", "und"]))


# -- keywords, summaries, new words --

_FLAG = "case when suffix(word, 'ing') then 'v' when suffix(word, 'ly') then 'd' else 'n' end"


def _flag(w: Column) -> Column:
    return F.when(w.endswith("ing"), "v").when(w.endswith("ly"), "d").otherwise("n")


def _tfidf_sql(where: str, k: int = 5) -> str:
    return f"""with t as (select doc_id, word, count(*) as tf from {TOK} where {where} group by all), n as (select count(distinct doc_id) as n from t), f as (select word, count(*) as df from t group by word),
s as (select doc_id, word, round(tf / sum(tf) over (partition by doc_id) * (ln((1 + n) / (1 + df)) + 1), 6) as score from t join f using (word), n),
k as (select doc_id, word, score, rank::integer as rank from (select *, row_number() over (partition by doc_id order by score desc, word) as rank from s) where rank <= {k})"""


@register(_tfidf_sql(f"length(word) >= 4 and {_FLAG} in ('v', 'd') and word not in ('" + "', '".join(STOP) + "')") + " select * from k")
def keywords_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by tag, length and stop words come before anything is counted."""
    own = F.filter(keyword.allowed(segment.words(F.col("text")), STOP, 4), lambda w: _flag(w).isin("v", "d"))
    return keyword.tfidf_words(docs(spark, sf_dir).select("doc_id", own.alias("words")), 5, 6)


@register(_tfidf_sql("length(word) >= 2") + f", truth as (select distinct doc_id, word from {TOK} where pos < 20), h as (select count(*) as h from (select distinct doc_id, word from k) join truth using (doc_id, word)), c as (select (select count(*) from (select distinct doc_id, word from k)) as f, (select count(*) from truth) as t) select round(h / f, 9) as precision, round(h / t, 9) as recall, round(2 * (h / f) * (h / t) / (h / f + h / t), 9) as f1 from h, c")
def keyword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found keywords against the first 20 words of each document."""
    d = docs(spark, sf_dir).select("doc_id", segment.words(F.col("text")).alias("words"))
    found = keyword.tfidf_words(d.select("doc_id", keyword.allowed(F.col("words")).alias("words")), 5, 6)
    got = keyword.evaluate(found, d.select("doc_id", F.explode(F.array_distinct(F.slice("words", 1, 20))).alias("word")))
    return got.select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@register()
def textrank_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours within a sentence only."""
    sents = segment.cut_sentences(F.col("text"), language="en")
    own = F.transform(sents, lambda s: keyword.allowed(segment.words(s), STOP))
    return keyword.textrank_blocks(docs(spark, sf_dir).select("doc_id", own.alias("blocks")), 5)


def _shared_words(a: list[str], b: list[str]) -> float:
    return len(set(a) & set(b)) / max(1, len(set(a) | set(b)))


@register()
def summary_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's similarity and word forms."""
    return summary.summary(_sents(spark, sf_dir), 2, sim=_shared_words, lemma=lambda w: w[:5], group_col="conv_id")


def _new_words_sql(grams: str, freq: str, agg: str, keep: str, more: str = "") -> str:
    return grams + f""", z as (select any_value(len)::double as len from n), dl as (select (sum(length(coalesce(text, ''))) + greatest(count(*) - 1, 0))::double as len from documents), k as (select text, count(*) / any_value(len) as freq from g, n group by text), x as (select text, freq, unnest(range(1, length(text))) as i from k, dl where length(text) > 1 and freq > {freq}),
f as (select x.text, any_value(x.freq) as freq, min(x.freq / (a.freq * b.freq)) as agg, any_value(dl.len) as dlen from x join k a on a.text = substring(x.text, 1, i) join k b on b.text = substring(x.text, i + 1), dl group by x.text having min(x.freq / (a.freq * b.freq)) > any_value({agg})),
l as ({_ENT.format(s='"left"')}), e as ({_ENT.format(s='"right"')}),
w as (select text, freq, l.h as left_ent, r.h as right_ent, agg, log10(agg) * freq * (l.h + r.h) as score from f join l using (text) join e r using (text) where {keep} and not regexp_full_match(text, '[0-9]+'))
select text, round(freq, 9) as freq, round(left_ent, 6) as left_ent, round(right_ent, 6) as right_ent, round(agg, 6) as agg, round(score, 9) as score from w {more}"""


def _tidy(w: DataFrame) -> DataFrame:
    return w.select("text", F.round("freq", 9).alias("freq"), *(F.round(c, 6).alias(c) for c in ("left_ent", "right_ent", "agg")), F.round("score", 9).alias("score"))


_GRAMS5 = _GRAMS.replace("least(4,", "least(5,")


@register(_new_words_sql(_GRAMS5, "least(5e-5, 20.0 / dl.len)", "sqrt(dl.len) / 15", "l.h > ln(dlen) / 10 and r.h > ln(dlen) / 10"))
def new_words_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(newword.discover(docs(spark, sf_dir), separators=LATIN, sort_by="score"))


@register(_new_words_sql(_GRAMS, "5e-5", "5", "(l.h + r.h) / 2 > 1.4 and text not in ('tion', 'the')", "where score > (select coalesce(min(score) * 0.9, -1e9) from w where text in ('ing', 'tion'))"))
def new_words_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean entropy, excluded words, and a threshold learnt from seed words."""
    return _tidy(newword.discover(docs(spark, sf_dir), 4, auto_param=False, min_aggregation=5, ent_threshold="avg", excluding=["tion", "the"], threshold_seeds=["ing", "tion"], separators=LATIN))


@register("select round(avg(length(text)), 6) as avg_len, round(avg(freq), 9) as avg_freq, round(avg(left_ent), 6) as avg_left_ent, round(avg(right_ent), 6) as avg_right_ent, round(avg(agg), 6) as avg_agg from (" + _new_words_sql(_GRAMS, "5e-5", "5", "l.h > 1.4 and r.h > 1.4").replace("round(freq, 9)", "freq").replace("round(left_ent, 6)", "left_ent").replace("round(right_ent, 6)", "right_ent").replace("round(agg, 6)", "agg") + ")")
def new_word_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = newword.averages(newword.discover(docs(spark, sf_dir), 4, auto_param=False, min_aggregation=5, separators=LATIN))
    return w.select(*(F.round(c, 9 if c == "avg_freq" else 6).alias(c) for c in w.columns))


_HAN_SEP = newword.SEPARATORS.removeprefix("(?U)").replace(r"[\s", r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}")


@register(_GRAMS.replace(LATIN, _HAN_SEP) + " select text, count(*) as n from g group by text having count(*) >= 5")
def ngram_stats_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default separators, for Chinese: ASCII letters separate, digits and accented letters are left."""
    return newword.gram_counts(newword.normalised(docs(spark, sf_dir)), 4).where("n >= 5")


# -- entities --

_NAMED = r"(select lower(case when length(word) = 7 then substring(word, 1, 6) || '国' else word end) as name, case when suffix(word, 'a') then '人名' else '地名' end as etype from (select unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as word from documents) where regexp_full_match(word, '[A-Z][a-z]{5,6}'))"


def _tagged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger by rule: capitalised words of six and seven letters are places or persons; seven letters are a state named after six."""
    w = F.col("word")
    t = tokenize.tokens_table(docs(spark, sf_dir), lower=False)
    name = w.rlike("^[A-Z][a-z]{5,6}$")
    return t.select("doc_id", "pos", F.when(name & (F.length("word") == 7), F.concat(F.substring("word", 1, 6), F.lit("国"))).otherwise(w).alias("word"), F.when(name & w.endswith("a"), "nr").when(name, "ns").alias("flag"))


_PLAIN = r"(select word, count(*) as n from (select unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) as word from documents) where not regexp_full_match(word, '[A-Z][a-z]{5,6}') group by word having count(*) >= 5)"


@register(f"""with c as (select name, etype, count(*) as n from {_NAMED} group by all having count(*) >= 5), plain as {_PLAIN},
s as (select name, etype, n, row_number() over (order by n desc, name, etype) as ord, case when etype = '地名' and suffix(name, '国') then substring(name, 1, length(name) - 1) else name end as stem from c),
r as (select s.name, s.etype, s.n, s.ord, case when exists (select 1 from c where c.name = s.stem and c.etype = s.etype) then s.stem else s.name end as part from s),
h as (select part, etype, arg_max(name, (n, -ord)) as head from r group by part, etype),
own as (select head || '_' || h.etype as entity, h.etype, r.name as mention, h.head, r.part from r join h on r.part = h.part and r.etype = h.etype),
extra as (select head || '_' || h.etype as entity, h.etype, s.stem as mention from h join s on s.name = h.head and s.etype = h.etype where s.stem <> s.name and (exists (select 1 from c where c.name = s.stem) or exists (select 1 from plain p where p.word = s.stem)))
select entity, etype, mention, coalesce((select arg_max(n, ord) from (select *, row_number() over (order by n desc, name, etype) as ord from c) q where q.name = mention), (select n from plain p where p.word = mention))::bigint as n from (select entity, etype, mention from own union select entity, etype, mention from extra)""")
def entity_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rules only: counts, and states join the place that they are named after."""
    return discover.entity_table(_tagged_names(spark, sf_dir), method="NERP", min_count=5)


@register()
def entity_discover_nfl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sub-word and context vectors over sentences, then rules."""
    sents = docs(spark, sf_dir).select("doc_id", F.posexplode(segment.cut_sentences(F.col("text"), language="en")).alias("i", "text"))
    sents = sents.select(F.xxhash64("doc_id", "i").alias("doc_id"), "text")
    w = F.col("word")
    name = w.rlike("^[A-Z][a-z]{5,}$")
    t = tokenize.tokens_table(sents, lower=False).withColumn("flag", F.when(name & w.endswith("a"), "nr").when(name, "ns"))
    return discover.entity_table(t, method="NFL", min_count=5, threshold=0.9)


@register(f"select '人名' as etype, word as entity, count(distinct doc_id) as n from {TOK} where suffix(word, 'ing') group by word union all select '地名', word, count(distinct doc_id) from {TOK} where suffix(word, 'tion') group by word")
def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer of every corpus word with one of two endings tags the corpus."""
    tokens = tokenize.tokens_table(docs(spark, sf_dir))
    w = F.col("word")
    known = tokens.select("word").distinct().select("word", F.when(w.endswith("ing"), "nrf").when(w.endswith("tion"), "ns").when(w.endswith("ed"), "v").alias("flag")).where("flag is not null")
    return discover.entities(discover.gazetteer(tokens, known)).groupBy("etype", "entity").agg(F.count("*").alias("n"))


# -- knowledge --


def _chain(text: str) -> list[dict]:
    """A parser by position: first word subject, second predicate, fourth object with the third as its attribute."""
    rel = [(parse.SUBJECT, 1, "n"), ("核心关系", -1, "v"), (parse.ATTRIBUTE, 3, "a"), (parse.OBJECT, 1, "n")]
    return [{"id": i, "word": w, "tag": t, "rel": r, "head": h} for i, (w, (r, h, t)) in enumerate(zip(text.split(), rel))]


@register(r"select conv_id, turn, w[1] as s, w[2] as v, case when len(w) > 3 then w[3] || w[4] end as o from (select conv_id, turn, regexp_extract_all(text, '[^ \t\n\r\x0b\x0c\x1c-\x1f]+') as w from conversations) where len(w) > 3")
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn parsed, then its facts taken from the arcs."""
    d = table(spark, sf_dir, "conversations").withColumn("arcs", parse.arcs_of(F.col("text"), _chain))
    return d.select("conv_id", "turn", F.explode(parse.triples(F.col("arcs"))).alias("t")).select("conv_id", "turn", "t.*")


_ASK = "(select c_custkey * 4 as qid, 'Does ' || c_name || ' lives_in ?' as text from customer union all select n_nationkey * 4 + 1, 'lives_in ' || n_name || ' ?' from nation union all select c_custkey * 4 + 2, c_name || ' and ' || n_name from customer join nation on c_nationkey = n_nationkey union all select n_nationkey * 4 + 3, 'nothing known' from nation)"


@register(f"""with q as {_ASK}, a as (select c_custkey * 4 as qid, o as a from customer join {_KG} k on s = c_name and v = 'lives_in' union all
select n_nationkey * 4 + 1, s from nation join {_KG} k on o = n_name and v = 'lives_in' union all select c_custkey * 4 + 2, v from customer join nation on c_nationkey = n_nationkey join {_KG} k on s = c_name and o = n_name)
select qid, coalesce(string_agg(a, '、' order by a), '你好') as answer from q left join a using (qid) group by qid""")
def kg_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of questions answered by joins with the graph."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    both = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    ask = customer.select((F.col("c_custkey") * 4).alias("qid"), F.concat(F.lit("Does "), "c_name", F.lit(" lives_in ?")).alias("text"))
    ask = ask.union(nation.select(F.col("n_nationkey") * 4 + 1, F.concat(F.lit("lives_in "), "n_name", F.lit(" ?"))))
    ask = ask.union(both.select(F.col("c_custkey") * 4 + 2, F.concat("c_name", F.lit(" and "), "n_name"))).union(nation.select(F.col("n_nationkey") * 4 + 3, F.lit("nothing known")))
    return kgqa.default_answers(_kg(spark, sf_dir), ask)


@register("select r_name, 'In ' || r_name || ': ' || count(*) as answer from nation join region on n_regionkey = r_regionkey group by r_name")
def kg_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template's answer for one question a region: parsing, masking and matching on the driver, facts in Spark."""
    names = _names(spark, sf_dir)
    nations = _nations(spark, sf_dir)
    facts = nations.select(F.col("n_name").alias("s"), F.lit("part_of").alias("v"), F.col("r_name").alias("o"))
    qa = kgqa.KGQA(facts, Lexicon().add_typed_words({"region": list(names)}))
    qa.add_template((kgqa.PREDICATE, kgqa.ENTITY), "which are part_of #region#", lambda found, rows: f"In {found[1]}: {len(rows)}")
    return local(spark, [(r, qa.answer(f"which are part_of {r}")) for r in sorted(names)], "r_name string, answer string")
