"""Entity linking: longest known mention from left to right, without overlaps.

Small lexicons need surfaces only: ``surfaces`` is one Java regex, in the JVM.
``link`` gives spans through an Arrow UDF over a broadcast table of mentions.
Lexicons that are tables too large for a broadcast link by ``link_by_join``.
Order-dependent strategies fold over documents within a scope.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.batches import freed, in_pieces
from ..plans.small import checked
from ..schema import DEFAULT_TYPE, LINK, LINKS
from .lexicon import Lexicon

REGEX_MENTIONS = 2000
PAGE, WINDOW = 8192, 64
#: Most mentions that are looked for as one Python regex.
ALTERNATIVES = 64
#: Most distinct beginnings of mentions that are looked for before positions become rows.
KEYS = 20_000
#: Documents whose kept hits are returned at once.
GREEDY_ROWS = 1000
CANDS = f"array<struct<l:int,r:int,surface:string,cands:array<struct<entity:string,etype:string>>>>"


def java_pattern(mentions: list[str]) -> str:
    """Alternation of quoted mentions, longest first: the leftmost longest mention wins."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", m, flags=re.ASCII) if m.isascii() else "\\Q" + m + "\\E" for m in sorted(set(mentions), key=lambda m: (-len(m), m)))


def surfaces(text: Column, lexicon: Lexicon) -> Column:
    """Array of linked surfaces, in order."""
    mentions = sorted({m for m, _ in lexicon.pairs})
    if not mentions:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    if len(mentions) > REGEX_MENTIONS:
        raise ValueError(f"more than {REGEX_MENTIONS} mentions: use link()")
    return F.regexp_extract_all(text, F.lit(java_pattern(mentions)), F.lit(0))


class Matcher:
    """Longest mention at a position; candidates by mention."""

    def __init__(self, cands: dict[str, list[tuple[str, str]]]):
        self.cands = cands
        self.lengths: dict[str, list[int]] = {}
        for m in cands:
            self.lengths.setdefault(m[0], []).append(len(m))
        self.lengths = {c: sorted(set(n), reverse=True) for c, n in self.lengths.items()}
        self.first = re.compile("[" + re.escape("".join(sorted(self.lengths))) + "]") if self.lengths else None
        # few mentions are one regex, the longest first; of many, every alternative would be tried in turn
        self.whole = re.compile("|".join(map(re.escape, sorted(cands, key=lambda m: (-len(m), m))))) if 0 < len(cands) <= ALTERNATIVES else None

    def at(self, text: str, l: int) -> int:
        """End of the longest mention starting at ``l``, or -1."""
        for n in self.lengths.get(text[l], ()):
            if text[l : l + n] in self.cands and l + n <= len(text):
                return l + n
        return -1

    def scan(self, text: str) -> Iterator[tuple[int, int]]:
        if self.whole is not None:
            yield from (m.span() for m in self.whole.finditer(text))
            return
        l = 0
        while self.first is not None and (hit := self.first.search(text, l)):
            l = hit.start()
            r = self.at(text, l)
            if r < 0:
                l += 1
            else:
                yield l, r
                l = r


@dataclass
class Memory:
    """State of a linking pass: entity counts and the latest entity of each surface."""

    strategy: str = "None"
    counts: dict[str, int] = field(default_factory=dict)
    latest: dict[str, str] = field(default_factory=dict)


class Linker:
    """One ordered pass; ``Memory`` carries what was linked before."""

    def __init__(self, matcher: Matcher, mentions_of: dict[str, list[str]], memory: Memory):
        self.matcher, self.mentions_of, self.memory = matcher, mentions_of, memory

    def choose(self, surface: str) -> tuple[str, str]:
        cands, m = self.matcher.cands[surface], self.memory
        chosen = None
        if "latest" in m.strategy and surface in m.latest:
            chosen = next((c for c in cands if c[0] == m.latest[surface]), None)
        if chosen is None and "freq" in m.strategy:
            top = max(m.counts.get(e, 0) for e, _ in cands)
            chosen = next(c for c in cands if m.counts.get(c[0], 0) == top)
        chosen = chosen or cands[0]
        if "latest" in m.strategy:
            m.latest.update((s, chosen[0]) for s in self.mentions_of[chosen[0]])
        if "freq" in m.strategy:
            m.counts[chosen[0]] = m.counts.get(chosen[0], 0) + 1
        return chosen

    def link(self, text: str) -> list[tuple]:
        if "freq" not in self.memory.strategy:
            return [(l, r, text[l:r], *self.choose(text[l:r])) for l, r in self.matcher.scan(text)]
        out, l = [], 0
        while l < len(text):
            r = self.matcher.at(text, l)
            if r < 0:
                l += 1
                continue
            # mentions that start inside the found one compete by count, the first wins ties
            rivals = {text[l:r]: (l, r, self.choose(text[l:r]))}
            for k in range(l + 1, r):
                q = self.matcher.at(text, k)
                if q >= 0:
                    rivals[text[k:q]] = (k, q, self.choose(text[k:q]))
            top = max(self.memory.counts.get(c[0], 0) for _, _, c in rivals.values())
            a, b, got = next(x for x in rivals.values() if self.memory.counts.get(x[2][0], 0) == top)
            out.append((a, b, text[a:b], *got))
            l = b
        return out


def _mentions_of(lexicon: Lexicon) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for m, e in sorted(lexicon.pairs):
        out.setdefault(e, []).append(m)
    return out


_LINK_TYPE = pa.struct([("l", pa.int32()), ("r", pa.int32()), ("surface", pa.string()), ("entity", pa.string()), ("etype", pa.string())])
_CAND_TYPE = pa.struct([("entity", pa.string()), ("etype", pa.string())])
_CANDS_TYPE = pa.struct([("l", pa.int32()), ("r", pa.int32()), ("surface", pa.string()), ("cands", pa.list_(_CAND_TYPE))])


def _lists(offsets: list[int], rows: pa.Array, texts: list[str | None]) -> pa.Array:
    """One list a text, null for a null."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=pa.array([t is None for t in texts], pa.bool_()))


def link(text: Column, lexicon: Lexicon, spark) -> Column:
    """Array of links (schema LINKS): candidates tie to the lexicographically first entity.  Null text gives null."""
    shared = spark.sparkContext.broadcast(lexicon.candidates())  # size checked by Lexicon

    def links(texts: list[str | None]) -> pa.Array:
        m = Matcher(shared.value)
        fields, offsets = [[] for _ in _LINK_TYPE], [0]
        for t in texts:
            for l, r in m.scan(t or ""):
                for own, x in zip(fields, (l, r, t[l:r], *m.cands[t[l:r]][0])):
                    own.append(x)
            offsets.append(len(fields[0]))
        return _lists(offsets, pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(fields, _LINK_TYPE)], fields=list(_LINK_TYPE)), texts)

    @F.arrow_udf(LINKS)
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(links, pa.list_(_LINK_TYPE))(texts)

    return run(text)


def link_all(text: Column, lexicon: Lexicon, spark) -> Column:
    """Like ``link``, every span with all its candidates."""
    shared = spark.sparkContext.broadcast(lexicon.candidates())

    def links(texts: list[str | None]) -> pa.Array:
        m = Matcher(shared.value)
        spans, offsets, cands, starts = [[], [], []], [0], [[], []], [0]
        for t in texts:
            for l, r in m.scan(t or ""):
                for own, x in zip(spans, (l, r, t[l:r])):
                    own.append(x)
                for e, k in m.cands[t[l:r]]:
                    cands[0].append(e)
                    cands[1].append(k)
                starts.append(len(cands[0]))
            offsets.append(len(spans[0]))
        pairs = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(cands, _CAND_TYPE)], fields=list(_CAND_TYPE))
        rows = pa.StructArray.from_arrays([*(pa.array(x, f.type) for x, f in zip(spans, _CANDS_TYPE)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs)], fields=list(_CANDS_TYPE))
        return _lists(offsets, rows, texts)

    @F.arrow_udf(CANDS)
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(links, pa.list_(_CANDS_TYPE))(texts)

    return run(text)


def links_table(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, l, r, surface, entity, etype."""
    x = F.explode(link(F.col(text_col), lexicon, docs.sparkSession)).alias("x")
    return docs.select(F.col(id_col).alias("doc_id"), x).select("doc_id", "x.*")


def seeded(strategy: str, lexicon: Lexicon, latest: dict[str, str] | None = None, entity_freq: dict[str, int] | None = None, type_freq: dict[str, int] | None = None) -> Memory:
    """Start of a pass; ``type_freq`` adds to every entity of the type and may be negative."""
    if not set(strategy.split("&")) <= {"None", "freq", "latest"}:
        raise ValueError(f"unknown linking strategy {strategy!r}")
    counts = dict(entity_freq or {})
    for e, t in lexicon.types.items():
        if t in (type_freq or {}):
            counts[e] = counts.get(e, 0) + type_freq[t]
    return Memory(strategy, counts, dict(latest or {}))


def link_with_memory(docs: DataFrame, lexicon: Lexicon, strategy: str = "freq", scope_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", latest: dict[str, str] | None = None, entity_freq: dict[str, int] | None = None, type_freq: dict[str, int] | None = None) -> DataFrame:
    """doc_id, links: an ordered fold over the documents of each scope.

    Default scope is the document itself, which needs no shuffle; a scope
    column folds its documents in id order (one task a scope).
    """
    memory = seeded(strategy, lexicon, latest, entity_freq, type_freq)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.candidates(), _mentions_of(lexicon), memory))
    names = ("l", "r", "surface", "entity", "etype")
    kind = docs.schema[id_col].dataType.simpleString()

    def fresh() -> Linker:
        cands, mentions_of, m = shared.value
        return Linker(Matcher(cands), mentions_of, Memory(m.strategy, dict(m.counts), dict(m.latest)))

    def fold(pdf: pd.DataFrame, linker: Linker | None) -> pd.DataFrame:
        out = []
        for t in pdf["text"]:
            own = linker or fresh()
            out.append(None if t is None else [dict(zip(names, x)) for x in own.link(t)])
        return pd.DataFrame({"doc_id": pdf["doc_id"], "links": out})

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(scope_col).alias("scope")] if scope_col else []))
    schema = f"doc_id {kind}, links {LINKS}"
    if scope_col is None:
        return slim.mapInPandas(lambda it: (fold(pdf, None) for pdf in it), schema)
    return slim.groupBy("scope").applyInPandas(lambda pdf: fold(pdf.sort_values("doc_id", kind="stable"), fresh()), schema)


def link_by_join(docs: DataFrame, mentions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """links_table for a mention table (mention, entity, etype) of any size and mentions of any length.

    Positions where a mention may begin meet the lengths of the mentions of the same
    first two characters, and the strings of these lengths meet the mentions by an
    equi-join, so many mentions that begin alike cost no more than others; the smaller
    side is broadcast where a check of its size allows that.  While there are at most
    ``KEYS`` such beginnings, other positions are dropped before they become rows.
    The greedy pass over the hits of a document takes numbers only.  Ids are taken to be unique.
    """
    m = mentions.where("mention is not null and mention <> ''").groupBy("mention").agg(F.min(F.struct("entity", F.coalesce("etype", F.lit(DEFAULT_TYPE)).alias("etype"))).alias("c"))
    m = checked(m.select("mention", "c.*"), "mentions")
    sizes = checked(m.groupBy(F.substring("mention", 1, 2).alias("key")).agg(F.collect_set(F.length("mention")).alias("sizes")), "mention-sizes")
    longest = sizes.agg(F.max(F.array_max("sizes")).alias("n")).first().n or 0
    keys = [r.key for r in sizes.select("key").limit(KEYS + 1).collect()]
    near = docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("s"), F.col(text_col).alias("near"), F.length(text_col).alias("own")).where("own > 0")
    # windows in windows, each with ``own`` starts and what mentions need beyond them:
    # a substring is found by walking from the start, at every position of a long text that takes quadratic time
    for step in (max(PAGE, longest), max(WINDOW, longest)):
        cut = near.select("doc_id", "s", "near", "own", F.explode(F.sequence(F.lit(1), F.col("own"), F.lit(step))).alias("a"))
        near = cut.select("doc_id", (F.col("s") + F.col("a") - 1).alias("s"), F.substring("near", F.col("a"), F.lit(step + longest)).alias("near"), F.least(F.lit(step), F.col("own") - F.col("a") + 1).alias("own"))
    at = F.sequence(F.lit(1), F.col("own"))
    if len(keys) <= KEYS:
        pairs, ones = [k for k in keys if len(k) > 1], [k for k in keys if len(k) == 1]
        hit = F.substring("near", F.lit(1), F.lit(0)) != ""  # false
        at = F.filter(at, lambda q: (F.substring(F.col("near"), q, F.lit(2)).isin(pairs) if pairs else hit) | (F.substring(F.col("near"), q, F.lit(1)).isin(ones) if ones else hit))
    slots = near.select("doc_id", "s", "near", F.explode(at).alias("q")).select("doc_id", (F.col("s") + F.col("q") - 1).alias("l"), F.substring("near", F.col("q"), F.lit(longest)).alias("ahead"))
    slots = slots.withColumn("key", F.explode(F.array_distinct(F.array(F.substring("ahead", 1, 2), F.substring("ahead", 1, 1)))))
    slots = slots.join(sizes, "key").select("doc_id", "l", "ahead", F.explode("sizes").alias("size")).where(F.length("ahead") >= F.col("size"))
    hits = slots.select("doc_id", "l", F.substring("ahead", F.lit(1), F.col("size")).alias("mention")).join(m, "mention")
    # by place, the longest first
    hit = F.struct("l", (-F.length("mention")).alias("n"), F.col("mention").alias("surface"), "entity", "etype")
    ordered = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(hit)).alias("h"))
    kind = docs.schema[id_col].dataType.simpleString()
    return ordered.mapInArrow(_greedy, f"doc_id {kind}, l int, r int, surface string, entity string, etype string")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of each row that begin where the kept one before has ended."""
    names = ["doc_id", "l", "r", "surface", "entity", "etype"]
    for batch in batches:
        hits = batch.column("h")
        rows = hits.flatten()
        l, n = (rows.field(x).to_numpy() for x in (0, 1))
        ends = np.cumsum(pc.list_value_length(hits).to_numpy(zero_copy_only=False)).tolist()
        for a in range(0, len(ends), GREEDY_ROWS):
            kept, own = [], []
            for d in range(a, min(a + GREEDY_ROWS, len(ends))):
                start, over = ends[d - 1] if d else 0, 0
                for i in range(start, ends[d]):
                    if l[i] >= over:
                        over = l[i] - n[i]
                        kept.append(i)
                        own.append(d)
            got = rows.take(pa.array(kept, pa.int64()))
            begin = got.field(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), begin, pc.subtract(begin, got.field(1)), got.field(2), got.field(3), got.field(4)], names)
    freed()


def mask(text: Column, links: Column) -> Column:
    """The text with every link replaced by ``#type#``."""
    last = F.coalesce(F.try_element_at(links, F.lit(-1))["r"], F.lit(0))
    parts = F.transform(links, lambda x, i: F.concat(_between(text, F.when(i > 0, F.get(links, i - 1)["r"]).otherwise(0), x["l"]), F.lit("#"), x["etype"], F.lit("#")))
    return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))


def standardise(text: Column, links: Column) -> Column:
    """The text with every link replaced by its entity."""
    last = F.coalesce(F.try_element_at(links, F.lit(-1))["r"], F.lit(0))
    parts = F.transform(links, lambda x, i: F.concat(_between(text, F.when(i > 0, F.get(links, i - 1)["r"]).otherwise(0), x["l"]), x["entity"]))
    return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))


def _between(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, a + 1, b - a)


def filter_links(links: Column, char_tags: Column | Callable[[Column], Column], drop: str = "vadcpyz") -> Column:
    """Links of more than one character whose characters aren't all tagged with a dropped tag.

    ``char_tags``: the tags of the text's characters, or a function from a link to
    those of its own, which spares tagging the rest of the text."""
    dropped = lambda tags: F.forall(tags, lambda p: p.rlike(f"^[{drop}]"))
    if callable(char_tags):
        return F.filter(links, lambda x: (x["r"] - x["l"] > 1) & ~dropped(char_tags(x)))
    # bound to a variable: written into the inner lambda, the tags of the whole text would be made again for each link
    both = F.array(F.struct(links.alias("links"), char_tags.alias("tags")))
    kept = lambda z: F.filter(z["links"], lambda x: (x["r"] - x["l"] > 1) & ~dropped(F.slice(z["tags"], x["l"] + 1, x["r"] - x["l"])))
    return F.element_at(F.transform(both, kept), 1)


# -- fuzzy candidates --


def char_candidates(words: DataFrame, lexicon_rows: DataFrame, tolerance: int = 1) -> DataFrame:
    """(word, mention): same length, at most ``tolerance`` different characters.

    Keys with that many wildcards make it an equi-join; a word of n characters
    has about n ** tolerance / tolerance! keys.
    """
    if tolerance < 0:
        raise ValueError("tolerance is 0 or more")

    def keys(c: str) -> Column:
        out = F.array(F.col(c))
        for _ in range(tolerance):
            out = F.array_distinct(F.flatten(F.transform(out, lambda k: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.overlay(k, F.lit("\u0000"), i)))))
        return F.explode(out)

    w = words.select("word").where("word is not null and word <> ''").distinct()
    m = lexicon_rows.select("mention").where("mention <> ''").distinct()
    return w.withColumn("key", keys("word")).join(checked(m.withColumn("key", keys("mention")), "fuzzy-keys"), "key").select("word", "mention").distinct()


def syllables(words: DataFrame, readings: DataFrame) -> DataFrame:
    """(word, syllables) by a table of readings (ch, syllable); characters without one stand for themselves, of several the smallest counts."""
    own = words.select("word").where("word is not null").distinct()
    first = checked(readings.groupBy("ch").agg(F.min("syllable").alias("syllable")), "readings")
    at = own.select("word", F.posexplode(F.split("word", "")).alias("i", "ch")).where("ch <> ''").join(first, "ch", "left")
    told = at.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("syllable", "ch").alias("s")))).alias("x"))
    return told.select("word", F.col("x.s").alias("syllables"))


def pinyin_candidates(words: DataFrame, mentions: DataFrame, adjacency: DataFrame, tolerance: int = 1) -> DataFrame:
    """(word, mention) with equal syllables, or one swapped for a neighbour.

    ``words`` (word, syllables), ``mentions`` (mention, syllables),
    ``adjacency`` (p, neighbor).
    """
    w = words.select("word", "syllables").distinct()
    every = w
    if tolerance == 1:
        at = w.select("word", "syllables", F.posexplode("syllables").alias("i", "p")).join(adjacency.distinct(), "p")
        swapped = F.transform("syllables", lambda s, k: F.when(k == F.col("i"), F.col("neighbor")).otherwise(s))
        every = w.union(at.select("word", swapped.alias("syllables")))
    elif tolerance != 0:
        raise ValueError("tolerance is 0 or 1")
    return every.distinct().join(mentions.select("mention", "syllables").distinct(), "syllables").select("word", "mention").distinct()


def recheck(tokens: DataFrame, links: DataFrame, candidates: DataFrame, lexicon_rows: DataFrame) -> DataFrame:
    """Links plus noun tokens (doc_id, word, flag, l, r) that have a fuzzy candidate; the smallest mention decides."""
    best = candidates.join(lexicon_rows, "mention").groupBy("word").agg(F.min(F.struct("mention", "entity", "etype")).alias("c"))
    nouns = tokens.where(F.col("flag").startswith("n") & ~F.coalesce(F.col("is_entity"), F.lit(False)) if "is_entity" in tokens.columns else F.col("flag").startswith("n"))
    more = nouns.join(checked(best, "fuzzy-best"), "word").select("doc_id", "l", "r", F.col("word").alias("surface"), "c.entity", "c.etype")
    taken = links.select(F.col("doc_id").alias("d"), F.col("l").alias("a"), F.col("r").alias("b"))
    more = more.join(taken, (F.col("doc_id") == F.col("d")) & (F.col("l") < F.col("b")) & (F.col("a") < F.col("r")), "left_anti")
    return links.unionByName(more)


def candidate_spans(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, l, r, mentions) of noun tokens, offsets as in ``tokens``."""
    return tokens.where(F.col("flag").startswith("n")).join(checked(candidates, "fuzzy-candidates"), "word").groupBy("doc_id", "l", "r").agg(F.array_sort(F.collect_set("mention")).alias("mentions"))


def lookup(mentions: DataFrame, lexicon_rows: DataFrame) -> DataFrame:
    """mention -> its entity and type (lexicographically first), null where unknown."""
    best = lexicon_rows.groupBy("mention").agg(F.min(F.struct("entity", "etype")).alias("c")).select("mention", "c.*")
    return mentions.select("mention").join(checked(best, "lexicon"), "mention", "left")


__all__ = ["LINK", "W", "Matcher", "Linker", "Memory", "surfaces", "link", "link_all", "links_table", "link_with_memory", "link_by_join", "mask", "standardise", "filter_links", "char_candidates", "pinyin_candidates", "recheck", "candidate_spans", "lookup", "seeded", "syllables"]
