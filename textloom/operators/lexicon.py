"""The entity lexicon: mentions, entities and types, as an immutable value.

It is a driver-side value that users write or load, with a checked size
(``MAX_MENTIONS``); larger vocabularies stay tables and link by
``linking.link_by_join``.  All ``add_*`` and ``remove_*`` return a new lexicon.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import PUNCTUATION, char_class
from ..plans.small import local
from ..schema import DEFAULT_TYPE, NEW_WORD_TYPE

MAX_MENTIONS = 2_000_000
#: Part-of-speech tags of the usual entity types; any other type is a noun.
TYPE_TAGS = {"人名": "nr", "地名": "ns", "机构名": "nt", "其他专名": "nz"}
_WIDE = "".join(chr(c) for a, b in ((0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0x2013, 0x201F), (0x3003, 0x3003), (0x3008, 0x301F), (0x3030, 0x3030), (0x303E, 0x303F), (0x2026, 0x2027), (0xFE4F, 0xFE4F)) for c in range(a, b + 1))
_BAD_TYPE = re.compile("[" + re.escape(PUNCTUATION + _WIDE + "|") + "]")


def check_type(etype: str) -> str:
    bad = _BAD_TYPE.search(etype)
    if bad:
        raise ValueError(f"entity type {etype!r} has the punctuation {bad.group()!r}")
    return etype


@dataclass(frozen=True)
class Lexicon:
    """``types``: entity -> type; ``pairs``: (mention, entity)."""

    types: Mapping[str, str] = field(default_factory=dict)
    pairs: frozenset[tuple[str, str]] = frozenset()
    language: str = "zh_CN"
    standard_name: bool = False

    # -- building -----------------------------------------------------------

    def _with(self, types: Mapping[str, str], pairs: Iterable[tuple[str, str]]) -> Lexicon:
        for t in types.values():
            check_type(t)
        out = replace(self, types={**self.types, **types}, pairs=self.pairs | {(m, e) for m, e in pairs if m})
        if len(out.pairs) > MAX_MENTIONS:
            raise ValueError(f"more than {MAX_MENTIONS} mentions; keep them in a table and use link_by_join")
        return out

    def add_entities(self, mentions: Mapping[str, Iterable[str]] | None = None, types: Mapping[str, str] | None = None, override: bool = False) -> Lexicon:
        """Union of both sides: entities without a type get the default, entities without mentions mention themselves."""
        base = replace(self, types={}, pairs=frozenset()) if override else self
        mentions, types = mentions or {}, types or {}
        every = {e: types.get(e, base.types.get(e, DEFAULT_TYPE)) for e in {**mentions, **types}}
        pairs = [(m, e) for e, ms in mentions.items() for m in ms] + [(e, e) for e in types if e not in mentions and not any(x == e for _, x in base.pairs)]
        return base._with(every, pairs)

    def add_typed_words(self, words: Mapping[str, Iterable[str]]) -> Lexicon:
        """Words that are their own entity; the later type wins."""
        types = {w: t for t, ws in words.items() for w in ws}
        return self._with(types, [(w, w) for w in types])

    def add_new_words(self, words: Iterable[str]) -> Lexicon:
        return self.add_typed_words({NEW_WORD_TYPE: list(words)})

    def add_new_mentions(self, mentions: Mapping[str, Iterable[str]]) -> Lexicon:
        unknown = sorted(set(mentions) - set(self.types))
        if unknown:
            raise KeyError(f"unknown entities: {unknown}")
        return self._with({}, [(m, e) for e, ms in mentions.items() for m in ms])

    def add_new_entity(self, entity: str, mention: str | None = None, etype: str = DEFAULT_TYPE) -> Lexicon:
        return self._with({entity: etype}, [(mention or entity, entity)])

    def remove_mention(self, mention: str) -> Lexicon:
        return replace(self, pairs=frozenset(p for p in self.pairs if p[0] != mention))

    def remove_entity(self, entity: str) -> Lexicon:
        return replace(self, types={e: t for e, t in self.types.items() if e != entity}, pairs=frozenset(p for p in self.pairs if p[1] != entity))

    def clear(self) -> Lexicon:
        """Empty; language and naming options stay."""
        return replace(self, types={}, pairs=frozenset())

    # -- views --------------------------------------------------------------

    def candidates(self) -> dict[str, list[tuple[str, str]]]:
        """mention -> its (entity, type) in lexicographic order."""
        out: dict[str, list[tuple[str, str]]] = {}
        for m, e in sorted(self.pairs):
            out.setdefault(m, []).append((e, self.types[e]))
        return out

    def by_type(self) -> dict[str, dict[str, set[str]]]:
        out: dict[str, dict[str, set[str]]] = {}
        for m, e in self.pairs:
            out.setdefault(self.types[e], {}).setdefault(e, set()).add(m)
        return out

    def mentions_df(self, spark: SparkSession) -> DataFrame:
        return local(spark, sorted(self.pairs), "mention string, entity string")

    def entities_df(self, spark: SparkSession) -> DataFrame:
        return local(spark, sorted(self.types.items()), "entity string, etype string")

    def joined_df(self, spark: SparkSession) -> DataFrame:
        """mention, entity, etype."""
        return local(spark, [(m, e, self.types[e]) for m, e in sorted(self.pairs)], "mention string, entity string, etype string")

    def mention2entity(self, mention: str) -> tuple[str, str] | tuple[None, None]:
        """Exact mention, else the longest known mention inside it (leftmost on ties)."""
        known = self.candidates()
        for n in range(len(mention), 0, -1):
            for a in range(len(mention) - n + 1):
                if mention[a : a + n] in known:
                    return known[mention[a : a + n]][0]
        return None, None

    def tag_of(self, etype: str) -> str:
        return TYPE_TAGS.get(etype, "n")

    @classmethod
    def from_tables(cls, entities: DataFrame, mentions: DataFrame, **options) -> Lexicon:
        """From (entity, etype) and (mention, entity); size checked before anything is collected."""
        n = mentions.limit(MAX_MENTIONS + 1).count()
        if n > MAX_MENTIONS:
            raise ValueError(f"more than {MAX_MENTIONS} mentions; use link_by_join")
        types = {r.entity: check_type(r.etype or DEFAULT_TYPE) for r in entities.collect()}
        pairs = frozenset((r.mention, r.entity) for r in mentions.collect() if r.mention)
        return cls({**{e: DEFAULT_TYPE for _, e in pairs}, **types}, pairs, **options)

    # -- files --------------------------------------------------------------

    def save_text(self, spark: SparkSession, path: str) -> None:
        """``entity||type mention||type ...`` a line."""
        rows = self.joined_df(spark).groupBy("entity", "etype").agg(F.array_sort(F.collect_set("mention")).alias("m"))
        line = F.array_join(F.concat(F.array(F.concat_ws("||", "entity", "etype")), F.transform("m", lambda x: F.concat_ws("||", x, F.col("etype")))), " ")
        rows.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load_text(cls, spark: SparkSession, path: str, base: Lexicon | None = None, override: bool = True) -> Lexicon:
        """Adds to ``base`` unless ``override``; the first item of a line is the entity."""
        item = F.posexplode(F.split("value", r"\s+")).alias("pos", "item")
        rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.length(F.trim("value")) > 0).select("line", item)
        parts = F.split("item", r"\|\|")
        got = rows.select("line", "pos", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("etype")).where("name <> ''").collect()
        head = {r.line: (r.name, r.etype or DEFAULT_TYPE) for r in got if r.pos == 0}
        mentions: dict[str, set[str]] = {e: set() for e, _ in head.values()}
        for r in got:
            if r.pos:
                mentions[head[r.line][0]].add(r.name)
        return (base or cls()).add_entities({e: m or {e} for e, m in mentions.items()}, dict(head.values()), override)

    def save(self, spark: SparkSession, path: str) -> None:
        self.entities_df(spark).write.mode("overwrite").parquet(f"{path}/entities")
        self.mentions_df(spark).write.mode("overwrite").parquet(f"{path}/mentions")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> Lexicon:
        return cls.from_tables(spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/mentions"), **options)


def punctuation_class() -> str:
    return char_class(PUNCTUATION)
