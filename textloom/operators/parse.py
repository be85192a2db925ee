"""Subject-verb-object triples from dependency arcs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ARCS, TRIPLE

ATTRIBUTE, OBJECT, SUBJECT, COMPLEMENT, PREPOSITION = "定中关系", "动宾关系", "主谓关系", "动补结构", "介宾关系"


def triples_of(arcs: list[dict], expand: str = "all", entity_types: set[str] = frozenset()) -> list[tuple[str, str, str]]:
    """Triples of one sentence.  Arcs are keyed by id, so arcs of dropped words don't shift heads."""
    if expand not in ("all", "exclude_entity", "None"):
        raise ValueError(f"unknown expansion {expand!r}")
    by_id = {a["id"]: a for a in arcs}
    below: dict[int, dict[str, list[int]]] = {i: {} for i in by_id}
    for a in arcs:
        if a["head"] in below:
            below[a["head"]].setdefault(a["rel"], []).append(a["id"])

    def phrase(i: int, above: frozenset[int] = frozenset()) -> str:
        a = by_id[i]
        if i in above or expand == "None" or expand == "exclude_entity" and a["tag"] in entity_types:
            return a["word"]
        up = above | {i}
        before = "".join(phrase(c, up) for c in below[i].get(ATTRIBUTE, ()))
        after = ""
        if a["tag"] == "v":
            after = "".join(phrase(c, up) for c in below[i].get(OBJECT, ())[:1])
            before = "".join(phrase(c, up) for c in below[i].get(SUBJECT, ())[:1]) + before
        return before + a["word"] + after

    out = []
    for a in arcs:
        if not a["tag"]:
            continue
        own = below[a["id"]]
        if SUBJECT in own and OBJECT in own:
            out.append((phrase(own[SUBJECT][0]), a["word"], phrase(own[OBJECT][0])))
        if a["rel"] == ATTRIBUTE and OBJECT in own and a["head"] in by_id:
            noun, tail = phrase(a["head"]), phrase(own[OBJECT][0])
            noun = noun.removeprefix(a["word"] + tail)
            if a["word"] + tail not in noun:
                out.append((noun, a["word"], tail))
        if SUBJECT in own and COMPLEMENT in own:
            c = own[COMPLEMENT][0]
            if PREPOSITION in below[c]:
                out.append((phrase(own[SUBJECT][0]), a["word"] + by_id[c]["word"], phrase(below[c][PREPOSITION][0])))
    return out


def arcs_of(text: Column, parser: Callable[[str], list[dict]]) -> Column:
    """Array of arcs (schema ARCS) by a parser of one sentence: any function that gives dicts of id, word, tag, rel and head."""

    @F.pandas_udf(ARCS)
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: [{k: a[k] for k in ("id", "word", "tag", "rel", "head")} for a in parser(t)], na_action="ignore")

    return run(text)


def triples(arcs: Column, expand: str = "all", entity_types: set[str] = frozenset()) -> Column:
    """Array of (s, v, o) from an array of arcs (schema ARCS); null arcs give null."""
    types = frozenset(t.strip("#") for t in entity_types)

    @F.pandas_udf(f"array<{TRIPLE}>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda a: [dict(zip("svo", t)) for t in triples_of(list(a), expand, types)], na_action="ignore")

    return run(arcs)


def with_entities(arcs: Column, links: Column, standard_name: bool = False) -> Column:
    """Arcs whose word is the mask ``#type#`` of a link get its surface (or entity) and type, in order."""

    @F.pandas_udf("array<struct<id:int,word:string,tag:string,rel:string,head:int>>")
    def run(col: pd.Series, found: pd.Series) -> pd.Series:
        def one(a, x):
            if a is None:
                return None
            left, out = list(x if x is not None else []), []
            for arc in a:
                arc = dict(arc)
                if left and arc["word"] == f"#{left[0]['etype']}#":
                    k = left.pop(0)
                    arc |= {"word": k["entity"] if standard_name else k["surface"], "tag": k["etype"]}
                out.append(arc)
            return out

        return pd.Series([one(a, x) for a, x in zip(col, found)])

    return run(arcs, links)
