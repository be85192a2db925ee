"""Structured Streaming: stateless operators run as they are; linking memory is keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lexicon import Lexicon
from ..operators.linking import Linker, Matcher, Memory, _mentions_of, link, seeded
from ..schema import LINKS


def entity_counts(stream: DataFrame, lexicon: Lexicon, ts_col: str = "ts", text_col: str = "text", window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Linked mentions a window; late rows within ``delay`` still count."""
    hit = stream.withWatermark(ts_col, delay).select(ts_col, F.explode(link(F.col(text_col), lexicon, stream.sparkSession)["entity"]).alias("entity"))
    return hit.groupBy(F.window(ts_col, window).alias("w"), "entity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "entity", "n")


def link_with_memory(stream: DataFrame, lexicon: Lexicon, strategy: str, scope_col: str = "scope", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scope, doc_id, links; counts and latest mentions of a scope live in its state."""
    start = seeded(strategy, lexicon)
    cands, mentions_of = lexicon.candidates(), _mentions_of(lexicon)
    names = ("l", "r", "surface", "entity", "etype")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, latest = map(json.loads, state.get) if state.exists else (dict(start.counts), dict(start.latest))
        linker = Linker(Matcher(cands), mentions_of, Memory(strategy, counts, latest))
        pdf = pd.concat(list(frames)).sort_values("doc_id", kind="stable")
        links = [None if t is None else [dict(zip(names, x)) for x in linker.link(t)] for t in pdf["text"]]
        state.update((json.dumps(linker.memory.counts), json.dumps(linker.memory.latest)))
        yield pd.DataFrame({"scope": [key[0]] * len(pdf), "doc_id": pdf["doc_id"].values, "links": links})

    slim = stream.select(F.col(scope_col).cast("string").alias("scope"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.groupBy("scope").applyInPandasWithState(step, f"scope string, doc_id long, links {LINKS}", "counts string, latest string", "append", GroupStateTimeout.NoTimeout)
