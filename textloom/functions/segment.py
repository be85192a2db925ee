"""Sentence, chunk and word splitting as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import replace, strip

#: Common English abbreviations, for ``cut_sentences``.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Rev", "Gen", "Sen", "St", "Jr", "Sr", "vs", "etc", "e.g", "i.e", "cf", "al", "No", "Fig", "vol", "pp", "Inc", "Ltd", "Co", "Corp", "U.S", "U.K", "a.m", "p.m")
#: Clitics split off English words, and words with inner apostrophes kept as one.
ENGLISH_TOKEN = r"[A-Za-z]+(?=n't)|n't|'(?:s|m|d|ll|re|ve)\b|[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*|\.{3}|[^\s\p{L}\p{N}]"


def dedup_marks(text: Column) -> Column:
    """Runs of one sentence mark become a single mark."""
    return replace(text, r"([。！？!?])\1+", "$1")


def cut_sentences(text: Column, drop_empty_line: bool = True, strip_each: bool = True, deduplicate: bool = False, language: str = "zh_CN", abbreviations: Iterable[str] = ()) -> Column:
    """Array of sentences.  English splits after ``. ! ?`` and blanks, but not
    after a listed abbreviation (written without its stop, as in ABBREVIATIONS);
    Chinese after full-width or ASCII marks and ellipses, behind closing quotes."""
    t = dedup_marks(text) if deduplicate else text
    if language == "en":
        known = "|".join(re.sub(r"(\W)", r"\\\1", a) for a in sorted(abbreviations, key=len, reverse=True))
        stop = rf"(?<!\b(?:{known}))\.|[!?]" if known else "[.!?]"
        cut = F.split(replace(t, rf"((?:{stop})['\"”’)\]]*)\s+", "$1\u0000"), "\u0000")
    else:
        closing = "”’)\\]）】"
        t = replace(t, f"([。！？?!])([^{closing}])", "$1\n$2")
        t = replace(t, rf"(\.{{3,}})([^{closing}….])", "$1\n$2")
        t = replace(t, f"(…+)([^{closing}….])", "$1\n$2")
        t = replace(t, rf"([。！？?!]|\.{{3,}}|…+)([{closing}])([^，。！？?….])", "$1$2\n$3")
        cut = F.split(replace(t, r"(?U)\s+$"), "\n")
    if strip_each:
        cut = F.transform(cut, strip)
    return F.filter(cut, lambda s: F.length(s if strip_each else strip(s)) > 0) if drop_empty_line else cut


def chunks(text: Column, size: int, strip_first: bool = True, deduplicate: bool = False) -> Column:
    """Array of pieces of ``size`` characters; the last one may be shorter."""
    t = dedup_marks(text) if deduplicate else text
    t = strip(t) if strip_first else t
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def words(text: Column, pattern: str = r"[\p{L}\p{N}]+", lower: bool = True) -> Column:
    """Array of words by a regex."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(pattern), F.lit(0))


def english_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENGLISH_TOKEN), F.lit(0))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: F.length(s) > 0)
