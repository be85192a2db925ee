"""Text cleaning as Column expressions; the order of the steps is part of the result.

All steps but entity unescaping and percent decoding stay in the JVM and
collapse into one projection.  Null text gives null.
"""

from __future__ import annotations

import html
import re
import urllib.parse
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.batches import in_pieces

#: Punctuation of Chinese and ASCII text, by code point.
PUNCTUATION = "".join(sorted("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~" + "".join(map(chr, (0xB7, 0xFFE5, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x3001, 0x3002, 0x300A, 0x300B, 0x300C, 0x300D, 0x3010, 0x3011, 0xFF01, 0xFF02, 0xFF08, 0xFF09, 0xFF0C, 0xFF1A, 0xFF1B, 0xFF1F)))))
PICTOGRAPHS = [(0x2702, 0x27B0), (0x1F1E0, 0x1F1FF), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF)]
URL = r"https?://[a-zA-Z0-9!#-&*-;=?@~]+"
EMAIL = r"[-A-Za-z0-9_.]+@(?:[-A-Za-z0-9]+\.)+[A-Za-z]{2,6}"
TAG = r"</?[^ >/]+[^>]*>"


def char_class(chars: str) -> str:
    """A regex class of exactly these characters, for Java and RE2."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def replace(text: Column, pattern: str, new: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(new))


def _mapped(f: Callable[[str], str], text: Column) -> Column:
    """``f`` over Arrow batches.  The UDF is made when it is used: workers import this module without a session."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(lambda own: pa.array([None if t is None else f(t) for t in own], pa.string()), pa.string())(texts)

    return run(text)


def unescape_html(text: Column) -> Column:
    return _mapped(html.unescape, text)


def _unquote(text: Column) -> Column:
    return _mapped(urllib.parse.unquote, text)


def percent_encode(text: Column) -> Column:
    """Percent-encoding that keeps ``/`` and ``~`` and writes blanks as %20."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("%7E", "~"), ("%2F", "/"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def percent_decode(text: Column) -> Column:
    """Percent-decoding that keeps ``+`` and leaves malformed escapes alone."""
    plain = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    hard = text.contains("%") & (plain.isNull() | plain.contains("�"))
    # Python gets every row, whatever the branch; it is sent the few texts that it has to decode
    return F.when(~text.contains("%"), text).otherwise(F.when(hard, _unquote(F.when(hard, text))).otherwise(plain))


def strip(text: Column) -> Column:
    return replace(text, r"(?U)^\s+|\s+$")


def to_simplified(text: Column, table: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Character conversion by a supplied table; with ``phrases`` the longest known phrase from the left goes first."""
    if not phrases:
        return F.translate(text, "".join(table), "".join(table.values()))
    known = re.compile("|".join(map(re.escape, sorted(phrases, key=lambda p: (-len(p), p)))))
    single = str.maketrans(table)

    def convert(t: str) -> str:
        out, at = [], 0
        for m in known.finditer(t):
            out += [t[at : m.start()].translate(single), phrases[m.group()]]
            at = m.end()
        return "".join([*out, t[at:].translate(single)])

    return _mapped(convert, text)


def clean_text(
    text: Column,
    remove_url: bool = True,
    email: bool = True,
    weibo_at: bool = True,
    stop_terms: str | Iterable[str] = ("转发微博",),
    emoji: bool = True,
    weibo_topic: bool = False,
    markdown_hyperlink: bool = True,
    deduplicate_space: bool = True,
    norm_url: bool = False,
    norm_html: bool = False,
    to_url: bool = False,
    remove_puncts: bool = False,
    remove_tags: bool = True,
    t2s: dict[str, str] | None = None,
    expression_len: tuple[int, int] | None = (1, 6),
    linesep2space: bool = False,
    custom_regex: str | list[str] | None = None,
) -> Column:
    """Cleans micro-blog and web text.  ``t2s`` takes the conversion table."""
    if norm_url and to_url:
        raise ValueError("norm_url and to_url contradict each other")
    t = replace(text, r"[\x{200b}-\x{200d}]")
    t = replace(t, r"\\u200[b-d]")
    for pattern in [custom_regex] if isinstance(custom_regex, str) else custom_regex or []:
        t = replace(t, pattern)
    if norm_html:
        t = unescape_html(t)
    if to_url:
        t = percent_encode(t)
    if remove_tags:
        t = replace(t, TAG)
    if markdown_hyperlink:
        t = replace(t, r"(?U)(?d)\[(.+?)\]\(\S+\)", "$1")
    if weibo_topic:
        t = replace(t, "(?d)#.+#")
    if emoji:
        bounds = "{%d,%d}?" % tuple(expression_len) if expression_len is not None and len(tuple(expression_len)) == 2 else "+?"
        t = replace(t, rf"(?U)\[\S{bounds}\]")
        t = replace(t, "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in PICTOGRAPHS) + "]+")
    if remove_url:
        t = replace(t, "(?i)" + URL)
    if norm_url:
        t = percent_decode(t)
    if email:
        t = replace(t, EMAIL)
    if weibo_at:
        t = replace(t, r"(?U)(?d)(?:回复)?(?://)?\s*@\S*?\s*(?::|：| |$)", " ")
    if linesep2space:
        t = F.replace(t, F.lit("\n"), F.lit(" "))
    if deduplicate_space:
        t = replace(t, r"(?U)(\s)+", "$1")
    if t2s:
        t = to_simplified(t, t2s)
    for term in [stop_terms] if isinstance(stop_terms, str) else stop_terms:
        t = F.replace(t, F.lit(term), F.lit(""))
    if remove_puncts:
        t = replace(t, char_class(PUNCTUATION))
    return strip(t)


def only_han(text: Column) -> Column:
    return replace(text, r"[^\x{4e00}-\x{9fa5}]")
