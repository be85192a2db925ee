"""Automatic paragraphs: block similarity between sentences, depth scores, boundary choice and alignment."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import segment
from ..functions.clean import PUNCTUATION
from .summary import cosine

_PUNCT = re.compile("[" + re.escape(PUNCTUATION) + "]")


def depth_scores(sims: list[float]) -> np.ndarray:
    """Depth of each valley below the peaks at its sides.

    The right side looks at all but the last two values, the left side at all;
    the last position, the end of the text, has no depth.
    """
    s = np.asarray(sims, float)
    left, right = s.copy(), s.copy()
    done = 0
    for i in range(len(s) - 2):
        if s[i + 1] < s[i]:
            right[done : i + 1] = s[i]
            done = i + 1
    done = len(s)
    for i in range(len(s) - 1, 0, -1):
        if s[i - 1] < s[i]:
            left[i:done] = s[i]
            done = i
    return (left + right - 2 * s)[:-1]


def align(found: list[int], given: list[int]) -> list[int]:
    """Moves each boundary to the nearest unused given one, leaving enough for the rest."""
    left, out = list(given), []
    for i, want in enumerate(found):
        last = len(left) - len(found) + i
        best, dist = last, left[last]
        for j in range(last + 1):
            d = abs(want - left[j])
            if d > dist:
                break
            best, dist = j, d
        out.append(left[best])
        del left[: best + 1]
    return out


def boundaries(words: list[list[str]], num_paras: int | None = None, block_sents: int = 3, std_weight: float = 0.5, given: list[int] | None = None) -> list[int]:
    """Ends of paragraphs as sentence numbers; the last is the number of sentences."""
    n = len(words)
    if n == 0:
        return []
    sims = [0.0] * n
    for i in range(1, n):
        before = [w for s in words[max(0, i - block_sents) : i] for w in s]
        after = [w for s in words[i : i + block_sents] for w in s]
        sims[i - 1] = cosine(before, after)
    depths = depth_scores(sims)
    if num_paras is None:
        num_paras = max(1, int(np.sum(depths > depths.mean() - std_weight * depths.std()))) if len(depths) else 1
        if given is not None and num_paras >= len(given):
            return list(given)
    # the deepest valleys, of equal ones the later
    deepest = sorted(range(len(depths)), key=lambda i: (depths[i], i), reverse=True)
    at = sorted(i + 1 for i in deepest[: max(0, num_paras - 1)]) + [n]
    return align(at, given) if given is not None else at


def cut(paras: list[list[str]], tokens: list[list[list[str]]], num_paras: int | None, block_sents: int, std_weight: float, align_boundary: bool, joiner: str) -> list[str]:
    sents = [s for p in paras for s in p]
    words = [w for p in tokens for w in p]
    given = np.cumsum([len(p) for p in paras]).tolist() if align_boundary else None
    if given is not None and num_paras is not None and num_paras >= len(paras):
        ends = given
    else:
        ends = boundaries(words, num_paras, block_sents, std_weight, given)
    return [joiner.join(sents[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def cut_paragraphs(docs: DataFrame, num_paras: int | None = None, block_sents: int = 3, std_weight: float = 0.5, align_boundary: bool = True, stopwords: set[str] = frozenset(), remove_puncts: bool = True, seq_chars: int = -1, deduplicate: bool = False, language: str = "zh_CN", tokenizer=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, para, text).  Sentences (or pieces of ``seq_chars`` characters) are
    cut in the JVM, boundaries found in an Arrow batch without any shuffle.
    ``tokenizer``: str -> list of words; default: runs of word characters, Han one by one.
    """
    if num_paras is not None and num_paras <= 0:
        raise ValueError("num_paras must be positive")
    text = F.col(text_col)
    pieces = (lambda t: segment.chunks(t, seq_chars, deduplicate=deduplicate)) if seq_chars >= 1 else (lambda t: segment.cut_sentences(t, deduplicate=deduplicate, language=language))
    paras = F.transform(segment.paragraphs(text), pieces) if align_boundary else F.array(pieces(text))
    kind = docs.schema[id_col].dataType.simpleString()
    joiner = " " if language == "en" else ""
    default = re.compile(r"[一-鿿]|[^\W一-鿿]+" + ("" if remove_puncts else r"|[^\w\s]"))

    def words(s: str) -> list[str]:
        got = default.findall(s) if tokenizer is None else tokenizer(s)
        if remove_puncts and tokenizer is not None:
            got = [x for w in got for x in _PUNCT.sub("", w).split()]
        return [w for w in got if w not in stopwords]

    def run(batches):
        for batch in batches:
            ids, nums, texts = [], [], []
            for d, ps in zip(batch.column("doc_id").to_pylist(), batch.column("paras").to_pylist()):
                if ps is None:
                    continue
                ps = [p for p in ps if p]
                for k, t in enumerate(cut(ps, [[words(s) for s in p] for p in ps], num_paras, block_sents, std_weight, align_boundary, joiner)):
                    ids.append(d)
                    nums.append(k)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(nums, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "para", "text"])

    return docs.select(F.col(id_col).alias("doc_id"), paras.alias("paras")).mapInArrow(run, f"doc_id {kind}, para int, text string")
