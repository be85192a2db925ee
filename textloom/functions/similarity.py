"""Sentence similarities over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the logarithms of both lengths; 0 for sentences of one token or none."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) <= 1) | (F.size(b) <= 1), F.lit(0.0)).otherwise(shared / (F.log2(F.size(a)) + F.log2(F.size(b))))


def bag_cosine(a: Column, b: Column, eps: float = 1e-5) -> Column:
    """Cosine of the count vectors, ``eps`` added to both norms."""
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w)).cast("double")
    total = lambda keys, f: F.aggregate(keys, F.lit(0.0), lambda s, w: s + f(w))
    norm = lambda words: F.sqrt(total(F.array_distinct(words), lambda w: F.pow(count(words, w), F.lit(2)))) + eps
    return total(F.array_intersect(a, b), lambda w: count(a, w) * count(b, w)) / (norm(a) * norm(b))
