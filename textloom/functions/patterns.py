"""Word predicates: each maker returns Column -> boolean Column; rules combine them."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]


def all_english() -> Rule:
    return lambda w: w.rlike(r"^[a-zA-Z]*\z")


def all_english_or_num() -> Rule:
    return lambda w: w.rlike(r"^[a-zA-Z0-9]*\z")


def upper_first() -> Rule:
    return lambda w: w.rlike("^[A-Z]")


def starts_with(prefix: str) -> Rule:
    return lambda w: w.startswith(prefix)


def ends_with(suffix: str) -> Rule:
    return lambda w: w.endswith(suffix)


def contains(pattern: str) -> Rule:
    return lambda w: w.rlike(pattern)


def with_length(n: int) -> Rule:
    return lambda w: F.length(w) == n


def any_of(rulesets: list[Rule | tuple[Rule, ...]]) -> Rule:
    """Or over the list, and inside a tuple; an empty list matches nothing."""

    def rule(word: Column) -> Column:
        sets = [functools.reduce(operator.and_, (r(word) for r in (s if isinstance(s, tuple) else (s,))), F.lit(True)) for s in rulesets]
        return functools.reduce(operator.or_, sets, F.lit(False))

    return rule
