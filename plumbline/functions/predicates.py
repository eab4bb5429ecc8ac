"""Truth tests and keyword rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_number(c: Column | str) -> Column:
    """Present and not zero."""
    return F.coalesce(col(c) != 0, F.lit(False))


def has_text(c: Column | str) -> Column:
    """Present and not empty."""
    return F.coalesce(col(c) != "", F.lit(False))


def or_null(c: Column | str) -> Column:
    """Empty text becomes null, so that coalesce() can pick the next choice."""
    return F.nullif(col(c), F.lit(""))


def contains_any(c: Column | str, words: Sequence[str]) -> Column:
    """The lower-cased text holds at least one of the words, anywhere."""
    lowered = F.lower(col(c))
    hits = [F.contains(lowered, F.lit(w)) for w in words]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def first_label(c: Column | str, rules: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """Label of the first rule with a word in the text; rules are tried in order."""
    expr: Column | None = None
    for label, words in rules.items():
        test = contains_any(c, words)
        expr = F.when(test, F.lit(label)) if expr is None else expr.when(test, F.lit(label))
    return expr.otherwise(F.lit(default).cast("string"))


def matching_labels(c: Column | str, rules: Mapping[str, Sequence[str]]) -> Column:
    """Every label with a word in the text, in rule order."""
    marks = [F.when(contains_any(c, words), F.lit(label)) for label, words in rules.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def is_total_row(c: Column | str, names: Sequence[str]) -> Column:
    return F.lower(col(c)).isin(list(names))


def long_enough(c: Column | str, n: int) -> Column:
    return F.length(col(c)) >= n


def any_value(values: Column) -> Column:
    """At least one entry of the array is not empty."""
    return F.coalesce(F.exists(values, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(False))
