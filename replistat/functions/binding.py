"""Evaluate a column expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Expressions that repeat a costly part inside conditions are otherwise copied into the plan once
    per use, until the generated code is too large to compile.
    """
    return F.transform(F.array(value), body)[0]


def regex_groups(text: Column, pattern: str, n: int) -> Column:
    """The first ``n`` groups of a whole-text pattern as an array, from one evaluation; else NULL."""
    mark = "\u0001"
    swapped = F.regexp_replace(text, pattern, mark.join(f"${i + 1}" for i in range(n)))
    return bind(F.split(swapped, mark, -1), lambda parts: F.when(F.size(parts) == n, parts))
