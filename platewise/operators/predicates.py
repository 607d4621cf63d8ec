"""Search predicates (P1 to P6, P10, P11): optional arguments to column conditions.

An argument of None puts no condition; the empty string is an argument. ``%`` and ``_`` in arguments are wildcards,
a backslash is itself. Case is folded on both sides. Null values match nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded_like(column: Column, argument: str, lead: str = "") -> Column:
    """Whether ``lead`` and ``argument`` occur in the text, case aside."""
    pattern = argument.lower().replace("\\", "\\\\")
    return F.lower(column).like(f"%{lead}{pattern}%")


def every(conditions: Iterable[Column]) -> Column:
    """All conditions; true for none."""
    return reduce(Column.__and__, conditions, F.lit(True))


def facets(cuisine: str | None = None, category: str | None = None, ingredient: str | None = None) -> list[Column]:
    """The conditions of a faceted search: equal cuisine, category that contains, ingredient at a word's start."""
    conditions = []
    if cuisine is not None:
        conditions.append(F.col("cuisine") == cuisine)
    if category is not None:
        conditions.append(folded_like(F.col("category"), category))
    if ingredient is not None:
        conditions.append(folded_like(F.col("ingredients"), ingredient, lead=" "))
    return conditions


def all_terms(column: Column, terms: Iterable[str]) -> Column:
    """Whether the text contains every term; terms are trimmed, blank ones dropped, and no terms match nothing."""
    wanted = [t for t in (term.strip() for term in terms) if t]
    return every(folded_like(column, t) for t in wanted) if wanted else F.lit(False)


def asked_terms(text: str) -> list[str]:
    """The comma-separated terms of a user's text."""
    return text.split(",")


def asked_id(text: str | None) -> int | None:
    """The identifier in a user's text, None if it is no integer."""
    try:
        return int(text)
    except (TypeError, ValueError):
        return None
