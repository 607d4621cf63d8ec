"""Text normalisation as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space of any kind, as the Unicode property has it.
WHITE = r"(?U)\s+"


def normalised(text: Column) -> Column:
    """Outer white space removed, inner runs made one space, lower case; null stays null."""
    return F.lower(F.trim(F.regexp_replace(text, WHITE, " ")))


def normalised_terms(terms: Column) -> Column:
    """The normalised elements of an array, without null and blank ones; repeats and order stay.

    A null array gives an empty one.
    """
    clean = F.filter(F.transform(terms, normalised), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(clean, F.array().cast("array<string>"))


def term_set(terms: Column) -> Column:
    """The distinct normalised elements of an array, sorted, so that equal sets are equal arrays."""
    return F.array_sort(F.array_distinct(normalised_terms(terms)))
