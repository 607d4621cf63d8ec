"""Faceted search over the curated table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import render
from platewise.functions.literals import list_elements
from platewise.functions.text import WHITE
from platewise.operators import predicates


def categories(recipes: DataFrame) -> DataFrame:
    """(category): the distinct trimmed lower-case parts of the comma-separated categories, in order.

    Null categories count for nothing, blank parts are the empty string. Distinct texts are split, not all rows.
    """
    texts = recipes.select("category").filter("category is not null").distinct()
    part = F.explode(F.split(F.lower("category"), ",")).alias("part")
    trimmed = F.regexp_replace("part", rf"^{WHITE}|(?U)\s+$", "")
    return texts.select(part).select(trimmed.alias("category")).distinct().orderBy("category")


def cuisines(recipes: DataFrame, category: str | None = None) -> DataFrame:
    """(cuisine): the distinct non-null cuisines, of recipes whose category contains ``category`` if given."""
    rows = recipes.filter(predicates.every(predicates.facets(category=category)))
    return rows.select("cuisine").filter("cuisine is not null").distinct()


def names(recipes: DataFrame, cuisine: str | None = None, category: str | None = None, ingredient: str | None = None) -> DataFrame:
    """(name, id) of the recipes that meet the facets."""
    return recipes.filter(predicates.every(predicates.facets(cuisine, category, ingredient))).select("name", "id")


def names_like(recipes: DataFrame, name: str) -> DataFrame:
    """(name, id) of the recipes whose name contains ``name``, case aside; '' matches all."""
    return recipes.filter(predicates.folded_like(F.col("name"), name)).select("name", "id")


def names_with(recipes: DataFrame, ingredients: Iterable[str]) -> DataFrame:
    """(name, id) of the recipes whose ingredients contain every term; no terms find nothing."""
    return recipes.filter(predicates.all_terms(F.col("ingredients"), ingredients)).select("name", "id")


def texts(recipes: DataFrame) -> DataFrame:
    """(id, text): every recipe as text.

    One pass over the lists finds out first whether the JVM can read them all; if not, those it can't go to Python.
    """
    lists = (F.col(c) for c in ("ingredients", "instructions"))
    strict = not recipes.filter(reduce(Column.__or__, (c.isNotNull() & list_elements(c).isNull() for c in lists))).isEmpty()
    body = render.recipe_text(*(F.col(c) for c in ("name", "portions", "description", "ingredients", "instructions")), strict=strict)
    return recipes.select("id", body.alias("text"))


def found_texts(recipes: DataFrame, cuisine: str | None = None, category: str | None = None, ingredient: str | None = None, most: int = 3) -> DataFrame:
    """(id, text) of the ``most`` recipes of smallest id that meet the facets.

    Sorting and limiting are one operator that keeps ``most`` rows per task, and only those are rendered.
    """
    kept = recipes.filter(predicates.every(predicates.facets(cuisine, category, ingredient)))
    return texts(kept.orderBy("id").limit(most))


def text_by_id(recipes: DataFrame, key: int | None) -> DataFrame:
    """(id, text) of one recipe; no row for None or an unknown id."""
    return texts(recipes.filter(F.lit(False) if key is None else F.col("id") == key).limit(1))


def summary_by_id(recipes: DataFrame, key: int | None, cuisine: str | None = None, category: str | None = None) -> DataFrame:
    """(id, text) as :func:`text_by_id`, under a header of what was asked for."""
    text = render.summary(F.col("text"), F.lit(cuisine).cast("string"), F.lit(category).cast("string"))
    return text_by_id(recipes, key).select("id", text.alias("text"))


def by_url(df: DataFrame, url: str) -> DataFrame:
    """One row of the address, the first by id; none for an unknown address."""
    return df.filter(F.col("url") == url).orderBy("id").limit(1)


def by_ids(df: DataFrame, ids: Iterable[int]) -> DataFrame:
    """The rows of the given ids."""
    return df.filter(F.col("id").isin(list(ids)))


def url_exists(df: DataFrame, url: str) -> DataFrame:
    """(found): whether any row has the address, as one row."""
    return df.filter(F.col("url") == url).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


#: What is said where an identifier is no integer, and where nothing has it.
INVALID, NOT_FOUND = "Invalid recipe ID.", "Can't find anything to cook"


def answer(recipes: DataFrame, asked: str | None, cuisine: str | None = None, category: str | None = None) -> DataFrame:
    """(text): the one answer to a choice: the summary of the recipe whose identifier the text ``asked`` spells, or why there is none.

    No text at all is an identifier that nothing has.
    """
    key = predicates.asked_id(asked)
    if key is None and asked is not None:
        return recipes.sparkSession.createDataFrame([(INVALID,)], "text string")
    known = -(1 << 63) <= key < 1 << 63 if key is not None else False
    found = summary_by_id(recipes, key if known else None, cuisine, category).select("text")
    return found.agg(F.coalesce(F.first("text"), F.lit(NOT_FOUND)).alias("text"))


def options(found: DataFrame, most: int = 10, seed: int = 0) -> DataFrame:
    """What a guided search shows of the rows ``found``: all if there are at most ``most``, else ``most`` of them drawn at random."""
    return sampled(found, most, seed)


def sampled(df: DataFrame, most: int = 10, seed: int = 0) -> DataFrame:
    """``most`` rows drawn uniformly without replacement; all rows if there are no more."""
    return df.orderBy(F.rand(seed)).limit(most)
