"""Recipes in JSON-LD text to flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.literals import list_elements, list_text

#: The fields of nutrition in JSON-LD, the columns they become, and the unit text they lose.
NUTRITION = {
    "calories": ("calories", " calories"),
    "fatContent": ("fat", " grams fat"),
    "saturatedFatContent": ("saturated_fat", " grams saturated fat"),
    "carbohydrateContent": ("carbohydrate", " grams carbohydrates"),
    "sugarContent": ("sugar", " grams sugar"),
    "fiberContent": ("fiber", " grams fiber"),
    "proteinContent": ("protein", " grams protein"),
    "sodiumContent": ("sodium", " milligram of sodium"),
}
#: The optional text fields and the columns they become.
OPTIONAL = {"cookTime": "cook_time", "prepTime": "prep_time", "totalTime": "total_time", "recipeCategory": "category", "recipeYield": "portions", "recipeCuisine": "cuisine"}
SCHEMA = (
    "name string, description string, image struct<url:string>, keywords string, recipeIngredient array<string>, recipeInstructions string, "
    + ", ".join(f"{f} string" for f in OPTIONAL)
    + f", nutrition struct<{','.join(f'{f}:string' for f in NUTRITION)}>"
)


def record(text: Column) -> Column:
    """The JSON object in a text as a struct of ``SCHEMA``, its fields null for null and broken texts.

    A reader of its own would keep the fields before the point where a text breaks off.
    """
    return F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), SCHEMA)


def keyword_list(keywords: Column) -> Column:
    """Keywords of a comma-separated text, with all spaces deleted; null for null."""
    return F.split(F.replace(keywords, F.lit(" "), F.lit("")), ",")


def without_unit(text: Column, unit: str) -> Column:
    """Text without any occurrence of ``unit``; null for null. Not cast."""
    return F.replace(text, F.lit(unit), F.lit(""))


def step_texts(instructions: Column) -> Column:
    """Texts of the step objects in the JSON text of an array of steps, or of one step; plain strings have none."""
    steps = F.coalesce(F.from_json(instructions, "array<string>"), F.array(instructions))
    return F.array_compact(F.transform(steps, lambda s: F.get_json_object(s, "$.text")))


def recipe_records(df: DataFrame, json_column: str, *keep: str) -> DataFrame:
    """Flat records of the JSON-LD objects in ``json_column``, after the columns ``keep``.

    Rows without a name, description, image, ingredients or instructions give no record, nor do null and broken
    texts. Missing keywords are the empty array, other missing fields null. Of the instructions only steps with a
    text count.
    """
    read = df.select(*(F.col(f"`{c}`") for c in keep), record(F.col(f"`{json_column}`")).alias("__r"))
    r = lambda f: F.col(f"__r.{f}")
    needed = ("name", "description", "image.url", "recipeIngredient", "recipeInstructions")
    steps = step_texts(r("recipeInstructions"))
    whole = read.filter(" and ".join(f"__r.{f} is not null" for f in needed))
    return whole.select(
        *(F.col(f"`{c}`") for c in keep),
        r("name").alias("name"), r("description").alias("description"), r("image.url").alias("image"),
        F.coalesce(keyword_list(r("keywords")), F.array().cast("array<string>")).alias("keywords"),
        *(r(f).alias(c) for f, c in OPTIONAL.items()),
        r("recipeIngredient").alias("ingredients"), steps.alias("instructions"),
        *(without_unit(r(f"nutrition.{f}"), unit).alias(c) for f, (c, unit) in NUTRITION.items()),
    )


#: Columns that are lists, and columns that are numbers, in the curated table.
LISTS, NUMBERS = {"keywords", "ingredients", "instructions"}, {c for c, _ in NUTRITION.values()}


def curated(records: DataFrame) -> DataFrame:
    """Records as rows of the curated table: arrays as JSON text, nutrition as doubles (null where it is no number)."""
    changed = lambda c: list_text(F.col(c)).alias(c) if c in LISTS else F.col(c).try_cast("double").alias(c) if c in NUMBERS else F.col(f"`{c}`")
    return records.select(*map(changed, records.columns))


def modelled(rows: DataFrame) -> DataFrame:
    """Rows of the curated table with arrays from their text (either dialect), portions as an integer and nutrition as text."""
    text = lambda c: F.col(c).cast("string").alias(c)
    integer = F.col("portions").try_cast("int").alias("portions")
    changed = lambda c: list_elements(F.col(c), strict=True).alias(c) if c in LISTS else text(c) if c in NUMBERS else integer if c == "portions" else F.col(f"`{c}`")
    return rows.select(*map(changed, rows.columns))
