"""Rendering of rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.literals import list_elements
from platewise.operators.numbering import numbered


def lines(text: Column, enumerated: bool = False, strict: bool = False) -> Column:
    """A list literal, read with ``strict`` or without, as lines, numbered "1. " and so on if ``enumerated``; '' for null and for no list."""
    elements = F.transform(list_elements(text, strict), lambda x: F.coalesce(x, F.lit("None")))
    if enumerated:
        elements = F.transform(elements, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.coalesce(F.array_join(elements, "\n"), F.lit(""))


def shown(value: Column) -> Column:
    """A value as text; null shows as "None"."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def recipe_text(name: Column, portions: Column, description: Column, ingredients: Column, instructions: Column, strict: bool = False) -> Column:
    """A recipe as HTML text. Nothing is escaped, and the portions line is always there."""
    return F.concat(
        F.lit("<b>"), shown(name), F.lit("</b>\n\nPortions: "), shown(portions),
        F.lit("\n<i>"), shown(description), F.lit("</i>\n\n<b>Ingredients:</b>\n"), lines(ingredients, strict=strict),
        F.lit("\n\n<b>Instructions:</b>\n"), lines(instructions, enumerated=True, strict=strict),
    )


def capitalised(text: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def summary(text: Column, cuisine: Column, category: Column) -> Column:
    """``text`` under a header with the cuisine and the category that were asked for, where given."""
    asked = F.concat_ws("", F.concat(F.lit("Cuisine: "), cuisine, F.lit("\n")), F.concat(F.lit("Category: "), capitalised(category), F.lit("\n")))
    return F.concat(asked, text)


#: Values, and bytes of a value, up to which a grid is laid out in the driver.
FEW, SHORT = 1000, 1000


def grid(df: DataFrame, column: str, width: int = 1) -> DataFrame:
    """(line, cells): the distinct non-null texts in order, ``width`` to a line, the last line maybe shorter.

    The few options of a menu are laid out in the driver, more or longer ones by tasks.
    """
    options = df.select(F.col(f"`{column}`").alias("v")).filter("v is not null").distinct()
    found = [r[0] for r in options.select(F.when(F.octet_length("v") <= SHORT, F.col("v"))).limit(FEW + 1).collect()]
    if len(found) <= FEW and None not in found:
        found.sort(key=str.encode)
        lines = [(k // width, found[k : k + width]) for k in range(0, len(found), width)]
        return df.sparkSession.createDataFrame(lines, "line long, cells array<string>")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])
    return numbered(options, "v", name="at").groupBy(F.floor(F.col("at") / width).alias("line")).agg(cells.alias("cells"))
