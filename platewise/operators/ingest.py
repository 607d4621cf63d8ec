"""Ingestion (J1, D1, P11, S1, S2, S6 to S8, R1 to R3): the crawl frontier, staging and the curated table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import jsonld
from platewise.sources import pages as html

#: Schemas of the three tables.
FRONTIER = "id long, url string, completed boolean"
STAGING = "id long, url string, name string, data string"
CURATED = (
    "id long, name string, description string, image string, keywords string, cook_time string, prep_time string, total_time string, "
    "category string, cuisine string, ingredients string, instructions string, portions string, "
    "calories double, fat double, saturated_fat double, carbohydrate double, sugar double, fiber double, protein double, sodium double"
)


def _places(spark: SparkSession, path: str) -> tuple:
    """The file system of a table, its path, and those of what is to take its place and of what it took the place of."""
    at, new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new", f"{path}.old"))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, new, old


def opened(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one is made if there is none."""
    files, at, _, old = _places(spark, path)
    if not files.exists(at):
        if files.exists(old):  # a run ended between the two moves of an exchange
            files.rename(old, at)
        else:
            spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def unfinished(frontier: DataFrame) -> DataFrame:
    """Rows that are not completed; null is not false."""
    return frontier.filter("completed = false")


def finished(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """The frontier with ``completed`` true for the addresses in ``urls``; other rows are as they were."""
    done = urls.select(F.col("url").alias("__url")).distinct()
    marked = frontier.join(done, F.col("url") == F.col("__url"), "left")
    completed = F.when(F.col("__url").isNotNull(), True).otherwise(F.col("completed")).alias("completed")
    return marked.select(*(completed if c == "completed" else F.col(f"`{c}`") for c in frontier.columns))


def absent(incoming: DataFrame, existing: DataFrame, key: str = "url", order: str = "id") -> DataFrame:
    """The rows of ``incoming`` whose ``key`` is not in ``existing``: of several with one key, the first by ``order``.

    Null is a key like any other: its first row is added unless ``existing`` has a null key. Rows without an ``order`` come
    after those with one, and of rows equal in it the one smallest in the other columns is first. The first row is
    found by an aggregation that combines before the shuffle, so a key repeated by a third of the rows is no hot group.
    """
    place = F.col(f"`{order}`")
    ties = [F.col(f"`{f.name}`") for f in incoming.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = incoming.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.min_by(F.struct("*"), F.struct(place.isNull(), place, *ties)).alias("__row"))
    held = existing.select(F.col(f"`{key}`").alias("__held")).distinct()
    return first.join(held, F.col("__key").eqNullSafe(F.col("__held")), "left_anti").select("__row.*")


def append(rows: DataFrame, path: str) -> None:
    """Append to a table; one job, committed as a whole."""
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in place of the table at ``path``, which they may be read from.

    They are written beside it first, and the old table is moved aside, not deleted, before they take its place; a run that fails
    at any point leaves either table whole, and :func:`opened` brings the old one back where neither has the name.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}.new")
    files, at, new, old = _places(spark, path)
    files.delete(old, True)
    if files.exists(at):
        files.rename(at, old)
    files.rename(new, at)
    files.delete(old, True)
    spark.catalog.refreshByPath(path)


def staged(pages: DataFrame) -> DataFrame:
    """(id, url, name, data) of the recipe pages among (id, url, html): title, and the text of the record script."""
    read = pages.select("id", "url", html.facts(F.col("html")).alias("page"))
    kept = read.filter(F.col("page.is_recipe") & F.col("page.record").isNotNull())
    return kept.select("id", "url", F.col("page.title").alias("name"), F.col("page.record").alias("data"))


#: Columns of the curated table.
COLUMNS = [c.split()[0] for c in CURATED.split(", ")]


def curated(staging: DataFrame) -> DataFrame:
    """Rows of the curated table from the JSON-LD records in staging, by the staging id."""
    return jsonld.curated(jsonld.recipe_records(staging, "data", "id")).select(*COLUMNS)


def models(rows: DataFrame) -> DataFrame:
    """Rows of the curated table as models: lists read from their text, portions as an integer, nutrition as text.

    Nulls stay null, and so does what can't be read: text that is no list, portions that are no integer.
    """
    return jsonld.modelled(rows.select(*COLUMNS))


def rows_of(recipes: DataFrame) -> DataFrame:
    """Models as rows of the curated table, the reverse of :func:`models`; nutrition that is no number becomes null."""
    return jsonld.curated(recipes.select(*COLUMNS)).withColumn("portions", F.col("portions").cast("string"))
