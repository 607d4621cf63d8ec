"""Queries of the core, by name, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise import stage
from platewise.functions import jsonld, render
from platewise.functions.literals import list_elements
from platewise.operators import ingest, nested_records, packed_values, predicates, search, units
from platewise.plans import crawl
from platewise.sources import pages, sitemaps
from platewise.sql import SQL  # noqa: F401
from platewise.tables import spread, table

#: The measured fields of the test tables.
CALORIES = units.Quantity("calories", "energy|calories", units.ENERGY, units.NOTE_ENERGY, "kcal")
FAT = units.Quantity("fat", "fat", units.MASS, units.MASS, "g")
SUGAR = units.Quantity("sugar", "sugar", units.MASS, units.MASS, "g")
SODIUM = units.Quantity("sodium", "sodium", units.MASS, units.MASS, "mg")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of a packed category or keywords field that holds at least two."""
    recipes = table(spark, folder, "recipes").select("id", "category")
    # Rows delivered twice are equal in all columns, so equal (id, keywords) are one delivery or carry nothing new.
    parsed = table(spark, folder, "parsed_recipes").select("id", "keywords").dropDuplicates()
    return reduce(
        DataFrame.unionByName,
        [
            packed_values.unpacked(df, field, least=2).select(F.lit(tbl).alias("tbl"), "id", "pos", "item")
            for tbl, df, field in (("recipes", recipes, "category"), ("parsed_recipes", parsed, "keywords"))
        ],
    )


def _amounts(spark: SparkSession, folder: str, stated: bool) -> DataFrame:
    measured = {CALORIES: "energy_unit", FAT: "weight_unit", SUGAR: "weight_unit", SODIUM: "sodium_unit"}
    feeds = table(spark, folder, "feeds").select("feed", *sorted(set(measured.values())))
    if not stated:
        feeds = feeds.select("feed", *(F.lit(None).cast("string").alias(c) for c in feeds.columns[1:]))
    rows = table(spark, folder, "parsed_recipes").select("id", "feed", "nutrition_note", "parsed_at", *(q.field for q in measured))
    rows = spread(rows, "id")
    found = units.in_common_units(rows.join(feeds, "feed", "left"), measured, key="id", note="nutrition_note", source="feed", at="parsed_at")
    return found.select("id", "field", F.round(F.col("amount") * 1000).cast("long").alias("amount_milli"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The amounts, in thousandths of the common unit, of fields written in another unit."""
    return _amounts(spark, folder, stated=True)


def p4_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p4_found without what feeds state of their units: the units of bare numbers are decoded from the numbers themselves."""
    return _amounts(spark, folder, stated=False)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "recipe_urls").select("id", "data"), "id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sections, steps, reviews and replies of every staged recipe, linked to their parents."""
    return nested_records.recipe_tables(_texts(spark, folder), "data", "id", fields=()).select("id", "kind", "node", "parent_node")


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p7_found with the scalars pivoted into columns."""
    return nested_records.recipe_tables(_texts(spark, folder), "data", "id")


def p7_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The adjacency table of the staged texts."""
    return nested_records.shredded(_texts(spark, folder), "data", "id")


def p7_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p7_found with all their fields, and the objects nested in them, linked to their parents."""
    return nested_records.recipe_objects(_texts(spark, folder), "data", "id")


def facet_categories(spark: SparkSession, folder: str) -> DataFrame:
    """A1, A2, L4."""
    return search.categories(table(spark, folder, "recipes"))


def facet_cuisines(spark: SparkSession, folder: str) -> DataFrame:
    """A3, P2."""
    return search.cuisines(table(spark, folder, "recipes"), category="Dessert")


def names_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """P1 to P4, P7."""
    return search.names(table(spark, folder, "recipes"), cuisine="British", category="Dinner", ingredient="Cream")


def name_search(spark: SparkSession, folder: str) -> DataFrame:
    """P6, F1."""
    return search.names_like(table(spark, folder, "recipes"), "CRÈME")


def ingredient_word(spark: SparkSession, folder: str) -> DataFrame:
    """A term after a space, with a live wildcard."""
    return search.names(table(spark, folder, "recipes"), ingredient="Pe_per")


def ingredients_all_of(spark: SparkSession, folder: str) -> DataFrame:
    """P5, F12."""
    return search.names_with(table(spark, folder, "recipes"), predicates.asked_terms(" butter, EGG,, salt"))


def found_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Three texts are the feature."""
    return search.found_texts(table(spark, folder, "recipes"), cuisine="Italian", category="dinner", most=3)


def recipe_texts(spark: SparkSession, folder: str) -> DataFrame:
    """F2, F3 over every recipe."""
    return search.texts(table(spark, folder, "recipes"))


def recipe_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """P8, L2, F13."""
    return search.text_by_id(table(spark, folder, "recipes"), predicates.asked_id(" 7 "))


def recipe_summary(spark: SparkSession, folder: str) -> DataFrame:
    """F10, F17."""
    return search.summary_by_id(table(spark, folder, "recipes"), 11, cuisine="Thai", category="main COURSE")


def guided_search(spark: SparkSession, folder: str) -> DataFrame:
    """What is shown of the recipes with some ingredients: all, or ten drawn at random where there are more."""
    return search.options(search.names_with(table(spark, folder, "recipes"), predicates.asked_terms("butter,Egg , salt")))


def guided_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The answers to a known identifier, one that nothing has, text that is none, and no text."""
    recipes = table(spark, folder, "recipes")
    choices = ("7", "999999999", "7 recipes", None)
    return reduce(DataFrame.unionByName, (search.answer(recipes, c, "Thai", "main COURSE").select(F.lit(c).cast("string").alias("asked"), "text") for c in choices))


def page_by_url(spark: SparkSession, folder: str) -> DataFrame:
    """P9."""
    return search.by_url(table(spark, folder, "sitemap").select("id", "url"), "https://www.claripes-plates.example/sitemaps/2023-q4-0.xml")


def pages_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    """P10."""
    return search.by_ids(table(spark, folder, "recipe_urls").select("id", "url"), [3, 5, 8, 13, 999_999_999])


def url_exists(spark: SparkSession, folder: str) -> DataFrame:
    """P12."""
    return search.url_exists(table(spark, folder, "sitemap"), "https://www.claripes-plates.example/sitemaps/2023-q4-0.xml")


def unfinished_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """P11, S2."""
    return ingest.unfinished(table(spark, folder, "sitemap"))


def finished_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """The sitemaps that recipes were staged from become completed."""
    frontier = table(spark, folder, "sitemap")
    used = table(spark, folder, "recipe_urls").select(F.col("sitemap_id").alias("id")).distinct()
    return ingest.finished(frontier, frontier.join(used, "id", "left_semi").select("url"))


def absent_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The even rows of the frontier are incoming, the completed ones exist."""
    frontier = table(spark, folder, "sitemap")
    return ingest.absent(frontier.filter("completed is null or not completed"), frontier.filter("completed")).select("id", "url")


def staged_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The staging table, with the kind of its JSON text."""
    return table(spark, folder, "recipe_urls").select("id", "url", "name", F.length("data").alias("size"))


def _html(staging: DataFrame) -> DataFrame:
    """Pages as a site would serve the staged rows: title, breadcrumbs (every third a collection), record script."""
    title = F.col("name")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        title = F.replace(title, F.lit(raw), F.lit(safe))
    third = F.when(F.col("id") % 3 == 0, pages.COLLECTION).otherwise("Dessert")
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit(f'</title></head><body><ul class="{pages.BREADCRUMB}"><li>Home</li><li>{pages.SECTION}</li><li>'),
        third, F.lit('</li></ul><script data-testid="page-schema">'), F.col("data"), F.lit("</script></body></html>"),
    )
    return staging.select("id", "sitemap_id", "url", html.alias("html"))


def page_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Title and kind of every page, and its record."""
    served = _html(table(spark, folder, "recipe_urls"))
    return served.select("id", pages.facts(F.col("html")).alias("f")).select("id", "f.title", "f.is_recipe", F.md5("f.record").alias("record"))


def _fetched(frontier: DataFrame, staging: DataFrame) -> DataFrame:
    sites = frontier.select(F.col("id").alias("sitemap_id"), F.col("url").alias("sitemap_url"))
    return _html(staging).join(sites, "sitemap_id").select("id", "sitemap_url", "url", "html")


def _of_completed(frontier: DataFrame, pages_table: DataFrame) -> DataFrame:
    """The pages of all completed sitemaps, as staging has them."""
    done = frontier.filter("completed").select(F.col("id").alias("sitemap_id"))
    return pages_table.join(done, "sitemap_id", "left_semi").select("id", "url", "name", "data")


def crawled_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of unfinished sitemaps that staging lacks; staging has the pages of all completed sitemaps."""
    frontier, pages_table = table(spark, folder, "sitemap"), table(spark, folder, "recipe_urls")
    new, _ = crawl.import_pages(frontier, _fetched(frontier, pages_table), _of_completed(frontier, pages_table))
    return new.select("id", "url", "name")


def crawled_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """The frontier after a run in which the pages of broken JSON couldn't be fetched, and sitemaps without pages were not read."""
    frontier, pages_table = table(spark, folder, "sitemap"), table(spark, folder, "recipe_urls")
    lost = pages_table.select("id", F.try_parse_json("data").isNull().alias("lost"))
    fetched = _fetched(frontier, pages_table).join(lost, "id").withColumn("html", F.when(~F.col("lost"), F.col("html"))).drop("lost")
    _, after = crawl.import_pages(frontier, fetched, _of_completed(frontier, pages_table))
    return after


def staging_appended(spark: SparkSession, folder: str) -> DataFrame:
    """A staging table made anew, the pages of completed sitemaps added to it and then all pages, an address once, read back."""
    frontier, pages_table = table(spark, folder, "sitemap"), table(spark, folder, "recipe_urls")
    path = stage.new_path(spark, "staging")
    for pages_added in (_of_completed(frontier, pages_table), pages_table.select("id", "url", "name", "data")):
        existing = ingest.opened(spark, path, ingest.STAGING)
        ingest.append(ingest.absent(pages_added, existing), path)
    return stage.kept(ingest.opened(spark, path, ingest.STAGING), path).select("id", "url", "name")


def recipes_appended(spark: SparkSession, folder: str) -> DataFrame:
    """A curated table made anew, the curated recipes and then the records of staging appended as they are, read back."""
    path = stage.new_path(spark, "recipes")
    ingest.opened(spark, path, ingest.CURATED)
    ingest.append(table(spark, folder, "recipes").select(*ingest.COLUMNS), path)
    ingest.append(ingest.curated(table(spark, folder, "recipe_urls").select("id", "url", "name", "data")), path)
    return stage.kept(ingest.opened(spark, path, ingest.CURATED), path).select("id", "name", "portions", "calories", "sodium")


def recipe_models_read(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the curated table as a model."""
    return ingest.models(table(spark, folder, "recipes"))


def recipe_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every model as a row of the curated table."""
    return ingest.rows_of(table(spark, folder, "recipe_models"))


def sitemap_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The addresses in one sitemap document per staged page."""
    safe = F.col("url")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(entity))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), safe, F.lit("</loc></url></urlset>"))
    documents = table(spark, folder, "recipe_urls").select(F.col("sitemap_id").alias("id"), xml.alias("xml"))
    return sitemaps.sitemap_rows(documents, "xml", "id")


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Image and nutrition of the records at the top of the JSON text."""
    read = table(spark, folder, "recipe_urls").select("id", jsonld.record(F.col("data")).alias("r"))
    part = lambda f: jsonld.without_unit(F.col(f"r.nutrition.{f}"), jsonld.NUTRITION[f][1])
    return read.select("id", F.col("r.image.url").alias("image"), part("calories").alias("calories"), part("fatContent").alias("fat"), part("sodiumContent").alias("sodium"))


def keyword_lists(spark: SparkSession, folder: str) -> DataFrame:
    """F4."""
    return table(spark, folder, "parsed_recipes").select("id", jsonld.keyword_list(F.col("keywords")).alias("keywords")).distinct()


def curated_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the curated table from staging."""
    return ingest.curated(table(spark, folder, "recipe_urls").select("id", "url", "name", "data"))


def list_literals(spark: SparkSession, folder: str) -> DataFrame:
    """F16: the elements of the ingredients, in either dialect."""
    return table(spark, folder, "recipes").select("id", F.posexplode(list_elements(F.col("ingredients"), strict=True)).alias("pos", "ingredient"))


def menu_grid(spark: SparkSession, folder: str) -> DataFrame:
    """the cuisines, three to a line."""
    return render.grid(table(spark, folder, "recipes"), "cuisine", 3)


def sample_ten(spark: SparkSession, folder: str) -> DataFrame:
    """L3: ten recipes drawn without replacement are the feature."""
    return search.sampled(table(spark, folder, "recipes").select("id", "name"), 10, seed=42)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        facet_categories, facet_cuisines, names_filtered, name_search, ingredient_word, ingredients_all_of, found_texts, recipe_texts, recipe_by_id,
        recipe_summary, page_by_url, pages_by_ids, url_exists, unfinished_sitemaps, finished_sitemaps, absent_urls, staged_pages, page_facts, crawled_pages,
        crawled_frontier, staging_appended, recipes_appended, recipe_models_read, recipe_rows, guided_search, guided_choice,
        sitemap_urls, json_fields, keyword_lists, curated_recipes, list_literals, menu_grid, sample_ten, p3_found, p4_found, p4_decoded, p7_found, p7_texts, p7_nodes, p7_objects,
    )
}
