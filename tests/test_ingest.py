import json

import pytest
from pyspark.sql import functions as F

from platewise.functions import jsonld
from platewise.operators import ingest
from platewise.plans import crawl
from platewise.sources import pages, sitemaps
from platewise.streaming import staging

NAMESPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def page(third="Dessert", record='{"a": 1}', title="T &amp; x"):
    script = f'<script data-testid="page-schema">{record}</script>' if record is not None else ""
    head = f"<title>{title}</title>" if title is not None else ""
    return f'<html><head>{head}</head><ul class="x"><li>no</li></ul><ul class="{pages.BREADCRUMB}"><li>Home</li><li><a>Recipes</a></li><li>{third}</li></ul>{script}</html>'


def test_page_facts():
    assert pages.page_facts(page()) == ("T & x", True, '{"a": 1}')
    assert pages.page_facts(page("Collection"))[1] is False
    assert pages.page_facts(page(record=None))[2] is None
    assert pages.page_facts(page(title=None))[0] == ""
    assert pages.page_facts(f'<ul class="{pages.BREADCRUMB}"><li>Home</li><li>Recipes</li></ul>')[1] is False
    for odd in (None, "", "<", "<ul", "text"):
        assert pages.page_facts(odd) == ("", False, None)


def test_sitemaps(spark):
    good = f"<urlset {NAMESPACE}><url><loc>http://test.com</loc></url><url><loc></loc></url><url><x/></url></urlset>"
    rows = [(1, good), (2, "<urlset><url>"), (3, f"<sitemapindex {NAMESPACE}><sitemap><loc>u</loc></sitemap></sitemapindex>"), (4, None), (5, f"<urlset {NAMESPACE}></urlset>")]
    df = spark.createDataFrame(rows, "id long, xml string")
    assert [tuple(r) for r in sitemaps.sitemap_rows(df, "xml", "id").collect()] == [(1, "http://test.com")]


def test_rows_without_an_order_and_repeated_rows(spark):
    rows = [(None, "u", "b", {"k": 1}), (None, "u", "a", None), (None, "v", "c", None), (2, "v", "later", None), (None, None, "n", None), (5, "w", "y", None), (5, "w", "x", None), (5, "w", "x", None)]
    incoming = spark.createDataFrame(rows, "id long, url string, `a name` string, extra map<string,int>")
    got = ingest.absent(incoming, spark.createDataFrame([], "url string"))
    assert got.columns == incoming.columns
    assert sorted(((r.url or "", r.id, r["a name"]) for r in got.collect()), key=str) == sorted([("u", None, "a"), ("v", 2, "later"), ("", None, "n"), ("w", 5, "x")], key=str)


def test_insert_if_absent(spark):
    incoming = spark.createDataFrame([(2, "u", "second"), (1, "u", "first"), (3, "v", "x"), (4, None, "n"), (5, None, "m")], "id long, url string, name string")
    existing = spark.createDataFrame([("v",), ("v",), (None,)], "url string")
    assert sorted(tuple(r) for r in ingest.absent(incoming, existing).collect()) == [(1, "u", "first")]
    assert sorted(tuple(r) for r in ingest.absent(incoming, existing.filter("url is not null")).collect()) == [(1, "u", "first"), (4, None, "n")]
    assert ingest.absent(incoming, existing.limit(0)).count() == 3
    assert ingest.absent(incoming.limit(0), existing).count() == 0


def test_finished(spark):
    frontier = spark.createDataFrame([(1, "u", False), (2, "u", None), (3, "v", None), (4, None, False)], ingest.FRONTIER)
    done = ingest.finished(frontier, spark.createDataFrame([("u",), ("u",), (None,)], "url string"))
    assert sorted((r.id, r.completed) for r in done.collect()) == [(1, True), (2, True), (3, None), (4, False)]
    assert [r.id for r in ingest.unfinished(frontier).collect()] == [1, 4]


RECIPE = {"name": "n", "description": "d", "image": {"url": "i"}, "recipeIngredient": ["a"], "recipeInstructions": [{"text": "s"}, {"name": "no"}, "plain"]}


def records(spark, *values):
    df = spark.createDataFrame([(k, v if isinstance(v, str | None) else json.dumps(v)) for k, v in enumerate(values)], "id long, data string")
    return {r.id: r for r in jsonld.recipe_records(df, "data", "id").collect()}


def test_records(spark):
    full = RECIPE | {"keywords": "one, main course", "recipeCuisine": "c", "nutrition": {"calories": "100 calories", "fatContent": "10 grams fat"}}
    got = records(spark, RECIPE, full, None, "{", "[]", *({k: v for k, v in RECIPE.items() if k != gone} for gone in RECIPE), RECIPE | {"recipeInstructions": {"text": "one"}})
    assert set(got) == {0, 1, 10}
    assert got[0].keywords == [] and got[0].cuisine is None and got[0].instructions == ["s"]
    assert got[1].keywords == ["one", "maincourse"] and got[1].calories == "100" and got[1].fat == "10" and got[1].sodium is None
    assert got[10].instructions == ["one"]


def test_curated(spark):
    staged = spark.createDataFrame([(1, "u", "n", json.dumps(RECIPE | {"nutrition": {"calories": "100 calories", "fatContent": "much"}}))], ingest.STAGING)
    row = ingest.curated(staged).first()
    assert (row.calories, row.fat, row.ingredients, row.keywords) == (100.0, None, '["a"]', "[]")


def test_models_and_rows(spark):
    rows = [(1, '["a", null]', "4", 100.0), (2, "('b', 'c\\x41',)", "Serves 8", None), (3, None, None, 1.5), (4, "x", " 7 ", None)]
    some = {"id": "id", "ingredients": "ingredients", "portions": "portions", "calories": "calories"}
    df = spark.createDataFrame(rows, "id long, ingredients string, portions string, calories double")
    whole = df.select(*(F.col(some[c]) if c in some else F.lit(None).cast("double" if c in jsonld.NUMBERS else "string").alias(c) for c in ingest.COLUMNS))
    models = ingest.models(whole)
    got = [(r.id, r.ingredients, r.portions, r.calories) for r in models.orderBy("id").collect()]
    assert got == [(1, ["a", None], 4, "100.0"), (2, ["b", "cA"], None, None), (3, None, None, "1.5"), (4, None, 7, None)]
    back = ingest.rows_of(models).orderBy("id").collect()
    assert [(r.ingredients, r.portions, r.calories) for r in back] == [('["a",null]', "4", 100.0), ('["b","cA"]', None, None), (None, None, 1.5), (None, "7", None)]
    assert ingest.models(whole.limit(0)).columns == ingest.COLUMNS


def test_replacing_a_table_survives_a_crash(spark, tmp_path):
    path = f"{tmp_path}/table"
    first = spark.createDataFrame([(1, "u", None)], ingest.FRONTIER)
    ingest.replace(first, path)
    ingest.replace(ingest.opened(spark, path, ingest.FRONTIER).withColumn("completed", F.lit(True)), path)
    assert [r.completed for r in ingest.opened(spark, path, ingest.FRONTIER).collect()] == [True]
    # As a run would leave it that ended between the two moves.
    (tmp_path / "table").rename(tmp_path / "table.old")
    assert [r.url for r in ingest.opened(spark, path, ingest.FRONTIER).collect()] == ["u"]


def test_crawl_twice(spark):
    frontier = spark.createDataFrame([(1, "s1", False), (2, "s2", True)], ingest.FRONTIER)
    fetched = spark.createDataFrame([(1, "s1", "a", page()), (2, "s1", "a", page(title="later")), (3, "s1", "b", page("Collection")), (4, "s2", "c", page())], "id long, sitemap_url string, url string, html string")
    staging_table = spark.createDataFrame([], ingest.STAGING)
    new, after = crawl.import_pages(frontier, fetched, staging_table)
    assert [(r.id, r.url, r.name) for r in new.collect()] == [(1, "a", "T & x")]
    assert {r.url: r.completed for r in after.collect()} == {"s1": True, "s2": True}
    again, _ = crawl.import_pages(frontier, fetched, new)
    assert again.count() == 0


def test_only_whole_sitemaps_are_finished(spark):
    frontier = spark.createDataFrame([(k, f"s{k}", False) for k in range(1, 6)] + [(6, "s6", True)], ingest.FRONTIER)
    rows = [(1, "s1", "a", page()), (2, "s2", "a", page()), (3, "s2", "lost", None), (4, "s3", "staged", None), (5, "s6", "c", page())]
    fetched = spark.createDataFrame(rows, "id long, sitemap_url string, url string, html string")
    staged = spark.createDataFrame([(1, "staged", "n", "{}")], ingest.STAGING)
    new, after = crawl.import_pages(frontier, fetched, staged)
    assert [r.url for r in new.collect()] == ["a"]
    assert {r.url for r in after.filter("completed").collect()} == {"s1", "s3", "s6"}
    listed = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "a"), ("s4", None), ("s5", "c"), ("s6", "d")], "sitemap_url string, url string")
    _, after = crawl.import_pages(frontier, fetched, staged, listed)
    # s1 lacks b; s5 lacks c, which was fetched for a completed sitemap and so isn't staged.
    assert {r.url for r in after.filter("completed").collect()} == {"s2", "s4", "s6"}


def test_import_sitemap(spark):
    xml = f"<urlset {NAMESPACE}><url><loc>s1</loc></url><url><loc>s9</loc></url><url><loc>s9</loc></url></urlset>"
    frontier = spark.createDataFrame([(1, "s1", None)], ingest.FRONTIER)
    new = crawl.import_sitemap(frontier, spark.createDataFrame([(1, xml)], "id long, xml string"))
    assert [tuple(r) for r in new.collect()] == [("s9", False)]


def test_stream(spark, tmp_path):
    folder, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    for _ in range(2):
        spark.createDataFrame([(1, "a", page()), (2, "b", page("Collection")), (3, "a", page())], staging.PAGES).write.mode("append").parquet(folder)
        staging.into_staging(staging.page_stream(spark, folder), table, mark).awaitTermination()
    assert [(r.id, r.url) for r in ingest.opened(spark, table, ingest.STAGING).collect()] == [(1, "a")]


@pytest.mark.parametrize("text", ["10 grams", None])
def test_without_unit(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(jsonld.without_unit(F.col("t"), " grams").alias("x")).first().x == (text and "10")
