from platewise.functions.literals import list_elements, literal
from platewise.functions import render
from platewise.operators import predicates, search
from pyspark.sql import functions as F

SCHEMA = "id long, name string, portions string, description string, ingredients string, instructions string, cuisine string, category string"


def recipes(spark, *rows):
    return spark.createDataFrame([r + (None,) * (8 - len(r)) for r in rows], SCHEMA)


def test_like_arguments(spark):
    df = spark.createDataFrame([("a%b",), ("aXb",), ("a\\b",), ("CRÈME",), (None,), ("",)], "t string")
    hits = lambda arg: [r.t for r in df.filter(predicates.folded_like(F.col("t"), arg)).collect()]
    assert hits("a%b") == ["a%b", "aXb", "a\\b"]
    assert hits("a_b") == ["a%b", "aXb", "a\\b"]
    assert hits("\\") == ["a\\b"]
    assert hits("crème") == ["CRÈME"]
    assert len(hits("")) == 5


def test_facets_and_terms(spark):
    df = recipes(spark, (1, "A", None, None, "['salt', 'sea salt']", None, "X", "Dinner"), (2, "B", None, None, "['salt']", None, "x", "dinner"), (3, "C", None, None, None, None, None, None))
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(search.names(df)) == [1, 2, 3]
    assert ids(search.names(df, cuisine="X")) == [1]
    assert ids(search.names(df, category="")) == [1, 2]
    assert ids(search.names(df, ingredient="SALT")) == [1]
    assert ids(search.names_with(df, [" SALT ", ""])) == [1, 2]
    assert ids(search.names_with(df, [])) == ids(search.names_with(df, [" "])) == []
    assert len(predicates.facets("a", "b", "c")) == 3


def test_categories(spark):
    df = recipes(spark, (1, "A") + (None,) * 5 + ("dessert, Main",), (2, "B") + (None,) * 5 + ("breakfast",), (3, "C"), (4, "D") + (None,) * 5 + ("main,\t",))
    assert [r.category for r in search.categories(df).collect()] == ["", "breakfast", "dessert", "main"]
    assert search.categories(df.limit(0)).collect() == []


def test_text(spark):
    df = recipes(spark, (1, "test recipe", "2", "d", "['ingredient1', 'ingredient2']", "['step1', 'step2']"), (2, None))
    texts = {r.id: r.text for r in search.texts(df).collect()}
    assert texts[1] == "<b>test recipe</b>\n\nPortions: 2\n<i>d</i>\n\n<b>Ingredients:</b>\ningredient1\ningredient2\n\n<b>Instructions:</b>\n1. step1\n2. step2"
    assert texts[2] == "<b>None</b>\n\nPortions: None\n<i>None</i>\n\n<b>Ingredients:</b>\n\n\n<b>Instructions:</b>\n"
    assert search.text_by_id(df, None).count() == search.text_by_id(df, 9).count() == 0
    assert search.summary_by_id(df, 1, category="main COURSE").first().text.startswith("Category: Main course\n<b>test")
    assert search.summary_by_id(df, 1).first().text == texts[1]


def test_literals(spark):
    cases = ["['a']", '["a", "b\'c"]', "['it\\'s']", "[]", "('a', 'b')", "['a', None]", "['a',]", "garbage", "", None, "['\\xe9']", "[1, 'a']", "[" * 3000]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    strict = {r.i: r.v for r in df.select("i", list_elements(F.col("t"), strict=True).alias("v")).collect()}
    assert [strict[i] for i in range(len(cases))] == [["a"], ["a", "b'c"], ["it's"], [], ["a", "b"], ["a", None], ["a"], None, None, None, ["é"], ["1", "a"], None]
    assert literal("{'a': 1}") is None


def test_limits_and_samples(spark):
    df = spark.range(15).withColumn("name", F.lit("n"))
    assert len({r.id for r in search.sampled(df).collect()}) == 10
    assert search.sampled(spark.range(3)).count() == 3
    lines = render.grid(spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "v string"), "v", 2).orderBy("line").collect()
    assert [r.cells for r in lines] == [["a", "b"], ["c"]]


def test_arguments():
    assert predicates.asked_terms("onion, garlic") == ["onion", " garlic"]
    assert predicates.asked_id("7") == 7 and predicates.asked_id("x") is predicates.asked_id(None) is None


def test_texts_of_python_literals(spark):
    rows = [(1, "('a', 'b')", "['x',]"), (2, r"['\x41', None]", '["y"]'), (3, "no list", None)]
    df = spark.createDataFrame(rows, "id long, ingredients string, instructions string").selectExpr("*", "'n' name", "'2' portions", "'d' description")
    texts = {r.id: r.text.partition("<b>Ingredients:</b>\n")[2] for r in search.texts(df).collect()}
    assert texts == {k: f"{a}\n\n<b>Instructions:</b>\n{b}" for k, a, b in ((1, "a\nb", "1. x"), (2, "A\nNone", "1. y"), (3, "", ""))}
    assert search.text_by_id(df, 1).first().text.endswith("1. x")
