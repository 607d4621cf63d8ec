import json

from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.operators import nested_records as nr

RECIPE = {
    "@type": ["Recipe", "NewsArticle"],
    "recipeInstructions": [None, "a", {"itemListElement": [{"text": "b"}, {"name": "c"}, "d"], "name": "S"}, {"text": "e"}],
    "review": {"reviewBody": "r", "comment": [{"text": "x", "comment": {"text": "y"}}, None]},
}
WANT = {
    ("step", "1", ""), ("section", "2", ""), ("step", "2.0", "2"), ("step", "2.2", "2"), ("step", "3", ""),
    ("review", "0", ""), ("reply", "0.0", "0"), ("reply", "0.0.0", "0.0"),
}


def found(text):
    """The entities of one text, by walking its nodes."""
    return {row[:3] for tree in [nr._rows(text, nr.nodes)] for row in nr.recipe_entities(tree)}


def test_recipe_wherever_it_sits():
    for shape in (RECIPE, [RECIPE], {"@graph": [{"@type": "WebSite"}, RECIPE]}, {"props": {"page": {"recipe": RECIPE}}}, json.dumps(RECIPE), json.dumps(json.dumps([RECIPE]))):
        assert found(json.dumps(shape)) == WANT


def test_lone_values_and_nothing():
    assert found('{"@type": "Recipe", "recipeInstructions": "all in one"}') == {("step", "0", "")}
    assert found('{"@type": "Recipe", "recipeInstructions": {"itemListElement": {"text": "t"}}}') == {("section", "0", ""), ("step", "0.0", "0")}
    assert found('{"@type": "Recipe", "recipeInstructions": [[{"text": "t"}]]}') == {("step", "0.0", "")}
    for text in (None, "", "{", '{"@type": "Recipe"', "{}", "[]", "null", "3", '"text"', '{"@type": "Thing", "review": [{}]}', '{"@type": "Recipe"}', '{"a": NaN}'):
        assert found(text) == set()


def test_any_depth():
    deep = '{"a":' * 20_000 + json.dumps(RECIPE) + "}" * 20_000
    assert found(deep) == WANT
    assert found(deep[:-1]) == set()


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab\"\\é", max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("kl", max_size=2), x, max_size=3), max_leaves=12)


def rebuilt(rows):
    """The value that adjacency rows came from."""
    values, held = {}, {}
    for node, parent, label, place, kind, scalar in rows:
        values[node] = {} if kind == "object" else [] if kind == "array" else scalar if kind == "string" else json.loads(scalar or "null")
        held[node] = (parent, label, place)
    for node, (parent, label, _) in held.items():
        if parent is None:
            continue
        if isinstance(values[parent], dict):
            values[parent][label] = values[node]
        else:
            values[parent].append(values[node])
    return values[0]


@given(JSON)
@settings(deadline=None)
def test_adjacency_rows_keep_everything(value):
    text = json.dumps(value)
    assert rebuilt(nr.nodes(nr.parsed(text), spelt=False)) == value
    assert nr._deep(text) == nr.parsed(text)


def test_numbers_stay_as_written():
    long = "9" * 5000
    assert [r[5] for r in nr.nodes(nr.parsed(f"[1.10, 1e400, -0, {long}]"))][1:] == ["1.10", "1e400", "-0", long]
    assert found('{"@type": "Recipe", "review": 5, "recipeInstructions": [7, {"text": 1}]}') == {("step", "1", "")}


def test_tables(spark):
    rows = [(1, json.dumps(RECIPE)), (1, json.dumps(RECIPE)), (2, None), (3, "{broken"), (4, "")]
    df = spark.createDataFrame(rows, "id long, data string").withColumnRenamed("id", "kind")
    out = nr.recipe_tables(df, "data", "kind")
    assert out.count() == 2 * len(WANT)
    assert nr.recipe_tables(df.limit(0), "data", "kind").count() == 0
    nodes = nr.shredded(df, "data", "kind")
    assert nodes.columns == ["record", "node", "parent", "label", "ord", "kind", "scalar"]
    assert nodes.filter("scalar = 'Recipe' and ord = 0").count() == 2
    half = spark.createDataFrame([(1, '{"@type": "Recipe", "recipeInstructions": "\\ud83c", "\\ud83c": 1}')], "id long, data string")
    assert [r.text for r in nr.recipe_tables(half, "data", "id").collect()] == ["?"]
    assert nr.shredded(half, "data", "id").count() == 4
    steps = out.filter("text = 'b'").collect()
    assert [s.parent_node for s in steps] == ["2", "2"]


def test_objects_keep_every_field(spark):
    step = {"@type": "HowToStep", "text": "t", "url": "u", "image": [{"url": "i", "size": {"w": 3}}, "plain"]}
    review = {"text": "a", "reviewBody": "b", "author": {"name": "n"}, "reviewRating": {"ratingValue": 4.50}, "comment": {"text": "c", "up": None}}
    recipe = {"@type": "Recipe", "recipeInstructions": [{"name": "s", "itemListElement": [step, {"odd": 1}]}, "lone"], "review": [review]}
    df = spark.createDataFrame([(1, json.dumps(recipe)), (2, None), (3, "{")], "id long, data string")
    rows = nr.recipe_objects(df, "data", "id").collect()
    assert {(r.kind, r.owner, r.node, r.parent_node, r.label): r.fields for r in rows} == {
        ("section", "section", "0", "", None): {"name": "s"},
        ("step", "step", "0.0", "0", None): {"@type": "HowToStep", "text": "t", "url": "u"},
        ("part", "step", "0.0/image.0", "0.0", "image"): {"url": "i"},
        ("part", "step", "0.0/image.0/size", "0.0/image.0", "size"): {"w": "3"},
        ("part", "step", "0.0/image.1", "0.0", "image"): {"value": "plain"},
        ("part", "section", "0/itemListElement.1", "0", "itemListElement"): {"odd": "1"},
        ("step", "step", "1", "", None): {"text": "lone"},
        ("review", "review", "0", "", None): {"text": "a", "reviewBody": "b"},
        ("part", "review", "0/author", "0", "author"): {"name": "n"},
        ("part", "review", "0/reviewRating", "0", "reviewRating"): {"ratingValue": "4.5"},
        ("reply", "reply", "0.0", "0", None): {"text": "c", "up": None},
    }
    assert len(rows) == 11


KINDS = st.sampled_from(["@type", "recipeInstructions", "itemListElement", "review", "comment", "text", "name", "k"])
LIKE_RECIPES = st.recursive(st.none() | st.sampled_from(["Recipe", "x", 3, True]), lambda x: st.lists(x, max_size=3) | st.dictionaries(KINDS, x, max_size=5), max_leaves=25)


def test_tables_as_by_walking(spark):
    """Joins of adjacency rows find what a walk of each text finds."""
    texts = [json.dumps(LIKE) for LIKE in (RECIPE, [RECIPE], {"@graph": [{"@type": "WebSite"}, RECIPE]}, json.dumps(RECIPE), {"review": [RECIPE | {"@type": "Thing"}], "@type": [["Recipe"]]})]
    texts += ['{"a":' * 3000 + json.dumps(RECIPE) + "}" * 3000, '{"@type": "Recipe", "recipeInstructions": [[{"text": "t"}], {"text": null}, 7, {"itemListElement": null}]}', "{", "3", None]

    @given(LIKE_RECIPES)
    @settings(deadline=None, max_examples=400, database=None)
    def more(value):
        texts.append(json.dumps({"@type": "Recipe"} | value if isinstance(value, dict) and len(texts) % 3 else value))

    more()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, data string")
    got = [(r.id, r.kind, r.node, r.parent_node) for r in nr.recipe_tables(df, "data", "id").collect()]
    want = {(k, *row) for k, text in enumerate(texts) for row in found(text)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


@given(LIKE_RECIPES)
@settings(deadline=None)
def test_chains_are_adjacency_rows(value):
    everything = list(nr.chained(value, nr.CHAINS, frozenset(["text", "name", "k", "itemListElement", "comment"])))
    rows = {r[0]: r for r in nr.nodes(value)}
    assert all(rows[r[0]] == r[:6] for r in everything)
    below = {r[0] for r in everything if r[7] is not None}
    assert below == {n for n, r in rows.items() if r[2] in nr.CHAINS or r[1] in below and (r[2] is None or r[2] == nr.CHAINS[next(x for x in everything if x[0] == r[1])[7]])}
