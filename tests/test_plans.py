"""What the optimiser makes of the queries: pruned and filtered scans, and no shuffle that isn't needed."""

import re

import pytest

import oracle
from platewise import queries


def plan(spark, name):
    df = queries.QUERIES[name](spark, str(oracle.DATA))
    return df._jdf.queryExecution().executedPlan().toString()


def test_facets_prune_and_push_down(spark):
    text = plan(spark, "names_filtered")
    assert "EqualTo(cuisine,British)" in text
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"id", "name", "category", "cuisine", "ingredients"}
    assert "Exchange" not in text and "Python" not in text


def test_only_kept_rows_are_rendered(spark):
    text = plan(spark, "found_texts")
    assert "TakeOrderedAndProject(limit=3" in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["recipe_texts", "json_fields", "curated_recipes", "sitemap_urls", "name_search", "pages_by_ids"])
def test_one_pass_inside_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Exchange" not in text and "Python" not in text


# The adjacency rows of p7_found are joined by one shuffle; one more spreads the test table, which is a single partition.
@pytest.mark.parametrize(("name", "python", "shuffles"), [("p3_found", 2, 1), ("p7_found", 1, 2), ("p7_nodes", 1, 1), ("page_facts", 1, 0)])
def test_python_once_a_text(spark, name, python, shuffles):
    text = plan(spark, name)
    assert len(re.findall(r"ArrowEvalPython", text)) == python
    assert len(re.findall(r"Exchange hash", text)) == shuffles
