"""No shuffle and no Python that isn't needed."""

import re
import sys

import pytest

import oracle
from platewise import stage
from platewise.llm import queries
from platewise.operators import lookup


def plan(spark, name):
    df = queries.QUERIES[name](spark, str(oracle.DATA))
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_ids_are_one_pass(spark):
    text = plan(spark, "p8_ids")
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_cartesian_products(spark, monkeypatch, name):
    """Neither in the plan of the result nor in that of any stage on the way, with and without small tables to broadcast."""
    texts = []

    def recorded(df, *args):
        texts.append(df._jdf.queryExecution().executedPlan().toString())
        return stage.written(df, *args)

    modules = [m for n, m in sys.modules.items() if n.startswith("platewise.") and getattr(m, "written", None) is stage.written and m is not stage]
    assert len(modules) > 5
    for module in modules:
        monkeypatch.setattr(module, "written", recorded)
    for size in (lookup.BROADCAST_BYTES, 0):
        for module in [m for n, m in sys.modules.items() if n.startswith("platewise.") and hasattr(m, "BROADCAST_BYTES")]:
            monkeypatch.setattr(module, "BROADCAST_BYTES", size)
        texts.append(plan(spark, name))
    for text in texts:
        assert "CartesianProduct" not in text and "NestedLoop" not in text
