import pytest
from pyspark.sql import functions as F

import oracle
from platewise.llm import subject_areas as sa
from platewise.operators import lookup


def tables(spark):
    read = lambda n: spark.read.parquet(f"{oracle.DATA}/{n}.parquet")
    documents = read("documents").select(F.col("doc_id").alias("id"), "text")
    labels = read("doc_labels").select(F.col("doc_id").alias("id"), "subject")
    return documents, labels, sorted(r.subject for r in read("subject_areas").collect())


@pytest.mark.parametrize("size", [1 << 26, 20_000])
def test_held_out_labels(spark, monkeypatch, size):
    """Recall and precision, also where weights are sent in blocks."""
    for module in (lookup, sa):
        monkeypatch.setattr(module, "BROADCAST_BYTES", size)
    monkeypatch.setattr(sa, "WEIGHT_BYTES", size)
    documents, labels, subjects = tables(spark)
    known = labels.filter("id % 5 <> 0")
    found = {tuple(r) for r in sa.main_subjects(documents, known, subjects).collect()}
    held = {tuple(r) for r in labels.filter("id % 5 = 0").collect()}
    ids = {i for i, _ in held}
    mine = {x for x in found if x[0] in ids}
    # A few labels are wrong, so neither is one.
    assert len(mine & held) >= 0.9 * len(held) and len(mine & held) >= 0.9 * len(mine)
    assert not {i for i, _ in found} & {r.id for r in known.collect()}


def test_texts_without_content_have_none(spark):
    documents, labels, subjects = tables(spark)
    empty = [(-1, None), (-2, ""), (-3, " \n"), (-4, "Page not found."), (-5, "Log in | Register | Basket (0)"), (-6, "x" * 500_000)]
    more = documents.unionByName(spark.createDataFrame(empty, "id long, text string"))
    found = sa.main_subjects(more, labels.unionByName(labels).unionByName(spark.createDataFrame([(1, "unknown"), (10**9, "law")], "id long, subject string")), subjects)
    ids = {r.id for r in found.collect()}
    assert ids and min(ids) > 0


def test_blocks_of_weights_change_nothing(spark, monkeypatch):
    documents, labels, subjects = tables(spark)
    whole = sorted(map(tuple, sa.main_subjects(documents, labels, subjects).collect()))
    monkeypatch.setattr(sa, "WEIGHT_BYTES", 15_000)
    monkeypatch.setattr(sa, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(sa, "FILTER_BITS", 8)
    assert sorted(map(tuple, sa.main_subjects(documents, labels, subjects).collect())) == whole and whole


def test_scripts_without_spaces(spark):
    assert sa.sentence_terms("plain words 12 of it") == ["plain", "words"]
    assert sa.sentence_terms("量子力学 and rice, 米") == ["量子", "子力", "力学", "and", "rice", "米"]
    law, rice = "裁判所は契約を無効とした。弁護士は控訴した", "米を炊いて味噌汁を作る。野菜を炒める"
    rows = [(k, (law if k % 2 else rice) + "。" * (k % 3)) for k in range(120)]
    documents = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame([(k, "law" if k % 2 else "food") for k in range(60)], "id long, subject string")
    found = {r.id: r.subject for r in sa.main_subjects(documents, labels, ["food", "law"]).collect()}
    assert found == {k: "law" if k % 2 else "food" for k in range(60, 120)}


def test_empty_tables(spark):
    documents, labels, subjects = tables(spark)
    for d, x in ((documents.limit(0), labels), (documents, labels.limit(0)), (documents.limit(0), labels.limit(0))):
        out = sa.main_subjects(d, x, subjects)
        assert out.columns == ["id", "subject"] and out.collect() == []


def test_features_are_passed_on_in_parts(spark, monkeypatch):
    import pyarrow as pa

    texts = ["one two three four five. six seven eight nine", "", "alpha beta gamma delta\nalpha alpha alpha alpha", "short one"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.nulls(20, pa.list_(pa.int32())), pa.array(texts)], ["id", "label", "text"])
    whole = [r for b in sa.features([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    monkeypatch.setattr(sa, "HELD", 3)
    parts = list(sa.features([batch, batch.slice(0, 0)]))
    assert len(parts) > 5 and [(r["id"], sorted(zip(r["terms"], r["sentences"], r["lengths"]))) for b in parts for r in b.to_pylist()] == [
        (r["id"], sorted(zip(r["terms"], r["sentences"], r["lengths"]))) for r in whole
    ]
    assert [len(r["terms"]) for r in whole[:4]] == [9, 0, 5, 0] and whole[2]["sentences"] == [0, 0, 0, 0, 1]
