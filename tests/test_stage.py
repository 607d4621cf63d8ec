import os
import time
from types import SimpleNamespace

import pytest

from platewise import queries, stage


def test_stages_are_written_and_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage, "shared_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(stage, "_written", [])
    df = stage.written(spark.range(5).withColumnRenamed("id", "a b"), "five")
    assert df.count() == 5 and df.columns == ["a b"] and len(os.listdir(tmp_path)) == 1
    stage.clear()
    assert os.listdir(tmp_path) == [] and stage._written == []


def left(folder, count=0):
    """What is left in the folder, soon after references to the stages have gone: Spark's own events may still hold some."""
    for _ in range(50):
        stage.sweep()
        if len(os.listdir(folder)) <= count:
            break
        time.sleep(0.2)
    return [x.split("-")[0] for x in os.listdir(folder)]


def test_stages_stay_as_long_as_they_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage, "shared_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(stage, "_written", [])
    first = stage.written(spark.range(5), "first")
    derived = stage.written(first.filter("id > 1"), "second").groupBy().count()
    del first
    assert left(tmp_path, 1) == ["second"]
    assert derived.first()[0] == 3
    del derived
    assert left(tmp_path) == [] and stage._written == []


def test_nothing_is_left_of_a_query_whose_result_is_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage, "shared_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(stage, "_written", [])
    for name in ("p4_found", "staging_appended", "recipes_appended"):
        result = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        stage.sweep()
        assert result.count() > 0 and os.listdir(tmp_path)
        del result
        assert left(tmp_path) == [], name


def session(folder, local, chosen=None):
    option = SimpleNamespace(isDefined=lambda: chosen is not None, get=lambda: chosen)
    java = SimpleNamespace(sc=lambda: SimpleNamespace(isLocal=lambda: local, getCheckpointDir=lambda: option))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(applicationId="app", _jsc=java))


def test_folder(monkeypatch):
    monkeypatch.setattr(stage, "_own", {})
    assert stage.shared_folder(session("file:///shared/", False)) == "file:///shared"
    assert stage.shared_folder(session(None, False, "hdfs://a/b/")) == "hdfs://a/b"
    with pytest.raises(RuntimeError):
        stage.shared_folder(session(None, False))
    mine = stage.shared_folder(session(None, True))
    assert mine.startswith("file://") and stage.shared_folder(session(None, True)) == mine
    os.rmdir(mine.removeprefix("file://"))
