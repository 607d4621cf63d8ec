from fractions import Fraction
from itertools import combinations
from random import Random
from unittest import mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewise.llm import codes
from platewise.llm import similar_sets as ss
from platewise.operators import lookup

LISTS = st.lists(st.lists(st.integers(0, 12), max_size=8).map(lambda x: sorted(set(x))), max_size=6)


@given(LISTS, st.integers(1, 6), st.integers(0, 5), st.sampled_from([0.0, 0.01, 0.3, 5.0]))
@settings(deadline=None, max_examples=600)
def test_merging_counts_occurrences(lists, need, low, cost):
    with mock.patch.object(ss, "MERGE_COST", cost):
        got = list(ss.at_least(lists, need, low))
    want = {}
    for x in lists:
        for v in x:
            if v >= low:
                want[v] = want.get(v, 0) + 1
    assert got == sorted((v, c) for v, c in want.items() if c >= need)


def similar(a, b, t=Fraction(4, 5)):
    return bool(a) and bool(b) and Fraction(len(a & b), len(a | b)) >= t


def random_sets(seed, count=150):
    r = Random(seed)
    base = [{f"t{min(r.randrange(60), r.randrange(60))}" for _ in range(r.choice((1, 2, 5, 6, 9, 12)))} for _ in range(count // 3)]
    near = []
    for s in base * 2:
        s = set(s)
        if r.random() < 0.7:
            s.discard(r.choice(sorted(s)))
        if r.random() < 0.5:
            s.add(f"t{r.randrange(60)}")
        near.append(s)
    return base + near


@pytest.mark.parametrize(("block", "threshold"), [(2, Fraction(4, 5)), (4096, Fraction(4, 5)), (3, Fraction(1, 2)), (4096, Fraction(1)), (2, Fraction(1))])
def test_pairs_as_by_brute_force(spark, monkeypatch, block, threshold):
    if block < 10:
        for module, name in ((lookup, "BROADCAST_BYTES"), (ss, "BROADCAST_BYTES"), (codes, "HELD_BYTES")):
            monkeypatch.setattr(module, name, 0)
        monkeypatch.setattr(lookup, "LEAST_HOT", 10)
        monkeypatch.setattr(ss, "CHUNK", 2)
    monkeypatch.setattr(ss.class_links, "__defaults__", (Fraction(4, 5), block))
    sets = random_sets(block)
    rows = [("f", k, sorted(s)) for k, s in enumerate(sets) if s]
    got = [(r.id_a, r.id_b) for r in ss.similar_pairs(spark.createDataFrame(rows, "field string, id long, terms array<string>"), threshold=threshold).collect()]
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if similar(sets[a], sets[b], threshold)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_between_two_tables(spark):
    sets = random_sets(7)
    schema = "field string, id long, terms array<string>"
    left = spark.createDataFrame([("f", k, sorted(s)) for k, s in enumerate(sets[::2]) if s], schema)
    right = spark.createDataFrame([("f", k, sorted(s)) for k, s in enumerate(sets[1::2]) if s], schema)
    got = [(r.id_a, r.id_b) for r in ss.similar_pairs(left, right).collect()]
    want = {(a, b) for a, s in enumerate(sets[::2]) for b, t in enumerate(sets[1::2]) if similar(s, t)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_odd_records(spark):
    big = [f"w{k}" for k in range(3000)]
    rows = [(1, ["A ", "b\n c", None, " "], None), (2, ["a", "B C", "a"], None), (2, ["a", "B C", "a"], None), (3, None, []), (4, [], ["x"]), (None, ["q"], None), (None, ["q"], None), (5, big, None), (6, [*big, "more"], None)]
    df = spark.createDataFrame(rows, "id long, x array<string>, y array<string>").withColumn("terms", F.lit("clash"))
    records = ss.set_records(df, "id", {"x": F.col("x"), "y": F.col("y")})
    assert sorted(tuple(r) for r in ss.similar_pairs(records).collect()) == [("x", 1, 2), ("x", 5, 6)]
    assert ss.similar_pairs(records.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [2, 1000])
def test_classes_of_many_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(ss, "CHUNK", chunk)
    sets = [["a", "b", "c", "d", "e"]] * 9 + [["A", "b ", "c", "d"]] * 7 + [["x"]] * 3 + [["lonely"], ["a", "z"]]
    records = spark.createDataFrame([("f", k, s) for k, s in enumerate(sets)], "field string, id long, terms array<string>")
    found = ss.similar_classes(records)
    # Links are between the sets, however many copies they have.
    assert found.links.count() == 4 and found.members.count() == 19
    got = sorted((r.id_a, r.id_b) for r in ss.similar_pairs(records).collect())
    assert got == sorted([*combinations(range(16), 2), *combinations(range(16, 19), 2)])


def test_the_same_term_in_two_fields_and_two_spellings(spark):
    rows = [("f", 1, ["a", "A", " a", "b"]), ("g", 2, ["a", "b"]), ("f", 3, ["B", "a"]), ("g", 4, ["b\t", "a", None, ""]), ("f", 5, ["only", "once"]), ("f", 6, ["", None])]
    got = sorted(tuple(r) for r in ss.similar_pairs(spark.createDataFrame(rows, "field string, id long, terms array<string>")).collect())
    assert got == [("f", 1, 3), ("g", 2, 4)]
