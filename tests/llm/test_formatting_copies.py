import re
from collections import Counter

from pyspark.sql import functions as F

from platewise.llm import formatting_copies as fc
from platewise.operators import lookup


def names(spark, *rows, pieces=fc.title_pieces):
    df = spark.createDataFrame(rows, "id long, t string").withColumn("tbl", F.lit("x"))
    return {(r.id, r.copies) for r in fc.formatting_copies(df.select("tbl", "id", pieces(F.col("t")).alias("pieces"))).collect()}


def test_names(spark):
    rows = [
        (1, "My Pâté - plus [a; B b]"), (2, "my pâté plus[b.b ;A]"), (3, "MY PÂTÉ PLUS"), (4, "my pate plus [a; bb]"), (5, "My Pâté plus [a;a;bb]"),
        (6, "x [y] z"), (7, "X Y [z]"), (8, "xyz"), (9, None), (10, ""), (11, " -! []"), (12, "a" * 100_000), (13, "A" * 100_000 + "[]"), (1, "My Pâté - plus [a; B b]"),
    ]
    assert names(spark, *rows) == {(1, 3), (3, 1), (4, 1), (5, 1), (6, 2), (7, 1), (10, 2), (12, 2)}


def test_addresses(spark):
    rows = [
        (1, "https://a-b.example/c?x=1&y=2"), (2, " <HTTPS://A_B.EXAMPLE//c/?y=2;x=1&&#"), (3, "https://ab.example/c?x=1"), (4, "https://ab.example/c?x=1&x=1"),
        (5, "https://ab.example/c?"), (6, "https://ab.example/c"), (7, "https://ab.example/c?x=1?y=2"), (8, None),
    ]
    assert names(spark, *rows, pieces=fc.address_pieces) == {(1, 2), (3, 1), (4, 1), (5, 2), (7, 1)}


def test_empty(spark):
    assert names(spark, (1, None)) == set()


def test_as_by_brute_force_with_hot_pieces(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "LEAST_HOT", 3)
    texts = [f"{'T' if k % 2 else 't'}-{k % 7} [{';'.join(sorted({str(k % 3), 'n' + '!' * (k % 4)}, reverse=k % 5 == 0))}]" for k in range(200)]

    def key(text):
        title, notes = re.fullmatch(r"(.*)\[(.*)\]", text).groups()
        return fc.canonical(title), tuple(sorted(map(fc.canonical, notes.split(";"))))

    groups = Counter(map(key, texts))
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(key(t), k)
    assert names(spark, *enumerate(texts)) == {(first[g], n) for g, n in groups.items()}
