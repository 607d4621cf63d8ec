import time

from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.operators import packed_values
from platewise.operators.packed_values import split_packed, unpacked


def test_delimiters_and_quotes():
    assert split_packed("dinner, condiment") == ["dinner", "condiment"]
    assert split_packed('a > "b, c"|‘d;e’ • “f/g”') == ["a", "b, c", "d;e", "f/g"]
    assert split_packed("salt'n'sour; shepherd's lunch\t'half|half'") == ["salt'n'sour", "shepherd's lunch", "half|half"]
    assert split_packed("'cook's choice', x") == ["cook's choice", "x"]
    assert split_packed('["vegetarian", "cook\'s choice"]') == ["vegetarian", "cook's choice"]
    assert split_packed("a，b\n c \xa0") == ["a", "b", "c"]
    assert split_packed("low-fat, 30-minute meal") == ["low-fat", "30-minute meal"]


def test_odd_quotes():
    assert split_packed('unclosed "a, b') == ["unclosed", "a", "b"]
    assert split_packed("“outer “inner, x” still”, y") == ["outer “inner, x” still", "y"]
    assert split_packed(r'"a\"b", c') == ['a"b', "c"]
    assert split_packed('"", " ", a') == ["a"]


def test_nothing_to_split():
    assert split_packed(None) == split_packed("") == split_packed(" \t\xa0") == split_packed(",;|") == []


@given(st.lists(st.text("abz ,;|'é-", max_size=8).map(str.strip).filter(bool), max_size=6))
@settings(deadline=None)
def test_quoted_values_come_back(values):
    assert split_packed(" | ".join(f'"{v}"' for v in values)) == values


def test_rows(spark):
    rows = [(1, "a,b"), (1, "a,b"), (2, "x"), (3, None), (4, ""), (None, "p;q"), (5, "v," * 20_000)]
    df = spark.createDataFrame(rows, "id long, packed string")
    out = unpacked(df, "packed", least=2)
    got = sorted((r.id or 0, r.pos, r.item) for r in out.filter("id is null or id < 5").collect())
    assert got == [(0, 1, "p"), (0, 2, "q"), (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert out.filter("id = 5").count() == 20_000
    assert unpacked(df.limit(0), "packed").count() == 0
    clash = spark.createDataFrame([("x", "y", "a|b", 1)], "Item string, pos string, values string, row int")
    assert [tuple(r) for r in unpacked(clash, "values").collect()] == [(1, 1, "a"), (1, 2, "b")]
    assert unpacked(df.withColumnRenamed("id", "a.b c"), "packed").columns == ["a.b c", "pos", "item"]


def test_marks_that_never_close_take_linear_time():
    for mark in ("“", '"', "'", "„", '"\\', "“x", "‘a’b"):
        text = mark * 200_000
        began = time.perf_counter()
        split_packed(text)
        assert time.perf_counter() - began < 5, mark


@given(st.text("ab \\'\"“”„‘’«», ;", max_size=14))
@settings(deadline=None, max_examples=500)
def test_closing_marks_as_by_scanning(text):
    def scanned(start, opener):
        depth, i = 1, start
        while i < len(text):
            c = text[i]
            if c == "\\" and i + 1 < len(text):
                i += 2
                continue
            inside = c in "'’" and 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum()
            if c in packed_values.CLOSERS[opener] and not inside:
                depth -= 1
                if depth == 0:
                    return i
            elif c == opener and c not in packed_values.CLOSERS[opener]:
                depth += 1
            i += 1

    for opener in packed_values.CLOSERS:
        found = packed_values._closings(text, opener)
        assert {i: found.get(i) for i, c in enumerate(text) if c == opener} == {i: scanned(i + 1, opener) for i, c in enumerate(text) if c == opener}
