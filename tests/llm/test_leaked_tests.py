from random import Random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.llm import leaked_tests as lt
from platewise.operators import lookup


def slow(a, b):
    best = longest = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            run[i][j] = run[i - 1][j - 1] + 1 if x == y else 0
            best, longest = max(best, h[i][j]), max(longest, run[i][j])
    return best, longest


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
@settings(deadline=None, max_examples=300)
def test_alignment(a, b):
    pair = lambda x, y: (np.array(x, np.int64), np.array(y, np.int64))
    assert lt.aligned([pair(a, b), pair(b, a), pair([], b), pair(a[:2], b * 2)]) == [slow(a, b), slow(b, a), (0, 0), slow(a[:2], b * 2)]


@given(st.lists(st.integers(0, 6), min_size=9, max_size=14), st.data())
@settings(deadline=None, max_examples=200)
def test_parts_hold_every_alignment_through_a_shared_gram(item, data):
    fill = st.lists(st.integers(0, 6) | st.integers(100, 10**6), max_size=60)
    doc = [x for part in data.draw(st.lists(fill, min_size=1, max_size=4)) for x in (*part, *item[1:10])]
    a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
    parts = lt.aligned([(a.view(np.int64), x.view(np.int64)) for x in lt.reaches(b, a)])
    assert max(p[0] for p in parts) == slow(item, doc)[0]
    assert lt.reaches(b[:3], a) == []


def corpus():
    r = Random(5)
    word = lambda: f"w{min(r.randrange(300), r.randrange(300))}"
    items = [" ".join(word() for _ in range(r.choice((5, 12, 40)))) for _ in range(30)]
    opening = " ".join(f"o{k}" for k in range(15))
    items += [f"{opening} {items[2]}", f"{opening} {items[3]}"]
    docs = []
    for k in range(200):
        text = [word() for _ in range(60)]
        item = r.choice(items).split()
        size = r.choice((8, 11, 12, 13, 30))
        at = r.randrange(max(1, len(item) - size + 1))
        text[r.randrange(60) : 0] = item[at : at + size]
        docs.append(" ".join(text))
    docs += [" ".join(edited(items[k].split(), 9, "replaced")) for k in range(20)]
    docs += [items[5].upper().replace(" ", ", "), "", None, " ", items[6] * 1, "x " * 50_000 + items[7], docs[0]]
    return docs, items + ["", None]


#: All rows of the test that follows, which must be the same either way.
SEEN = []


@pytest.mark.parametrize("listed", [True, False])
def test_runs_as_by_brute_force(spark, monkeypatch, listed):
    # A small filter lets most n-grams pass.
    monkeypatch.setattr(lt, "FILTER_BITS", 27 if listed else 7)
    for module in (lookup, lt):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 1 << 20 if listed else 0)
    monkeypatch.setattr(lookup, "LEAST_HOT", 2)
    docs, items = corpus()
    runs = lambda t: {tuple(w[i : i + 12]) for w in [lt.words(t)] for i in range(len(w) - 11)}
    of_items = [runs(t) for t in items]
    want = {(d, i) for d, text in enumerate(docs) for mine in [runs(text)] for i, x in enumerate(of_items) if mine & x}
    df = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = lt.leaked_passages(df(docs), df(items)).collect()
    SEEN.append(sorted(map(tuple, rows)))
    assert SEEN[0] == SEEN[-1]
    found = [(r.doc, r.item) for r in rows if r.run >= 12]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 50


def test_edited_copy_is_scored(spark):
    words = [f"w{k}" for k in range(60)]
    edited = words[:20] + ["new"] + words[22:]
    df = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    row = lt.leaked_passages(df(" ".join(["z"] * 40 + edited)), df(" ".join(words))).first()
    assert row.run == 38 and row.score == 2 * 58 - 2


def test_nothing(spark):
    df = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    some = df("a b c d e f g h i j k l m")
    for a, b in ((some.limit(0), some), (some, some.limit(0)), (df(None, ""), some), (some, df("short", None))):
        assert lt.leaked_passages(a, b).collect() == []


@pytest.mark.parametrize("bits", [7, 27])
def test_an_alignment_spans_what_it_scores_over(spark, monkeypatch, bits):
    monkeypatch.setattr(lt, "FILTER_BITS", bits)
    item = [f"t{k}" for k in range(200)]
    doc = item[:100] + [f"x{k}" for k in range(60)] + item[100:]
    corpus, tests = (spark.createDataFrame([(1, " ".join(w)), (2, None), (3, "short")], "id long, text string") for w in (doc, item))
    assert [tuple(r) for r in lt.leaked_passages(corpus, tests).collect()] == [(1, 1, 340, 100, 200)]


def edited(words, every, kind):
    out = []
    for k, word in enumerate(words, 1):
        new = "".join(reversed(word)) + "q"
        out += [word] if k % every else {"replaced": [new], "left out": [], "put in": [word, new]}[kind]
    return out


def test_recall_of_edited_copies(spark):
    """At least nine in ten copies with every 5th, 7th or 10th word replaced, left out or followed by another, inside other documents."""
    import oracle

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{oracle.DATA}/eval_items.parquet").select("item_id", "text").collect()]
    documents = [r.text for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").filter("text is not null").select("text").collect()]
    corpus, want = list(enumerate(documents)), {}
    for every in (5, 7, 10):
        for kind in ("replaced", "left out", "put in"):
            for item, text in items[::4]:
                around = documents[(item * 7) % len(documents)].split()
                want.setdefault((every, kind), set()).add((len(corpus), item))
                corpus.append((len(corpus), " ".join(around[:40] + edited(lt.words(text), every, kind) + around[40:])))
    df = lambda rows: spark.createDataFrame(rows, "id long, text string")
    found = lt.leaked_passages(df(corpus), df(items))
    half = {(r.doc, r.item) for r in found.filter(lt.score_share(found.score, found.length) >= 0.5).collect()}
    recall = {key: len(pairs & half) / len(pairs) for key, pairs in want.items()}
    print(recall)
    assert min(recall.values()) >= 0.9, recall
