"""Passages of evaluation texts in a corpus, by rare n-gram seeds and Smith-Waterman alignment.

An n-gram is eight words in a row, or nine without the middle one. Both have the same codes, so a text and its copy still
share n-grams where a word was replaced, left out or put in, down to one in every five words. One pass over the corpus
finds the n-grams of the evaluation texts, by a bit filter of bounded size; its false hits join nothing later on. The hits
give each n-gram's frequency in the corpus, and seeds are chosen by that: the rarest n-gram of each window of an
evaluation text, and all that few documents have. A document that shares a whole window with an item holds the window's
seed, whatever that is, so joining documents to items on seeds loses no such pair, and common n-grams never become join keys
unless a window has no rarer one. Each pair is then aligned around all its shared n-grams, as far as an alignment can reach.
Evaluation texts of bounded bytes are sent to the tasks, which join and align in a second pass over the corpus; others are
joined by shuffle. Both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platewise.llm.codes import bit_filter, filter_bits, filter_of, passing, starts
from platewise.operators.lookup import BROADCAST_BYTES, hinted, looked_up, row_bytes
from platewise.stage import written
from platewise.tables import spread

#: Words of an n-gram, and how many of them come before the word that a gapped one leaves out.
GRAM, HOLE = 8, 4
#: N-grams are sought by a bit filter of some hundred bits for each n-gram of the evaluation texts, and at most of 2 to this power (16 MB).
FILTER_BITS = 27
#: An n-gram is a rare seed if at most one in so many documents, or at most so many documents, have it.
RARE_SHARE, RARE = 1000, 20
#: Rare n-grams that a document and an item must share, unless they share the rarest of a whole window.
LEAST_RARE = 2
#: Alignment scores.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Pairs of a document and an item that a task holds.
ROWS = 500
#: Words of the texts whose n-grams are sought at a time.
WORDS = 1 << 18
#: Cells of the rows that are aligned at a time.
CELLS = 1 << 15

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of a text, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


class _Codes(dict):
    """Codes of the words seen lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def codes(text: str | None) -> np.ndarray:
    """A 64-bit code for each word of a text."""
    found = words(text)
    return np.fromiter(map(_CODES.__getitem__, found), np.uint64, len(found))


def grams(word_codes: np.ndarray, gapped: bool = False) -> np.ndarray:
    """A 64-bit code for the n-gram that starts at each word."""
    offsets = [k + (gapped and k >= HOLE) for k in range(GRAM)]
    if len(word_codes) <= offsets[-1]:
        return np.empty(0, np.uint64)
    out = np.zeros(len(word_codes) - offsets[-1], np.uint64)
    for k in offsets:
        out = out * _BASE + word_codes[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


def _all_grams(word_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of both kinds and where they start."""
    plain, gapped = grams(word_codes), grams(word_codes, gapped=True)
    return np.concatenate([plain, gapped]), np.concatenate([np.arange(len(plain)), np.arange(len(gapped))])


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Smith-Waterman: for each pair of word sequences the best local alignment score, and the longest common run.

    Pairs of like lengths are aligned together, a row of each at a time.
    """
    found = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])), reverse=True)
    at = 0
    while at < len(order):
        width = len(pairs[order[at]][1])
        some = order[at : at + max(1, CELLS // (width + 1))]
        at += len(some)
        tall = max(len(pairs[k][0]) for k in some)
        # Filled up with codes that equal no word's and not each other.
        a, b = np.full((len(some), tall), -1, np.int64), np.full((len(some), width), -2, np.int64)
        for row, k in enumerate(some):
            for whole, one in zip((a, b), pairs[k]):
                whole[row, : len(one)] = one
        steps = np.arange(1, width + 1, dtype=np.int32) * np.int32(-GAP)
        score, run = np.zeros((len(some), width + 1), np.int32), np.zeros((len(some), width + 1), np.int32)
        best, longest = np.zeros(len(some), np.int32), np.zeros(len(some), np.int32)
        for i in range(tall if width else 0):
            same = b == a[:, i : i + 1]
            run[:, 1:] = (run[:, :-1] + 1) * same
            straight = np.maximum(score[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), score[:, 1:] + np.int32(GAP))
            np.maximum(straight, 0, out=straight)
            # Gaps along the row: the best earlier cell less its distance.
            straight += steps
            np.maximum.accumulate(straight, axis=1, out=straight)
            score[:, 1:] = straight - steps
            np.maximum(best, score.max(axis=1), out=best)
            np.maximum(longest, run.max(axis=1), out=longest)
        for row, k in enumerate(some):
            found[k] = int(best[row]), int(longest[row])
    return found


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64), kind))


def _item_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [codes(t) for t in batch.column("text").to_pylist()]
        columns = [_lists([f(x).view(np.int64) for x in own], pa.int64()) for f in (lambda x: x, grams, lambda x: grams(x, gapped=True))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["item", "words", "grams", "gapped"])


def _found(texts: list[str], wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """For some texts after the other the place of the first, the words of each, and the distinct (text, n-gram) that are ``wanted``, sorted by text."""
    first = 0
    while first < len(texts):
        # Texts up to a number of words as one sequence, of which n-grams across two texts are left out.
        own, size = [], 0
        for text in texts[first:]:
            own.append(codes(text))
            size += len(own[-1])
            if size >= WORDS:
                break
        lengths = [len(x) for x in own]
        ends, of, sequence = np.cumsum(lengths), np.repeat(np.arange(len(own)), lengths), np.concatenate(own)
        docs, found = [], []
        for gapped in (False, True):
            all_ = grams(sequence, gapped)
            at = np.flatnonzero(wanted(all_))
            at = at[at + GRAM + gapped <= ends[of[at]]]
            docs.append(of[at])
            found.append(all_[at])
        docs, found = np.concatenate(docs), np.concatenate(found)
        order = np.lexsort((found, docs))
        docs, found = docs[order], found[order]
        new = np.r_[True, (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])][: len(docs)]
        yield first, own, docs[new], found[new]
        first += len(own)


def _held(passed, bits: int):
    """(gram, held): how many of a batch's documents have each n-gram that passes the filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = passed.value
        for batch in batches:
            for _, _, _, found in _found(batch.column("text").to_pylist(), lambda x: passing(x, filter_, bits)):
                distinct, held = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(held.astype(np.int64))], ["gram", "held"])

    return run


def _hits(passed, bits: int):
    """Documents to their distinct n-grams that pass the filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = passed.value
        for batch in batches:
            for first, own, docs, found in _found(batch.column("text").to_pylist(), lambda x: passing(x, filter_, bits)):
                held_by = np.unique(docs)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(docs, held_by), len(docs)], pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(own)).take(pa.array(held_by)), lists], ["doc", "grams"])

    return run


def reaches(doc: np.ndarray, item: np.ndarray) -> list[np.ndarray]:
    """The parts of a document that alignments with an item through shared n-grams can reach.

    An alignment of ``m`` words of the item scores ``2 m`` at most and loses 1 for each other word of the document, so none
    spans more than ``3 m`` of these; what is further from a shared n-gram isn't part of one through it. A document no longer than
    that is taken whole.
    """
    far = (MATCH + 1) * len(item)
    if len(doc) <= far:
        return [doc] if len(doc) >= GRAM else []
    own, places = _all_grams(doc)
    hits = np.unique(places[np.isin(own, _all_grams(item)[0])])
    if not len(hits):
        return []
    return [doc[max(0, part[0] - far) : part[-1] + GRAM + 1 + far] for part in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * far + GRAM) + 1)]


def _scored(docs: pa.Array, items: pa.Array, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(doc, item, score, run, length) of pairs of the words of a document and of an item."""
    parts, of = [], []
    for k, (doc, item) in enumerate(pairs):
        for part in reaches(doc, item):
            parts.append((item.view(np.int64), part.view(np.int64)))
            of.append(k)
    scored = np.zeros((len(pairs), 2), np.int32)
    for k, both in zip(of, aligned(parts)):
        scored[k] = np.maximum(scored[k], both)
    columns = [docs, items, pa.array(scored[:, 0]), pa.array(scored[:, 1]), pa.array([len(item) for _, item in pairs], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["doc", "item", "score", "run", "length"])


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        items = [x.values.to_numpy().view(np.uint64) for x in batch.column("words")]
        yield _scored(batch.column("doc"), batch.column("item"), [(codes(t), item) for t, item in zip(batch.column("text").to_pylist(), items)])


class Seeds(NamedTuple):
    """Seeds and evaluation texts that tasks hold: the ascending n-grams, of each the place of its first (item, sure) and the end, and the texts' ids and words."""

    grams: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    sure: np.ndarray
    ids: pa.Array
    words: list[np.ndarray]


def _seeds_of(seeds: DataFrame, items: DataFrame) -> Seeds:
    texts = items.select("item", "words").toArrow().combine_chunks()
    ids = texts.column("item").combine_chunks()
    ends, words_ = starts(texts.column("words").combine_chunks())
    # An id that several texts have stands for each of them.
    places = pa.table({"item": ids, "place": pa.array(range(len(ids)), pa.int64())})
    table = seeds.select("item", "gram", "sure").toArrow().join(places, "item", join_type="inner")
    codes_ = table.column("gram").to_numpy().view(np.uint64)
    order = codes_.argsort()
    distinct, first = np.unique(codes_[order], return_index=True)
    words_ = words_.to_numpy().view(np.uint64)
    return Seeds(distinct, np.r_[first, len(order)], table.column("place").to_numpy()[order], table.column("sure").to_numpy()[order], ids, [words_[a:b] for a, b in zip(ends[:-1], ends[1:])])


def _align_in_place(held, bits: int):
    """Documents aligned with the items whose seeds they have, as :func:`_align` does, in one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = held.value
        filter_ = filter_of(seeds.grams, bits)
        for batch in batches if len(seeds.grams) else ():
            for first, own, docs, found in _found(batch.column("text").to_pylist(), lambda x: passing(x, filter_, bits)):
                at = np.minimum(np.searchsorted(seeds.grams, found), len(seeds.grams) - 1)
                real = seeds.grams[at] == found
                at, docs = at[real], docs[real]
                many = seeds.starts[at + 1] - seeds.starts[at]
                each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seeds.starts[at], many)
                pairs, of = np.unique(np.repeat(docs, many) * len(seeds.ids) + seeds.item[each], return_inverse=True)
                enough = (np.bincount(of, seeds.sure[each], len(pairs)) > 0) | (np.bincount(of, minlength=len(pairs)) >= LEAST_RARE)
                docs, items = np.divmod(pairs[enough], max(1, len(seeds.ids)))
                for k in range(0, len(docs), ROWS):
                    some, with_ = docs[k : k + ROWS], items[k : k + ROWS]
                    yield _scored(batch.column("id").take(pa.array(first + some)), seeds.ids.take(pa.array(with_)), [(own[d], seeds.words[i]) for d, i in zip(some, with_)])

    return run


def _seeds(items: DataFrame, counts: DataFrame, documents: int, window: int) -> DataFrame:
    """(item, gram, held, sure) of the n-grams by which items are joined to documents; ``sure`` if it is the rarest of a window that a document may hold."""
    each = lambda column, span: items.select("item", F.size("words").alias("length"), F.posexplode(column).alias("at", "gram"), F.lit(span).alias("span"))
    places = each("grams", GRAM).unionByName(each("gapped", GRAM + 1)).join(counts, "gram", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    # A window of so many words has as many n-grams as there are starts in it; a gram belongs to each of its windows.
    begin = F.explode(F.sequence(F.greatest(F.col("at") - (window - GRAM), F.lit(0)), F.col("at"))).alias("start")
    windows = places.filter(F.col("span") == GRAM).select("item", "gram", "held", "length", begin).filter(F.col("start") + window <= F.col("length"))
    rarest = F.row_number().over(Window.partitionBy("item", "start").orderBy("held", "gram"))
    needed = windows.withColumn("rank", rarest).filter("rank = 1 and held > 0").select("item", "gram", "held", F.lit(True).alias("sure"))
    rare = places.filter((F.col("held") > 0) & (F.col("held") <= max(RARE, documents // RARE_SHARE))).select("item", "gram", "held", F.lit(False).alias("sure"))
    return written(needed.unionByName(rare).groupBy("item", "gram", "held").agg(F.bool_or("sure").alias("sure")), "leaked-seeds")


def leaked_passages(corpus: DataFrame, tests: DataFrame, window: int = 12) -> DataFrame:
    """(doc, item, score, run, length): corpus texts aligned with the test texts that they may hold a passage of.

    ``corpus`` and ``tests`` are (id, text). A document and an item that share ``window`` (at least ``GRAM``) consecutive words
    are sure to come out, with ``run`` the length of the longest common run; others come out if they share ``LEAST_RARE`` rare
    n-grams, with ``score`` the Smith-Waterman score in words (2 for a match, -1 for a mismatch or gap) and ``length`` the
    item's words. No pair comes twice: of several passages, and of several texts with one id, the best counts. Null, empty and
    shorter texts give nothing, nor do empty tables.
    """
    spark = corpus.sparkSession
    docs = spread(corpus.select("id", "text").filter("text is not null and id is not null"), "id")
    id_type, item_type = corpus.schema["id"].dataType.simpleString(), tests.schema["id"].dataType.simpleString()
    items = tests.select("id", "text").filter("text is not null and id is not null")
    items = written(items.mapInArrow(_item_lists, f"item {item_type}, words array<long>, grams array<long>, gapped array<long>"), "leaked-items")
    many, size = items.agg(F.sum(F.size("grams") + F.size("gapped")), F.sum(row_bytes(items))).first()
    bits = filter_bits(many or 0, FILTER_BITS)
    passed = spark.sparkContext.broadcast(bit_filter(items.select(F.explode(F.concat("grams", "gapped")).alias("gram")), "gram", bits))
    schema = f"doc {id_type}, item {item_type}, score int, run int, length int"
    if (size or 0) <= BROADCAST_BYTES:
        # Seeds are at most the items' n-grams, so tasks can hold both: two passes over the corpus, of which counts and results are shuffled.
        counts = docs.mapInArrow(_held(passed, bits), "gram long, held long").groupBy("gram").agg(F.sum("held").alias("held"))
        seeds = _seeds_of(_seeds(items, counts, corpus.count(), window), items)
        scored = docs.mapInArrow(_align_in_place(spark.sparkContext.broadcast(seeds), bits), schema)
    else:
        hits = written(docs.mapInArrow(_hits(passed, bits), f"doc {id_type}, grams array<long>"), "leaked-hits").select("doc", F.explode("grams").alias("gram"))
        seeds = _seeds(items, hits.groupBy("gram").agg(F.count(F.lit(1)).alias("held")), corpus.count(), window)
        shared = looked_up(hits, seeds, "gram", "held").groupBy("doc", "item").agg(F.bool_or("sure").alias("sure"), F.count(F.lit(1)).alias("rare"))
        pairs = written(shared.filter(F.col("sure") | (F.col("rare") >= LEAST_RARE)).select("doc", "item"), "leaked-pairs")
        # How often an item's words are wanted, for the join to split items that many documents have.
        wanted = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("times"))
        words_of = written(items.select("item", "words").join(wanted, "item"), "leaked-words")
        texts = docs.withColumnRenamed("id", "doc").join(hinted(pairs), "doc")
        # Spread anew, as the documents that are left may lie anywhere.
        ready = looked_up(texts, words_of, "item", "times").select("doc", "item", "text", "words").repartition("doc", "item")
        scored = ready.mapInArrow(_align, schema)
    return scored.groupBy("doc", "item").agg(F.max("score").alias("score"), F.max("run").alias("run"), F.max("length").alias("length"))


def score_share(score: Column, length: Column) -> Column:
    """A score as a share of what a whole unedited copy of the item scores."""
    return score / (length * MATCH)
