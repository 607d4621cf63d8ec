"""All similar pairs between set-valued records, by T-occurrence list merging.

Every distinct value is normalised and numbered once, from rare to common, and a record becomes the sorted list of its
numbers. Records with equal sets form one class; only classes are compared. Two sets of Jaccard similarity t or more share
one of the first ``n - ceil(t n) + 1`` terms of each, so every class is posted under those of its terms, and the postings of
one term are one inverted-list partition. In it, each class probes the inverted lists of the terms that follow: the longest
lists are set aside for binary search, the short ones are merged by a heap that skips ahead, and classes that reach the
required overlap are emitted, each pair only under the first term it shares (which is why postings keep the terms before).

A term whose postings exceed ``BLOCK`` is split into blocks by size, and pairs of blocks whose sizes can be similar are
separate groups, so that no task holds more than two blocks. The result is links between classes and the classes' members.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import log, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.text import normalised
from platewise.llm.codes import coded, starts
from platewise.operators.lookup import BROADCAST_BYTES, hinted, looked_up, table_bytes
from platewise.operators.numbering import numbered
from platewise.stage import written

#: Cost of merging a number, as a share of searching it in a list of two.
MERGE_COST = 0.01
#: Postings of one term that one group holds; more are split into pairs of blocks.
BLOCK = 4096
#: Members of a class that pairs are made of at a time.
CHUNK = 1000


def required(n: int, threshold: Fraction) -> int:
    """Least number of a set's ``n`` terms that any set of the similarity must share with it."""
    return -(-threshold.numerator * n // threshold.denominator)


def at_least(lists: list[list[int]], need: int, low: int) -> Iterator[tuple[int, int]]:
    """Numbers from ``low`` on that occur in ``need`` or more of the ascending ``lists``, with their counts.

    Some of the longest lists are set apart and searched by bisection, the more the longer they are, but never so
    many that a number could do without the others; those are merged by a heap, which skips ahead of numbers that
    too few of them hold.
    """
    if need <= 0 or len(lists) < need:
        return
    lists = sorted(lists, key=len)
    apart = min(need - 1, int(need / (MERGE_COST * log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
    heap = [(x[at], k, at) for k, x in enumerate(short) if (at := bisect_left(x, low)) < len(x)]
    heapify(heap)
    least = need - apart
    while len(heap) >= least:
        top, count, popped = heap[0][0], 0, []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap))
            count += 1
        if count >= least:
            left = len(long)
            for x in long:
                if count + left < need:
                    break
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
                left -= 1
            if count >= need:
                yield top, count
            after = top + 1
        else:
            # Too few lists hold the top: it can't qualify, and neither can any number before the
            # (least - 1)th list's front, so those lists skip to it.
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap))
            after = heap[0][0] if heap else top + 1
        for _, k, at in popped:
            x = short[k]
            at = bisect_left(x, after, at)
            if at < len(x):
                heappush(heap, (x[at], k, at))


def merged(group: list[tuple[int, int, int, list[int]]], token: int, cross: bool, threshold: Fraction) -> Iterator[tuple[int, int, int]]:
    """(class, class, shared terms) of the similar pairs in the postings (block, class, n, ranks) of one term."""
    num, den = threshold.numerator, threshold.denominator
    group.sort(key=lambda g: (g[2], g[1]))
    sizes = [g[2] for g in group]
    places = [bisect_left(g[3], token) for g in group]
    inverted: dict[int, list[int]] = {}
    for me, (block, cls, n, ranks) in enumerate(group):
        at = places[me]
        need = required(n, threshold)
        low = bisect_left(sizes, need, 0, me)
        after = ranks[at + 1 :]
        if low < me and len(after) >= need - 1:
            if need == 1:
                found: Iterable[tuple[int, int]] = ((k, 0) for k in range(low, me))
            else:
                found = at_least([x for r in after if (x := inverted.get(r))], need - 1, low)
            for k, _ in found:
                other = group[k]
                if cross and other[0] == block:
                    continue
                theirs = other[3]
                if at and places[k] and not set(ranks[:at]).isdisjoint(theirs[: places[k]]):
                    continue
                common = len(set(after).intersection(theirs)) + 1
                if common * den >= num * (n + other[2] - common):
                    yield min(cls, other[1]), max(cls, other[1]), common
        for r in after:
            inverted.setdefault(r, []).append(me)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, int, list[tuple]]]:
    """Of each group (token, low, high) in a partition sorted by them: whether it is of two blocks, its token, its rows. A group may span batches."""
    key, rows = None, []
    for batch in batches:
        ends, values = starts(batch.column("ranks"))
        values, ends = values.to_numpy().tolist(), ends.tolist()
        plain = (batch.column(n).to_numpy().tolist() for n in ("token", "low", "high", "block", "cls", "n"))
        for k, (t, i, j, *row) in enumerate(zip(*plain)):
            if (t, i, j) != key:
                if len(rows) > 1:
                    yield key[1] != key[2], key[0], rows
                key, rows = (t, i, j), []
            rows.append((*row, values[ends[k] : ends[k + 1]]))
    if len(rows) > 1:
        yield key[1] != key[2], key[0], rows


def _emit(threshold: Fraction):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], ["cls_a", "cls_b", "common"])
        for cross, token, rows in _groups(batches):
            for pair in merged(rows, token, cross, threshold):
                out.append(pair)
                if len(out) >= 50_000:
                    yield pack()
                    out.clear()
        yield pack()

    return run


#: Code of blank values.
_BLANK = 0


def _ranked(kind: pa.DataType):
    """Records with the codes of their terms to sets: the number of terms, the ascending ranks of those that any other record may have, and a print of the whole set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, codes = batch.column("terms").flatten(), batch.column("codes")
            ends, codes = starts(codes)
            count = len(ends) - 1
            of = np.repeat(np.arange(count), np.diff(ends))
            known = codes.is_valid().to_numpy(zero_copy_only=False)
            alone = np.flatnonzero(~known & terms.is_valid().to_numpy(zero_copy_only=False))
            values, of_known = codes.drop_null().to_numpy(), of[known]
            order = np.lexsort((values, of_known))
            values, of_known = values[order], of_known[order]
            distinct = (values != _BLANK) & np.r_[True, (values[1:] != values[:-1]) | (of_known[1:] != of_known[:-1])][: len(values)]
            values, of_known = values[distinct], of_known[distinct]
            at = np.r_[0, np.cumsum(np.bincount(of_known, minlength=count))]
            n = np.diff(at) + np.bincount(of[alone], minlength=count)
            own: dict[int, list[str]] = {}
            for record, term in zip(of[alone].tolist(), terms.take(pa.array(alone)).to_pylist()):
                own.setdefault(record, []).append(term)
            raw, fields = values.tobytes(), batch.column("field").to_pylist()
            prints = []
            for k, (field, start, end) in enumerate(zip(fields, at[:-1].tolist(), at[1:].tolist())):
                digest = xxhash.xxh3_128(raw[8 * start : 8 * end])
                if k in own:
                    digest.update("\0".join([field, *sorted(own[k])]).encode("utf-8", "surrogatepass"))
                prints.append(digest.digest())
            ranks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values).cast(kind))
            keep = pa.array(n > 0)
            columns = [batch.column(c) for c in ("rec", "side", "field", "id")] + [pa.array(n.astype(np.int32)), ranks, pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rec", "side", "field", "id", "n", "ranks", "print"]).filter(keep)

    return run


def set_records(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(field, id, terms) of the rows of ``df`` that have values in a field."""
    each = F.array(*(F.struct(F.lit(name).alias("field"), column.alias("terms")) for name, column in fields.items()))
    return df.select(F.col(f"`{key}`").alias("id"), F.inline(each)).filter(F.size("terms") > 0).select("field", "id", "terms")


def ranked_sets(records: DataFrame) -> DataFrame:
    """(rec, side, field, id, n, ranks, print) of the non-empty sets of (side, field, id, terms), a stage; ``rec`` is unique."""
    records = records.filter(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("rec"), "side", "field", "id", "terms")
    raws = records.select("field", F.explode("terms").alias("raw")).filter("raw is not null").groupBy("field", "raw").agg(F.count(F.lit(1)).alias("times"))
    raws = written(raws.withColumn("term", normalised(F.col("raw"))), "set-raws")
    # A term that is written once in all joins nothing; such terms only count towards sizes.
    shared = raws.filter("term <> ''").groupBy("field", "term").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("spelt")).filter("all > 1")
    ranks = numbered(shared, "all", "field", "term", name="rank", small=table_bytes(raws) <= BROADCAST_BYTES)
    named = looked_up(raws, ranks.select("field", "term", "spelt", (F.col("rank") + 1).alias("code")), ["field", "term"], "spelt")
    blank = raws.filter("term = ''").withColumn("code", F.lit(_BLANK).cast("long"))
    dictionary = written(named.unionByName(blank).select("field", F.col("raw").alias("term"), "code", "times"), "set-dictionary")
    small = (ranks.agg(F.max("rank")).first()[0] or 0) + 1 < 1 << 31
    schema = f"rec long, side int, field string, id {records.schema['id'].dataType.simpleString()}, n int, ranks array<{'int' if small else 'long'}>, print binary"
    return written(coded(records, dictionary, "times", _ranked(pa.int32() if small else pa.int64()), schema), "set-ranked")


def classed(ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``cls``, the record that stands for all records with an equal set, and ``copies``, how many there are.

    Only prints are shuffled, and of these only the repeated ones are joined back.
    """
    repeated = ranked.groupBy("print").agg(F.min("rec").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    repeated = written(repeated.withColumn("copies", F.col("times")), "set-repeated")
    found = looked_up(ranked, repeated, "print", "times", how="left").withColumns({"cls": F.coalesce("first", "rec"), "copies": F.coalesce("copies", F.lit(1))})
    found = found.select("rec", "cls", "copies", "side", "field", "id", "n", "ranks")
    return found if table_bytes(repeated) <= BROADCAST_BYTES else written(found, "set-classed")


def class_links(classes: DataFrame, threshold: Fraction = Fraction(4, 5), block: int = BLOCK) -> DataFrame:
    """(cls_a, cls_b, common) of every two classes (cls, n, ranks) whose sets are similar; no pair comes twice."""
    least = F.ceil(F.col("n") * threshold.numerator / F.lit(float(threshold.denominator)) - F.lit(1e-9)).cast("int")
    # Of the first n - least + 1 terms, those of one record alone come first.
    prefix = (F.size("ranks") - least + 1).cast("int")
    # Similar sets are in the same or in neighbouring bands of size.
    width = max(-log(threshold) + 1e-9, 1e-6)
    tokens = F.explode(F.slice(F.col("ranks").cast("array<long>"), F.lit(1), prefix)).alias("token")
    postings = classes.filter(prefix > 0).select("cls", "n", "ranks", F.floor(F.log("n") / width).alias("band"), tokens)
    counts = postings.groupBy("token", "band").agg(F.count(F.lit(1)).alias("posted"))
    # The bands of a term, of which there are few, with their blocks: those that have a partner in the same band or the next.
    grouped = counts.groupBy("token").agg(F.sum("posted").alias("times"), F.collect_list(F.struct("band", "posted", F.ceil(F.col("posted") / F.lit(block)).cast("int").alias("blocks"))).alias("all"))
    met = F.filter("all", lambda x: F.exists("all", lambda y: (F.abs(x["band"] - y["band"]) <= 1) & ((x["band"] != y["band"]) | (x["posted"] > 1))))
    whole = F.col("times") <= block
    bands = F.transform(met, lambda x: F.struct(x["band"].alias("band"), F.when(~whole, x["blocks"]).alias("blocks")))
    posted = written(grouped.select("token", "times", bands.alias("bands")).filter(F.size("bands") > 0), "set-posted")
    if table_bytes(posted) <= BROADCAST_BYTES:
        placed = looked_up(postings, posted, "token", "times").filter(F.exists("bands", lambda b: b["band"] == F.col("band")))
    else:
        # Only terms of more postings than a block, of which there are fewer than blocks, need to be looked up.
        crowded = written(posted.filter(F.col("times") > block), "set-crowded")
        placed = looked_up(postings, crowded, "token", "times", how="left").filter(F.coalesce(F.exists("bands", lambda b: b["band"] == F.col("band")), F.lit(True)))
    code = lambda band, number: F.shiftleft(band.cast("long"), 32) + number
    mine = F.get(F.filter("bands", lambda b: b["band"] == F.col("band")), F.lit(0))["blocks"]
    near = F.filter("bands", lambda b: F.abs(b["band"] - F.col("band")) <= 1)
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), b["blocks"] - 1), lambda k: code(b["band"], k))))
    place = F.coalesce(code(F.col("band"), F.pmod(F.xxhash64("cls"), mine.cast("long"))), F.lit(0).cast("long"))
    sent = placed.select("token", place.alias("block"), "cls", "n", "ranks", F.explode(F.coalesce(others, F.array(F.lit(0).cast("long")))).alias("with"))
    sent = sent.select("token", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "cls", "n", "ranks")
    grouped = sent.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return grouped.mapInArrow(_emit(threshold), "cls_a long, cls_b long, common long")


class Similar(NamedTuple):
    """Links (cls_a, cls_b) between classes of equal sets, a class with copies linked with itself; the classes (cls, copies) that have links; and
    their members (cls, field, side, id), each id once. All are stages."""

    links: DataFrame
    classes: DataFrame
    members: DataFrame


def similar_classes(left: DataFrame, right: DataFrame | None = None, threshold: Fraction = Fraction(4, 5)) -> Similar:
    """The similar sets of :func:`similar_pairs` as links between classes: as many rows as there are classes and links, however many copies a set has."""
    records = left.select("field", "id", "terms", F.lit(0).alias("side"))
    if right is not None:
        records = records.unionByName(right.select("field", "id", "terms", F.lit(1).alias("side")))
    sets = classed(ranked_sets(records))
    first = sets.filter("rec = cls")
    links = class_links(first.select("cls", "n", "ranks"), threshold).select("cls_a", "cls_b")
    equal = first.filter("copies > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    linked = written(links.unionByName(equal), "set-links")
    wanted = linked.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    classes = written(first.select("cls", "copies").join(wanted, "cls", "left_semi"), "set-classes")
    members = looked_up(sets.select("cls", "field", "side", "id"), classes.select("cls", F.col("copies").alias("times")), "cls", "times").distinct()
    return Similar(linked, classes, written(members, "set-members"))


def expanded(similar: Similar) -> DataFrame:
    """(field, side_a, a, side_b, b) of all pairs of members of linked classes; a class linked with itself gives each pair once.

    Classes of many members are taken ``CHUNK`` members at a time, so that no group makes more than its square of pairs.
    """
    chunks = similar.classes.select("cls", F.ceil(F.col("copies") / F.lit(CHUNK)).cast("int").alias("chunks"))
    large = written(chunks.filter("chunks > 1"), "set-large")
    if large.isEmpty():
        members, sized = similar.members.withColumn("chunk", F.lit(0)), similar.links.select("*", F.lit(1).alias("chunks_a"), F.lit(1).alias("chunks_b"))
    else:
        own = similar.members.join(hinted(large), "cls", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        members = written(own.withColumn("chunk", F.pmod(F.xxhash64("side", "id"), F.col("chunks").cast("long")).cast("int")).drop("chunks"), "set-chunked")
        side = lambda c: hinted(large).withColumnsRenamed({"cls": f"cls_{c}", "chunks": f"chunks_{c}"})
        sized = similar.links.join(side("a"), "cls_a", "left").join(side("b"), "cls_b", "left").fillna(1, ["chunks_a", "chunks_b"])
    first = sized.select("cls_a", "cls_b", "chunks_b", F.explode(F.sequence(F.lit(0), F.col("chunks_a") - 1)).alias("chunk_a"))
    start = F.when(F.col("cls_a") == F.col("cls_b"), F.col("chunk_a")).otherwise(0)
    both = first.select("cls_a", "cls_b", "chunk_a", F.explode(F.sequence(start, F.col("chunks_b") - 1)).alias("chunk_b"))
    of = lambda c: members.select(F.col("cls").alias(f"cls_{c}"), F.col("chunk").alias(f"chunk_{c}"), F.col("side").alias(f"side_{c}"), F.col("id").alias(c), *(["field"] if c == "a" else []))
    small = table_bytes(members) <= BROADCAST_BYTES
    pairs = both
    for c in ("a", "b"):
        pairs = pairs.join(F.broadcast(of(c)) if small else of(c), [f"cls_{c}", f"chunk_{c}"])
    apart = (F.col("cls_a") != F.col("cls_b")) | (F.col("chunk_a") != F.col("chunk_b")) | (F.struct("side_a", "a") < F.struct("side_b", "b"))
    return pairs.filter(apart).select("field", "side_a", "a", "side_b", "b")


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(field, id_a, id_b) of all pairs of records whose sets have Jaccard similarity ``threshold`` or more.

    ``left`` and ``right`` are (field, id, terms) as from :func:`set_records`; the sets are the distinct normalised terms without
    null and blank ones. Without ``right`` the pairs are within ``left``, the smaller id first; with it, id_a is from ``left``
    and id_b from ``right``. Empty sets are similar to nothing, nor are rows with a null id. Rows repeated with the same id and
    set count once, an id is never paired with itself within a table, and no pair comes twice. Empty tables give no pairs.
    """
    pairs = expanded(similar_classes(left, right, threshold))
    if right is None:
        return pairs.filter("a <> b").select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    # Between two tables the class of either may come first.
    first = F.when(F.col("side_a") == 0, F.col("a")).otherwise(F.col("b"))
    second = F.when(F.col("side_a") == 0, F.col("b")).otherwise(F.col("a"))
    return pairs.filter("side_a <> side_b and a is not null and b is not null").select("field", first.alias("id_a"), second.alias("id_b"))
