"""Terms that appear together in records, counted by external sorting of packed pair codes.

Terms get dense integers, and every pair of terms in a record is one 64-bit code. Mappers fill a buffer
with codes, sort it and count its runs, so each emits sorted (code, count) runs; Spark's shuffle sort spills and
merges them, and one pass over each sorted partition adds up the runs. Odds ratios with continuity correction
say how much more often than chance a pair occurs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.codes import coded, starts
from platewise.operators.lookup import BROADCAST_BYTES, looked_up, table_bytes
from platewise.operators.numbering import numbered
from platewise.stage import written

#: Codes that a mapper holds before it sorts and counts them (32 MB).
BUFFER = 4_000_000
#: Codes of terms in a pair code have so many bits; terms beyond are counted in further blocks of codes.
BITS = 31
RUN = "code long, k long"


def _runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a sorted array, with the number of each or the sum of its counts."""
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, int)
    if counts is None:
        return codes[starts], np.diff(np.r_[starts, len(codes)])
    return codes[starts], np.add.reduceat(counts, starts) if len(codes) else counts


def _batch(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["code", "k"])


def _pairs(ends: np.ndarray, codes: np.ndarray, low: int, high: int, bits: int) -> Iterator[np.ndarray]:
    """Pair codes of the lists of ascending ``codes``, of which the smaller lies in block ``low`` and the larger in ``high``; about ``BUFFER`` at a time."""
    if not len(codes):
        return
    record_end = np.repeat(ends[1:], np.diff(ends))
    first = np.arange(1, len(codes) + 1)
    mask, block = (1 << bits) - 1, codes >> bits
    if low != high:
        # The larger ones begin where the list leaves the blocks before theirs.
        before = np.r_[0, np.cumsum(block < high)]
        first = np.repeat(ends[:-1] + before[ends[1:]] - before[ends[:-1]], np.diff(ends))
    in_high = np.r_[0, np.cumsum(block == high)]
    count = np.where(block == low, in_high[record_end] - in_high[np.minimum(first, record_end)], 0)
    total = np.cumsum(count)
    at = 0
    while at < len(codes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + BUFFER, "right")))
        n = count[at:to]
        left = np.repeat(codes[at:to] & mask, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        if len(left):
            yield (left << 32) | (codes[right] & mask)
        at = to


def sorted_runs(low: int = 0, high: int = 0, bits: int = BITS):
    """Sorted, counted runs of the pair codes of the ``codes`` lists, for one pair of blocks of codes. Null codes are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if size:
                codes = np.sort(np.concatenate(held))
                held, size = [], 0
                codes, counts = _runs(codes)
                for at in range(0, len(codes), 100_000):
                    yield _batch(codes[at : at + 100_000], counts[at : at + 100_000])

        for batch in batches:
            ends, values = starts(batch.column("codes"))
            known = values.is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[known]
            codes = values.drop_null().to_numpy()
            order = np.lexsort((codes, of))
            ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(ends) - 1))]
            for pairs in _pairs(ends, codes[order], low, high, bits):
                held.append(pairs)
                size += len(pairs)
                if size >= BUFFER:
                    yield from flush()
        yield from flush()

    return run


def merged_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the runs of a sorted partition; the last code of a batch may go on in the next."""
    last: tuple[int, int] | None = None
    for batch in batches:
        codes, counts = _runs(batch.column("code").to_numpy(), batch.column("k").to_numpy())
        if not len(codes):
            continue
        if last and codes[0] == last[0]:
            counts = counts.copy()
            counts[0] += last[1]
        elif last:
            yield _batch(np.array([last[0]]), np.array([last[1]]))
        last = int(codes[-1]), int(counts[-1])
        if len(codes) > 1:
            yield _batch(codes[:-1], counts[:-1])
    if last:
        yield _batch(np.array([last[0]]), np.array([last[1]]))


def pair_counts(records: DataFrame, least: int = 1, share: int | None = None) -> DataFrame:
    """(field, term_a, term_b, k, in_a, in_b, n, odds) of terms found together in ``k`` or more records.

    ``records`` is (field, terms): arrays of distinct terms; each row is a record, repeated rows too. n is the number
    of the field's records with a term. Pairs have k >= ``least`` and, with ``share``, share * k >= n; both bounds
    also hold for each term's own count, so terms below them are left out before pairs are made, without
    losing a pair. term_a < term_b by code point. ``odds`` is the odds ratio with 1/2 added to each cell.
    Null and empty arrays are no records; empty tables give no pairs.
    """
    records = records.filter(F.size("terms") > 0)
    # Read twice, for the terms and for the pairs.
    kept = written(records.select(F.monotonically_increasing_id().alias("rec"), "field", "terms"), "together-records")
    rows = kept.select("rec", "field", F.posexplode("terms").alias("pos", "term"))
    # Each record counts once for n, at its first term.
    totals = rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("held"), F.count_if(F.col("pos") == 0).alias("first"))
    totals = written(totals, "together-terms")
    sizes = totals.groupBy("field").agg(F.sum("first").alias("n"))
    frequent = totals.join(F.broadcast(sizes), "field").filter(F.col("held") >= least)
    if share is not None:
        frequent = frequent.filter(F.col("held") * share >= F.col("n"))
    # Numbered in order, so that the smaller code is the smaller term, and densely, to fit few bits.
    dictionary = written(numbered(frequent.select("field", "term", "held", "n"), "field", "term", name="code", small=table_bytes(totals) <= BROADCAST_BYTES), "together-dictionary")
    blocks = (dictionary.agg(F.max("code")).first()[0] or 0) // (1 << BITS) + 1
    counted = []
    for low in range(blocks):
        for high in range(low, blocks):
            runs = coded(kept, dictionary, "held", sorted_runs(low, high, BITS), RUN)
            merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(merged_runs, RUN).filter(F.col("k") >= least)
            side = lambda part, block: part + F.lit(block << BITS)
            counted.append(merged.select(side(F.shiftright("code", 32), low).alias("tid_a"), side(F.col("code").bitwiseAND(F.lit((1 << 32) - 1)), high).alias("tid_b"), "k"))
    side = lambda c: dictionary.select(F.col("code").alias(f"tid_{c}"), *([F.col("field"), F.col("n")] if c == "a" else []), F.col("term").alias(f"term_{c}"), F.col("held").alias(f"in_{c}"), F.col("held").alias("times"))
    named = looked_up(looked_up(reduce(DataFrame.unionByName, counted), side("a"), "tid_a", "times"), side("b"), "tid_b", "times")
    if share is not None:
        named = named.filter(F.col("k") * share >= F.col("n"))
    both, a, b, neither = F.col("k") + 0.5, F.col("in_a") - F.col("k") + 0.5, F.col("in_b") - F.col("k") + 0.5, F.col("n") - F.col("in_a") - F.col("in_b") + F.col("k") + 0.5
    return named.select("field", "term_a", "term_b", "k", "in_a", "in_b", "n", (both * neither / (a * b)).alias("odds"))


def above_chance(factor: int) -> Column:
    """Whether a pair of :func:`pair_counts` is found at least ``factor`` times as often as by chance. In decimals, as the products outgrow 64 bits."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return wide("k") * wide("n") >= wide("in_a") * wide("in_b") * F.lit(factor).cast("decimal(38,0)")
