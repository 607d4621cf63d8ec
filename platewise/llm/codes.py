"""Integer codes of the texts in list columns, looked up in place where the dictionary is small and by joins where it isn't; bit filters of codes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.operators.lookup import BROADCAST_BYTES, looked_up, row_bytes

Batches = Iterable[pa.RecordBatch]

#: Bytes of a dictionary that tasks may hold.
HELD_BYTES = BROADCAST_BYTES


def starts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The offsets of the lists, from 0, and their values."""
    ends = lists.offsets.to_numpy()
    return ends - ends[0], lists.flatten()


def _in_place(held) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = starts(batch.column("terms"))
            codes = np.full(len(values), -1, np.int64)
            fields = batch.column("field")
            for name, (terms, own) in held.value.items():
                mine = np.repeat(pc.equal(fields, name).fill_null(False).to_numpy(zero_copy_only=False), np.diff(ends)).nonzero()[0]
                if len(mine):
                    at = pc.index_in(values.take(pa.array(mine)), value_set=terms).fill_null(-1).to_numpy()
                    codes[mine] = np.where(at >= 0, own[at], -1)
            # What the dictionary lacks is null.
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, mask=codes == -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])

    return run


def coded(records: DataFrame, dictionary: DataFrame, times: str, then: Callable[[Batches], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``then`` over batches of ``records`` with ``codes``, the code of each of the ``terms``, null for those without.

    ``records`` is a stage of (rec, field, terms) and more, ``rec`` unique, terms not null, lists not empty. ``dictionary`` is a stage
    of (field, term, code), codes not negative, and ``times``, which says how many of the records' terms are the term.
    """
    spark = records.sparkSession
    if (dictionary.agg(F.sum(row_bytes(dictionary, times))).first()[0] or 0) <= HELD_BYTES:
        table = dictionary.select("field", "term", "code").toArrow()
        held = {}
        for name in table.column("field").unique().to_pylist():
            own = table.filter(pc.equal(table.column("field"), name))
            held[name] = own.column("term").combine_chunks(), own.column("code").to_numpy()
        place = _in_place(spark.sparkContext.broadcast(held))
        return records.mapInArrow(lambda batches: then(place(batches)), schema)
    keys = [c for c in records.columns if c != "terms"]
    single = records.select(*keys, F.posexplode("terms").alias("pos", "term"))
    found = looked_up(single, dictionary.select("field", "term", "code", times), ["field", "term"], times, how="left")
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "term", "code"))).alias("all"))
    return lists.select(*keys, F.col("all.term").alias("terms"), F.col("all.code").alias("codes")).mapInArrow(then, schema)


def filter_bits(many: int, most: int) -> int:
    """The size of a filter, as a power of two, that has some hundred bits for each of ``many`` codes, but is bounded by ``most``."""
    return min(most, max(6, (128 * many).bit_length()))


def filter_of(codes: np.ndarray, bits: int) -> np.ndarray:
    """The filter of :func:`bit_filter`, of codes at hand."""
    slot = codes.view(np.uint64) & np.uint64((1 << bits) - 1)
    words = np.zeros(1 << (bits - 6), np.uint64)
    np.bitwise_or.at(words, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
    return words


def bit_filter(codes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A filter of 2 to the power of ``bits`` (6 at least) bits, set at the 64-bit codes in a column, as 64-bit words."""
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    each = codes.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("bit"))
    # At most one row for each word of the filter.
    table = each.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return words


def passing(codes: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Which codes pass a :func:`bit_filter`: all that are in it, and others by chance."""
    slot = codes.view(np.uint64) & np.uint64((1 << bits) - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
