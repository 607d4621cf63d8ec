"""Joins with a table of distinct keys that stay balanced when a few keys hold much of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: A key is hot if more than one in so many rows have it, so there are fewer hot keys than this, at any size of the data.
HOT_SHARE = 1000
#: No key of fewer rows is hot.
LEAST_HOT = 10_000

#: Bytes that a row, a text or a list takes besides its values in the table that a broadcast join builds.
_BESIDES = 32


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, its own text counted whole."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
        size = F.size(column) * 8 if fixed else F.octet_length(column.cast("string")) + F.size(column) * _BESIDES
    elif isinstance(kind, (T.StructType, T.MapType, T.VariantType)):
        size = F.octet_length(column.cast("string")) * 2
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(0)) + _BESIDES


def row_bytes(df: DataFrame, *leave: str) -> Column:
    """Bytes that a row of ``df`` takes, without the columns ``leave``."""
    return sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if f.name not in leave), F.lit(_BESIDES)).cast("long")


def table_bytes(df: DataFrame) -> int:
    """Bytes of all rows of ``df``, a written stage."""
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def hinted(table: DataFrame) -> DataFrame:
    """``table``, a written stage, to be broadcast if it is known to be small."""
    return F.broadcast(table) if table_bytes(table) <= BROADCAST_BYTES else table


def looked_up(rows: DataFrame, table: DataFrame, on: str | Sequence[str], times: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table`` on the keys ``on``; the column ``times`` of ``table`` is left out.

    ``table`` is a written stage, and ``times`` says how many of the rows have each key. A table of few bytes is broadcast.
    With a larger one the join is a shuffle in which hot keys are split: the rows of such a key go to as many parts as make
    none of them hot, by a hash of the whole row, and the key's row of the table goes to each of these parts. Only the hashes of
    hot keys, of which there are few at any size, are broadcast. Null keys match nothing.
    """
    on = [on] if isinstance(on, str) else list(on)
    size = table.agg(F.sum(row_bytes(table, times)).alias("bytes"), F.sum(times).alias("times")).first()
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table.drop(times)), on, how)
    limit = max(LEAST_HOT, size["times"] // HOT_SHARE)
    key = F.xxhash64(*(F.col(f"`{c}`") for c in on))
    hot = table.filter(F.col(times) > limit).groupBy(key.alias("__hash")).agg(F.sum(F.ceil(F.col(times) / F.lit(limit))).cast("int").alias("__parts"))
    few = hot.collect()
    if not few:
        return rows.join(table.drop(times), on, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(few, "__hash long, __parts int"))
    split = lambda df: df.withColumn("__hash", key).join(hot, "__hash", "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).drop("__hash")
    whole = F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))
    ours = split(rows).withColumn("__part", F.pmod(whole, F.col("__parts").cast("long")).cast("int")).drop("__parts")
    theirs = split(table.drop(times)).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    return ours.join(theirs, [*on, "__part"], how).drop("__part")
