"""Records that are identical except for formatting, collapsed with the number of their copies.

Each record is cut into pieces that belong to fields (a title, a note, an address, a parameter). Every distinct
piece is brought to its canonical form once, every distinct canonical form gets an integer, and a record
becomes the sorted tuple of its (field, integer) codes. Equal tuples are copies.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.operators.lookup import looked_up
from platewise.stage import written


def canonical(piece: str | None) -> str:
    """The letters and digits of the NFC form, case aside; '' for null."""
    if not piece:
        return ""
    if piece.isascii():
        return "".join(c for c in piece if c.isalnum()).lower()
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", piece).casefold())
    return "".join(c for c in folded if c.isalnum())


@F.arrow_udf(T.StringType())
def _canonical(pieces: pa.Array) -> pa.Array:
    return pa.array([canonical(p) for p in pieces.to_pylist()], pa.string())


#: Fields of the pieces.
WHOLE, PART = 0, 1


def _pieces(whole: Column, parts: Column) -> Column:
    as_part = F.transform(F.filter(parts, lambda p: p.rlike(r"[\p{L}\p{N}]")), lambda p: F.struct(F.lit(PART).alias("kind"), p.alias("raw")))
    return F.concat(F.array(F.struct(F.lit(WHOLE).alias("kind"), whole.alias("raw"))), as_part)


def title_pieces(name: Column) -> Column:
    """The title of a name, and the notes of the bracketed list that may follow it."""
    # Brackets with letters or digits after them are no list but part of the title.
    listed = r"^([\s\S]*)\[([^\[\]]*)\][^\p{L}\p{N}]*$"
    has = name.rlike(listed)
    whole = F.when(has, F.regexp_extract(name, listed, 1)).otherwise(name)
    notes = F.when(has, F.split(F.regexp_extract(name, listed, 2), ";")).otherwise(F.array().cast("array<string>"))
    return _pieces(whole, notes)


def address_pieces(url: Column) -> Column:
    """The part of an address before the first '?', and its parameters."""
    whole = F.regexp_extract(url, r"^[^?]*", 0)
    after = F.regexp_extract(url, r"^[^?]*\?([\s\S]*)$", 1)
    return _pieces(whole, F.split(after, "[&;]"))


def formatting_copies(records: DataFrame) -> DataFrame:
    """(tbl, id, copies): a row per group of records of one table that differ only in formatting.

    ``records`` is (tbl, id, pieces), with pieces from :func:`title_pieces` or :func:`address_pieces`. ``id`` is
    the group's smallest, ``copies`` the number of its rows, repeated rows included; groups of one are
    included. Rows whose pieces are null (null text) belong to no group. Empty and symbol-only texts are
    copies of each other.
    """
    # Texts written alike are one record from here on, however many they are.
    same = records.filter(F.col("pieces").isNotNull()).groupBy("tbl", "pieces").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    same = written(same.withColumn("rec", F.monotonically_increasing_id()), "copies-records")
    pieces = same.select("rec", F.inline("pieces"))
    raws = written(pieces.groupBy("raw").agg(F.count(F.lit(1)).alias("held")).withColumn("form", _canonical("raw")), "copies-raws")
    forms = raws.groupBy("form").agg(F.count(F.lit(1)).alias("spelt"))
    forms = written(forms.withColumn("code", F.monotonically_increasing_id()), "copies-forms")
    codes = written(looked_up(raws, forms, "form", "spelt").select("raw", "held", "code"), "copies-codes")
    coded = looked_up(pieces, codes, "raw", "held").select("rec", "kind", "code")
    tuples = coded.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("kind", "code"))).alias("record"))
    joined = tuples.join(same.select("rec", "tbl", "id", "copies"), "rec")
    return joined.groupBy("tbl", "record").agg(F.min("id").alias("id"), F.sum("copies").alias("copies")).select("tbl", "id", "copies")
