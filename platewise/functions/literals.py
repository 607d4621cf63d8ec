"""List literals: text that spells a list of strings, as JSON or as Python writes it."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(text: str | None) -> list[str | None] | None:
    """The elements of a Python list or tuple literal as strings, None elements kept; None for anything else."""
    if text is None:
        return None
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None
    if not isinstance(value, (list, tuple)):
        return None
    return [None if v is None else str(v).encode("utf-8", "replace").decode() for v in value]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _literal(texts: pa.Array) -> pa.Array:
    return pa.array([literal(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def list_elements(text: Column, strict: bool = False) -> Column:
    """Array of the elements of a list literal; null for null and for text that is no list.

    Both dialects are read inside the JVM. With ``strict``, what that reads as null (tuples, ``None`` elements,
    hexadecimal escapes, trailing commas) is read as Python would, by one Arrow call over those texts alone.
    """
    read = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    if not strict:
        return read
    return F.coalesce(read, _literal(F.when(read.isNull(), text)))


def list_text(elements: Column) -> Column:
    """JSON text of an array; null for null."""
    return F.to_json(elements)
