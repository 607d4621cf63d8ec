"""Several values packed in one field: one value per row, with its position.

A finite-state tokenizer reads each text once. Its states are *outside* (collecting a plain value)
and *quoted* (collecting everything up to the matching close, with a depth for quote marks whose
opening and closing forms differ). A quote that is never closed is an ordinary separator. What closes
which mark is found by one pass per kind of mark, so a text of unclosed marks takes linear time too.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Opening quote marks and the marks that close them.
CLOSERS = {'"': '"', "'": "'", "“": "”", "„": "”“", "‘": "’", "«": "»", "‹": "›"}
APOSTROPHES = "'’"

_HAS_QUOTE = re.compile("[\"'“„‘’«‹]")
# Neither a letter, digit or hyphen, nor a space that only sets words apart.
_SEPARATOR = re.compile("[^\\w\\s\\-‐‑]|_|[^\\S    　]")


def _closings(text: str, opener: str) -> dict[int, int]:
    """For each mark of the kind ``opener`` in the text, the place of the mark that closes it; none for marks never closed.

    One pass from the left. A level of ``open_at`` has the marks that the next unpaired close ends: the mark that
    opened the level, and marks that a backslash hides from the depth but not from a reader that begins at them.
    """
    closers, found = CLOSERS[opener], {}
    open_at: list[list[int]] = [[]]
    for seen in re.finditer(rf"\\.|[{closers}{opener}]", text, re.S):
        at = seen.start()
        if seen.end() - at == 2:
            if text[at + 1] == opener:
                open_at[-1].append(at + 1)
            continue
        # An apostrophe inside a word does not close a single quote.
        inside = text[at] in APOSTROPHES and 0 < at < len(text) - 1 and text[at - 1].isalnum() and text[at + 1].isalnum()
        if text[at] in closers and not inside:
            found.update(dict.fromkeys(open_at.pop(), at))
            if not open_at:
                open_at.append([])
        if text[at] == opener:
            if opener in closers:
                open_at[-1].append(at)
            else:
                open_at.append([at])
    return found


def split_packed(text: str | None) -> list[str]:
    """The values of one text in order; null, blank and separator-only texts have none."""
    if text is None:
        return []
    if not _HAS_QUOTE.search(text):
        return [v for v in map(str.strip, _SEPARATOR.split(text)) if v]
    values: list[str] = []
    plain: list[str] = []
    closings: dict[str, dict[int, int]] = {}
    i, n = 0, len(text)

    def emit(value: str) -> None:
        if value := value.strip():
            values.append(value)

    def closing(opener: str, at: int) -> int | None:
        if opener not in closings:
            closings[opener] = _closings(text, opener)
        return closings[opener].get(at)

    while i < n:
        c = text[i]
        before = i > 0 and text[i - 1].isalnum()
        if c in APOSTROPHES and before and i + 1 < n and text[i + 1].isalnum():
            plain.append(c)
        elif c in CLOSERS and not (c in APOSTROPHES and before) and (end := closing(c, i)) is not None:
            emit("".join(plain))
            plain = []
            emit(re.sub(r"\\(.)", r"\1", text[i + 1 : end], flags=re.S))
            i = end
        elif _SEPARATOR.match(c):
            emit("".join(plain))
            plain = []
        else:
            plain.append(c)
        i += 1
    emit("".join(plain))
    return values


@F.arrow_udf(T.ArrayType(T.StringType()))
def _split_column(texts: pa.Array) -> pa.Array:
    return pa.array([split_packed(t) for t in texts.to_pylist()], pa.list_(pa.string()))


def split_values(text: Column) -> Column:
    """Array of the values packed in ``text``; empty for null and blank texts."""
    # Not to be evaluated once for the filter and again for the values.
    return _split_column.asNondeterministic()(text)


def unpacked(df: DataFrame, field: str, least: int = 1) -> DataFrame:
    """``df`` without ``field``, with ``pos`` (from 1) and ``item``: a row per value.

    Rows whose field holds fewer than ``least`` values (null and blank fields hold none) give no row.
    Repeated input rows give repeated rows. Other columns of ``df`` that are named pos or item are replaced. There is no
    shuffle: the work is one Arrow call per batch.
    """
    # Kept in a struct, so that no name can clash on the way.
    rest = [c for c in df.columns if c != field and c.lower() not in ("pos", "item")]
    split = df.select(F.struct(F.lit(0).alias("__row"), *(F.col(f"`{c}`") for c in rest)).alias("row"), split_values(F.col(f"`{field}`")).alias("values"))
    rows = split.filter(F.size("values") >= least).select("row", F.posexplode("values").alias("pos", "item"))
    return rows.select(*(F.col(f"row.`{c}`") for c in rest), (F.col("pos") + 1).alias("pos"), "item")
