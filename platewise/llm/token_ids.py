"""Encoding of a corpus with a public byte-level BPE tokenizer, from a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter everywhere.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the published pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in slices of about so many characters.
SLICE = 1 << 16

# A space between two letters or digits always begins a token of its own, whatever stands around it.
_SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
# Longer runs of white space overrun the stack of the library's matching.
_RUN = re.compile(r"[^\S\x1c-\x1f]{%d,}" % SLICE)


def slices(text: str, length: int = SLICE) -> Iterator[str]:
    """The text in slices that encode separately to the same tokens as together.

    A slice is longer than ``length`` only as far as the next safe boundary is.
    """
    at = 0
    while len(text) - at > length and (cut := _SAFE.search(text, at + length)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The tiktoken encoding of a rank file (base64 token and rank on each line)."""
    import tiktoken

    lines = Path(vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}
    return tiktoken.Encoding(Path(vocabulary).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(text: str | None, vocabulary: str) -> np.ndarray:
    """Token ids of a text; none for empty and null texts. What looks like a special token is ordinary text."""
    if not text:
        return np.empty(0, np.uint32)
    encode = encoding(vocabulary).encode_to_numpy
    if len(text) <= SLICE:
        return encode(text, disallowed_special=())
    ids, at = [], 0
    for run in _RUN.finditer(text):
        # The run is one token of the pattern, but for its last character if more text follows.
        end = run.end() - (run.end() < len(text))
        ids += [encode(s, disallowed_special=()) for s in slices(text[at : run.start()])]
        ids.append(np.array(encoding(vocabulary)._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    ids += [encode(s, disallowed_special=()) for s in slices(text[at:])]
    return np.concatenate(ids)


def decoded(ids, vocabulary: str) -> bytes:
    """The raw bytes of the token ids; of whole encoded texts, their UTF-8."""
    return encoding(vocabulary).decode_bytes(list(ids))


def token_ids(text: Column, vocabulary: str) -> Column:
    """Array of the text's token ids, for the rank file ``vocabulary`` that every executor can read.

    Empty and null texts both give the empty array. One Arrow call per batch, no shuffle.
    """

    def encode(texts: pa.Array) -> pa.Array:
        ids = [encoded(t, vocabulary) for t in texts.to_pylist()]
        ends = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))

    return F.arrow_udf(encode, T.ArrayType(T.IntegerType(), containsNull=False)).asNondeterministic()(text)


def decoded_text(ids: Column, vocabulary: str) -> Column:
    """The bytes that an array of token ids stands for; null for null."""

    def decode(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decoded(x, vocabulary) for x in lists.to_pylist()], pa.binary())

    return F.arrow_udf(decode, T.BinaryType())(ids)
