"""Fetching documents by address (S3 to S5), for when their text isn't a column already."""

from __future__ import annotations

import urllib.request
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: seconds that a request may take.
TIMEOUT = 10
#: Requests that one task has open at a time.
OPEN = 8

_RESULT = pa.struct([("body", pa.string()), ("error", pa.string())])


def fetched_text(url: str | None, timeout: float = TIMEOUT, checked: bool = True) -> tuple[str | None, str | None]:
    """(body, error) of an address, one of them None; null gives (None, None).

    With ``checked``, an HTTP status of 400 or more is an error; without, its body is the body.
    """
    if url is None:
        return None, None
    try:
        try:
            reply = urllib.request.urlopen(url, timeout=timeout)  # noqa: S310
        except urllib.error.HTTPError as error:
            if checked:
                return None, f"status {error.code}"
            reply = error
        with reply:
            charset = reply.headers.get_content_charset() or "utf-8"
            return reply.read().decode(charset, "replace"), None
    except Exception as error:  # whatever one address does must not end the job
        return None, f"{type(error).__name__}: {error}"


def fetched(url: Column, timeout: float = TIMEOUT, checked: bool = True) -> Column:
    """A struct of body and error for each address. Each row's address is fetched once for each evaluation of the plan,
    so write the result before using it twice. The number of partitions bounds the load on the sites."""

    def run(urls: pa.Array) -> pa.Array:
        with ThreadPoolExecutor(OPEN) as pool:
            replies = list(pool.map(lambda u: fetched_text(u, timeout, checked), urls.to_pylist()))
        return pa.array([{"body": b, "error": e} for b, e in replies], _RESULT)

    kind = T.StructType().add("body", "string").add("error", "string")
    return F.arrow_udf(run, kind).asNondeterministic()(url)
