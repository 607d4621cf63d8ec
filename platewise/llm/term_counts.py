"""How often every distinct term occurs, and in how many records, by last-seen counters.

The terms of one record lie together in the scan, so a task meets terms ordered by record. Per term it keeps the
occurrences, the records, and the last record that held it; a record is counted when it differs from the last
one. No record needs a set, counts of one task are partial sums, and one small shuffle by term adds them up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.stage import written

#: Terms that a task holds before it passes its counters on and starts anew.
HELD = 200_000
COUNTS = "field string, term string, occurrences long, records long"


def last_seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (field, term, occurrences, records) of (field, terms) records; the null term counts the records."""
    seen: dict[tuple[str, str | None], list[int]] = {}
    record = 0

    def flush() -> pa.RecordBatch:
        keys, counters = list(seen), list(seen.values())
        seen.clear()
        columns = [[k[0] for k in keys], [k[1] for k in keys], [c[0] for c in counters], [c[1] for c in counters]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["field", "term", "occurrences", "records"])

    for batch in batches:
        for field, terms in zip(batch.column("field").to_pylist(), batch.column("terms").to_pylist()):
            if not terms:
                continue
            record += 1
            for term in (None, *terms):
                counter = seen.get((field, term))
                if counter is None:
                    seen[field, term] = [1, 1, record]
                    continue
                counter[0] += 1
                if counter[2] != record:
                    counter[1] += 1
                    counter[2] = record
            if len(seen) >= HELD:  # between records, so that no record is counted twice
                yield flush()
    if seen:
        yield flush()


def term_counts(records: DataFrame) -> DataFrame:
    """(field, term, occurrences, records, n): a row per distinct term of (field, terms).

    Each row of ``records`` is one record, repeated rows too; null and empty arrays are none, and terms must not be
    null. n is the number of the field's records with any term.
    """
    partial = records.select("field", "terms").mapInArrow(last_seen, COUNTS)
    counts = partial.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    # A stage, as the sizes and the terms are both taken from it, and the collection is read once.
    counts = written(counts, "term-counts")
    # A row per field, of which the query names a few.
    sizes = counts.filter("term is null").select("field", F.col("records").alias("n"))
    return counts.filter("term is not null").join(F.broadcast(sizes), "field")


def marked(counts: DataFrame, rare: int = 2, common: int = 10) -> DataFrame:
    """(field, term, mark): 'rare' for terms in at most ``rare`` records, 'common' for those in more than one in
    ``common``; a term that is both (in a tiny table) has both rows."""
    marks = F.array_compact(F.array(F.when(F.col("records") <= rare, F.lit("rare")), F.when(F.col("records") * common > F.col("n"), F.lit("common"))))
    return counts.select("field", "term", F.explode(marks).alias("mark"))
