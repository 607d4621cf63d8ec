"""Staging as a stream of arriving pages: micro-batches through the same insert-if-absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from platewise.operators import ingest

PAGES = "id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files of (id, url, html) that arrive in ``folder``."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def into_staging(pages: DataFrame, staging: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Add each micro-batch of recipe pages to the table at ``staging``, an address at most once.

    A batch that is run again after a failure adds nothing twice, as its addresses are there already.
    """

    def add(batch: DataFrame, _: int) -> None:
        existing = ingest.opened(batch.sparkSession, staging, ingest.STAGING)
        ingest.append(ingest.absent(ingest.staged(batch), existing), staging)

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
