"""The crawl as one resumable batch (R1 to R3): over fetched text, and from addresses to tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators import ingest
from platewise.operators.numbering import numbered
from platewise.sources import fetch, sitemaps
from platewise.stage import written


class UnreadSitemap(RuntimeError):
    """Sitemap indexes that couldn't be fetched or are no sitemaps."""


def import_sitemap(frontier: DataFrame, fetched: DataFrame) -> DataFrame:
    """New frontier rows (url, completed=false) from fetched sitemap index texts (id, xml), first listing first."""
    listed = sitemaps.sitemap_rows(fetched, "xml", "id")
    return ingest.absent(listed, frontier).select("url", F.lit(False).alias("completed"))


def _whole(listed: DataFrame, reached: DataFrame) -> DataFrame:
    """(url) of the sitemaps in ``listed`` all of whose pages are in ``reached`` (url).

    ``listed`` is (sitemap_url, url), url null where a sitemap lists no page. A page that isn't reached holds back every
    sitemap that lists it.
    """
    short = listed.filter("url is not null").join(reached.select("url").distinct(), "url", "left_anti").select("sitemap_url").distinct()
    return listed.select("sitemap_url").distinct().join(short, "sitemap_url", "left_anti").select(F.col("sitemap_url").alias("url"))


def import_pages(frontier: DataFrame, fetched: DataFrame, staging: DataFrame, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What one run adds to staging, and the frontier after it.

    ``fetched`` is (id, sitemap_url, url, html): pages of the frontier's addresses, html null where fetching failed. Only
    unfinished addresses are worked on, and only those become completed all of whose pages were fetched or are in staging.
    Their pages are the rows of ``listed`` (sitemap_url, url; url null for a sitemap without pages), or without it those of
    ``fetched``. A failed run leaves the frontier as it was, and running again adds nothing twice, as staging takes an
    address once.
    """
    todo = ingest.unfinished(frontier).select(F.col("url").alias("sitemap_url")).distinct()
    pages = fetched.join(todo, "sitemap_url", "left_semi")
    new = ingest.absent(ingest.staged(pages), staging)
    lists = pages if listed is None else listed.join(todo, "sitemap_url", "left_semi")
    reached = pages.filter("html is not null").select("url").unionByName(staging.select("url"))
    return new, ingest.finished(frontier, _whole(lists.select("sitemap_url", "url"), reached))


def _identified(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with an id that goes on from the largest in ``table``."""
    last = table.agg(F.max("id")).first()[0] or 0
    return numbered(rows, "url", name="__n").withColumn("id", F.col("__n") + last + 1).drop("__n")


def add_sitemaps(spark: SparkSession, urls: Iterable[str], frontier: str) -> None:
    """Fetch sitemap indexes and append what they list to the table at ``frontier``, an address at most once.

    If any can't be fetched or read, ``UnreadSitemap`` names them and nothing is appended.
    """
    existing = ingest.opened(spark, frontier, ingest.FRONTIER)
    indexes = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "id long, url string")
    texts = written(indexes.select("id", "url", fetch.fetched(F.col("url")).alias("f")).select("id", "url", F.col("f.body").alias("xml"), "f.error"), "crawl-indexes")
    # A row for each of the caller's addresses.
    failed = texts.filter(F.col("xml").isNull() | sitemaps.sitemap_urls(F.col("xml")).isNull()).select("url", "error").collect()
    if failed:
        raise UnreadSitemap("; ".join(f"{r['url']}: {r['error'] or 'no sitemap'}" for r in failed))
    new = import_sitemap(existing, texts.select("id", "xml"))
    ingest.append(_identified(new, existing).select("id", "url", "completed"), frontier)


def run(spark: SparkSession, frontier: str, staging: str, partitions: int = 4) -> DataFrame:
    """One run over the table at ``frontier``: unfinished sitemaps are fetched, their pages that staging lacks are
    fetched and staged, and sitemaps that could be read, and all of whose pages could be fetched, become completed.

    Gives (url, error) of the sitemaps and pages that failed; the next run tries them again. ``partitions`` bounds how many tasks
    fetch at a time. What was fetched is written first, so that nothing is fetched twice.
    """
    sitemaps_table = ingest.opened(spark, frontier, ingest.FRONTIER)
    existing = ingest.opened(spark, staging, ingest.STAGING)
    todo = ingest.unfinished(sitemaps_table).select("url").distinct().repartition(partitions)
    texts = written(todo.select("url", fetch.fetched(F.col("url")).alias("f")).select("url", F.col("f.body").alias("xml"), "f.error"), "crawl-sitemaps")
    read = texts.select("url", sitemaps.sitemap_urls(F.col("xml")).alias("pages"), "error")
    listed = read.filter("pages is not null").select(F.col("url").alias("sitemap_url"), F.explode_outer("pages").alias("url"))
    wanted = listed.filter("url is not null").select("url").distinct().join(existing.select("url").distinct(), "url", "left_anti")
    replies = wanted.repartition(partitions).select("url", fetch.fetched(F.col("url"), checked=False).alias("f"))
    pages = written(replies.select("url", F.col("f.body").alias("html"), "f.error"), "crawl-pages")
    reached = pages.filter("html is not null")
    new = ingest.staged(reached.select(F.lit(0).cast("long").alias("id"), "url", "html")).drop("id")
    ingest.append(_identified(new, existing).select("id", "url", "name", "data"), staging)
    ingest.replace(ingest.finished(sitemaps_table, _whole(listed, reached.select("url").unionByName(existing.select("url")))), frontier)
    unread = read.filter("pages is null").select("url", F.coalesce("error", F.lit("no sitemap")).alias("error"))
    return unread.unionByName(pages.filter("html is null").select("url", "error"))
