"""Sitemap XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "url array<struct<loc:string>>"


def sitemap_urls(xml: Column) -> Column:
    """Array of the non-null ``urlset/url/loc`` texts of a sitemap.

    Null for null and malformed text; empty for other documents, a sitemap index among them.
    """
    broken = "corrupt"
    read = F.from_xml(xml, f"{SCHEMA}, {broken} string", {"rowTag": "urlset", "columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE"})
    urls = F.filter(F.transform(read["url"], lambda u: F.trim(u["loc"])), lambda u: u.isNotNull() & (u != ""))
    wanted = F.coalesce(urls, F.array().cast("array<string>"))
    return F.when(xml.isNotNull() & read[broken].isNull(), wanted)


def sitemap_rows(df: DataFrame, xml_column: str, *keep: str) -> DataFrame:
    """A row per address of each sitemap: the columns ``keep``, then url. Malformed sitemaps give none."""
    return df.select(*(F.col(f"`{c}`") for c in keep), F.explode(sitemap_urls(F.col(f"`{xml_column}`"))).alias("url"))
