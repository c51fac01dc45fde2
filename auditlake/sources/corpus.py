"""Page corpora on disk to canonical page tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages; unused columns (the markup above all) are pruned at the scan (A1)."""
    return spark.read.parquet(path)


def canonical_pages(pages: DataFrame) -> DataFrame:
    """One ``(page_id, url, site_id)`` row per canonical URL: the smallest page id wins.

    Narrow on purpose: the markup stays out of the shuffle. Join it back on
    ``page_id`` after it has been reduced to element rows.
    """
    keyed = pages.select("page_id", U.canonical(F.col("url")).alias("url")).filter(F.col("url").isNotNull())
    first = keyed.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return first.select("page_id", "url", U.bare_host(F.col("url")).alias("site_id"))


def sites_of(pages: DataFrame) -> DataFrame:
    """Site targets implied by a page table, one per bare host."""
    return pages.groupBy("site_id").agg(F.min(U.origin(F.col("url"))).alias("base_url"))
