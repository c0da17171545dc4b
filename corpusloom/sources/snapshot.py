"""Site snapshots in place of fetching: rows ``url, kind, status, content_type, body``, and a data source over them.

``register(spark)`` makes ``spark.read.format("site_snapshot").option("path", ...)`` available: one task a file, with the
rules of fetching applied. Nothing is fetched from a network.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bounds on what a crawl reads of sitemaps (fixed values).
SITEMAP_LOCS, INDEX_CHILDREN, SITEMAP_CANDIDATES, SITEMAP_STOP, SITEMAP_FILE_STOP = 1200, 10, 6, 200, 500


def fetched(snapshot: DataFrame, kind: str = "html") -> DataFrame:
    """``url, body`` of what a fetch of that kind would return: success, a body, and for pages a markup type if one is named."""
    ok = (F.col("kind") == kind) & F.col("status").between(200, 299) & F.col("body").isNotNull()
    if kind == "html":
        named = F.lower("content_type")
        ok = ok & (named.isNull() | (named == "") | named.contains("html"))
    return snapshot.where(ok).select("url", "body")


def sitemap_locs(xml: Column, most: int = SITEMAP_LOCS) -> Column:
    """The addresses in a sitemap, as written."""
    return F.slice(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), 1, most)


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike("(?i)<sitemapindex")


def robots_sitemaps(robots: Column) -> Column:
    """The sitemaps a robots file names."""
    return F.regexp_extract_all(robots, F.lit(r"(?im)^sitemap:[ \t]*(\S+)[ \t]*\r?$"), F.lit(1))


class SiteSnapshot(DataSource):
    """Snapshot files as pages: options ``path`` (folder or glob of Parquet files) and ``kind``."""

    @classmethod
    def name(cls) -> str:
        return "site_snapshot"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "html")

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.parquet"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(f) for f in files]

    def read(self, partition):
        import pyarrow.parquet as pq

        for batch in pq.ParquetFile(partition.value).iter_batches(columns=["url", "kind", "status", "content_type", "body"]):
            for url, kind, status, content_type, body in zip(*(c.to_pylist() for c in batch.columns)):
                named = (content_type or "").lower()
                if kind == self.kind and status is not None and 200 <= status < 300 and body is not None and (kind != "html" or not named or "html" in named):
                    yield url, body


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SiteSnapshot)
