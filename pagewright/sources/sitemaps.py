"""Sitemaps: bodies that may be packed, their entries, and the walk through sitemap indexes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.urls import sitemap_key
from pagewright.sources.tables import cut


@F.pandas_udf(T.BinaryType())
def _packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import gzip

    for batch in texts:
        yield pd.Series([None if x is None else gzip.compress(x.encode("utf-8"), 1, mtime=0) for x in batch], dtype=object)


@F.pandas_udf(T.StringType())
def _decoded(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import gzip

    def text(x):
        try:
            return (gzip.decompress(x) if x[:2] == b"\x1f\x8b" else x).decode("utf-8", "replace")
        except (OSError, EOFError, TypeError):
            return None

    for batch in bodies:
        yield pd.Series([None if x is None else text(bytes(x)) for x in batch], dtype=object)


def packed(c) -> Column:
    return _packed(c)


def decoded(c) -> Column:
    """Text of a body, unpacked if it is gzip (by its first bytes); null if it can't be read."""
    return _decoded(c)


def sitemap_entries(files: DataFrame, xml: str) -> DataFrame:
    """Other columns, loc, lastmod of every ``url`` of sitemaps; text that is no XML has none."""
    good = F.rlike(F.coalesce(F.col(xml), F.lit("")), F.lit(r"(?s)<urlset\b.*</urlset>"))
    locs = F.xpath(F.col(xml), F.lit("/urlset/url/loc/text()"))
    mods = F.xpath(F.col(xml), F.lit("/urlset/url/lastmod/text()"))
    zipped = F.when(good, F.arrays_zip(locs.alias("loc"), F.when(F.size(mods) == F.size(locs), mods).otherwise(F.array_repeat(F.lit(None).cast("string"), F.size(locs))).alias("lastmod")))
    rest = [c for c in files.columns if c != xml]
    out = files.select(*rest, F.explode(zipped).alias("e")).select(*rest, F.trim("e.loc").alias("loc"), F.trim("e.lastmod").alias("lastmod"))
    return out.filter("loc <> ''")


def index_entries(files: DataFrame, xml: str) -> DataFrame:
    """Addresses of the sitemaps that an index names."""
    good = F.rlike(F.coalesce(F.col(xml), F.lit("")), F.lit(r"(?s)<sitemapindex\b.*</sitemapindex>"))
    rest = [c for c in files.columns if c != xml]
    return files.select(*rest, F.explode(F.when(good, F.xpath(F.col(xml), F.lit("/sitemapindex/sitemap/loc/text()")))).alias("loc")).withColumn("loc", F.trim("loc"))


def walk_sitemaps(seeds: DataFrame, files: DataFrame, max_depth: int = 3) -> DataFrame:
    """loc, lastmod, depth of all addresses that sitemaps reach from ``seeds`` (url) through ``files`` (url, xml): indexes
    are followed to ``max_depth``, no sitemap is read twice, an address counts once."""
    level = cut(seeds.select("url").distinct())
    seen, found = level, None
    for depth in range(max_depth + 1):
        here = level.join(files, "url")
        entries = sitemap_entries(here.select("xml"), "xml").withColumn("depth", F.lit(depth))
        found = entries if found is None else found.unionByName(entries)
        level = cut(index_entries(here.select("xml"), "xml").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)  # levels are written once each
    return found.groupBy(sitemap_key(F.col("loc")).alias("key")).agg(F.min_by(F.struct("loc", "lastmod", "depth"), F.struct("depth", "loc")).alias("e")).select("key", "e.*")
