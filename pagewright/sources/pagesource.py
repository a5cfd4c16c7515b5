"""Pages as a Spark data source: ``spark.read.format("pagewright_pages")`` over a snapshot folder, with the fetch rules.

A snapshot folder has ``manifest.json``: a list of {url, file, status, headers}. Reading asks for one page after another as
a client would: failures of the network and statuses from 500 on are tried again, 4xx never, and the last answer counts.
"""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, status int, headers map<string,string>, body string, tier string, attempts int, error string"


class _Share(InputPartition):
    def __init__(self, entries):
        self.entries = entries


class SnapshotReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.shares = options["path"], int(options.get("partitions", "8"))
        self.retries = int(options.get("maxretries", options.get("maxRetries", "2")))

    def partitions(self):
        with open(os.path.join(self.path, "manifest.json"), encoding="utf-8") as f:
            entries = json.load(f)
        return [_Share(entries[i :: self.shares]) for i in range(min(self.shares, max(1, len(entries))))]

    def read(self, partition):
        for e in partition.entries:
            statuses = e["status"] if isinstance(e.get("status"), list) else [e.get("status", 200)]
            tries = 0
            for status in statuses[: self.retries + 1]:
                tries += 1
                if status is not None and status < 500:
                    break
            body, error = None, None if status is not None else "network"
            if status is not None and e.get("file"):
                try:
                    with open(os.path.join(self.path, e["file"]), encoding="utf-8", errors="replace", newline="") as f:
                        body = f.read()
                except OSError as x:
                    status, error = None, type(x).__name__
            headers = {k.lower(): v for k, v in (e.get("headers") or {}).items()}
            yield (e["url"], e.get("final_url", e["url"]), status, headers, body, e.get("tier", "static"), tries, error)


class PageSource(DataSource):
    """The registered source."""

    @classmethod
    def name(cls):
        return "pagewright_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SnapshotReader(self.options)


def read_pages(spark, path: str, partitions: int = 8):
    spark.dataSource.register(PageSource)
    return spark.read.format("pagewright_pages").option("path", path).option("partitions", str(partitions)).load()


def read_fixtures(spark, path: str):
    """fixture, config, pages (text of pages.json) and html files by name, of every folder under ``path``, in order of names."""
    files = spark.read.text([f"{path}/*/*.json", f"{path}/*/*.html"], wholetext=True).selectExpr("value", "_metadata.file_path AS file")
    from pyspark.sql import functions as F

    parts = files.select(F.element_at(F.split("file", "/"), -2).alias("fixture"), F.element_at(F.split("file", "/"), -1).alias("name"), "value")
    return parts.groupBy("fixture").agg(
        F.max(F.when(F.col("name") == "config.json", F.col("value"))).alias("config"), F.max(F.when(F.col("name") == "pages.json", F.col("value"))).alias("pages"),
        F.map_from_entries(F.collect_list(F.when(F.endswith("name", F.lit(".html")), F.struct("name", "value")))).alias("html"),
    ).orderBy("fixture")
