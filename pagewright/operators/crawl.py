"""The crawl as set operations: frontier, discovery, link graph, fetch ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.functions.urls import canonical, discovery_key, doc_likeness, keys_in_scope, origin
from pagewright.sources.tables import cut

# Paths under which sites keep their documentation.
DOC_PATHS = ["/docs", "/doc", "/documentation", "/api", "/api-docs", "/api-reference", "/reference", "/guide", "/guides", "/manual", "/handbook", "/help", "/learn", "/tutorials", "/developers"]
PRIORITY = {"sitemap": 0, "probe": 1, "nav": 2}


def enqueue(candidates: DataFrame, entry: Column, scope: Column, max_depth: int | Column, max_pages: int, per: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Candidates (``url``, ``depth``, ``arrival``, and the columns ``per`` that tell crawls apart) with canonical_key and
    reject_reason: malformed, out-of-scope, past-max-depth, duplicate, past-max-pages, or null for those that are accepted.

    Checks come in this order. Only what is accepted is seen: an address that the cap refused is refused for the cap again.
    The cap counts what a crawl has accepted before (``seen``: ``per``, canonical_key) too. Candidates of equal arrival stand
    in one row's place; arrivals must be distinct within a crawl. A crawl or key that is null is one of its own.

    The candidates are written once with their keys. First arrivals are a partial aggregate; the last arrival under the cap
    comes from a top-k per crawl that every task cuts to the cap before anything is shuffled, so no hot crawl is gathered.
    """
    d = candidates.withColumn("canonical_key", canonical(F.col("url"))).withColumn("entry_key", canonical(entry))
    d = d.withColumn("in_scope", keys_in_scope(F.col("canonical_key"), F.col("entry_key"), scope)).drop("entry_key")
    early = F.when(F.col("canonical_key").isNull(), "malformed").when(~F.coalesce("in_scope", F.lit(False)), "out-of-scope").when(F.col("depth") > max_depth, "past-max-depth")
    d = cut(d.withColumn("early", early).drop("in_scope"))
    first = d.filter("early IS NULL").groupBy(*per, "canonical_key").agg(F.min("arrival").alias("first_arrival"))
    room = F.lit(max_pages).cast("long")
    if seen is not None:
        seen = seen.select(*per, "canonical_key").distinct()
        used = seen.groupBy(*per).agg(F.count(F.lit(1)).alias("used"))
        known = seen.withColumn("known", F.lit(True))
        first = null_safe(first, known, [*per, "canonical_key"]).withColumn("known", F.coalesce("known", F.lit(False)))
        first = null_safe(first, used, per).withColumn("room", room - F.coalesce("used", F.lit(0))).drop("used")
    else:
        first = first.withColumn("known", F.lit(False)).withColumn("room", room)
    kept = first.filter(~F.col("known")).withColumn("place", F.row_number().over(W.partitionBy(*per).orderBy("first_arrival"))).filter(F.col("place") <= max_pages)
    kept = kept.filter(F.col("place") <= F.col("room"))
    # Seen before, or accepted now: (key, the arrival that was accepted, none for what was seen before).
    taken = kept.select(*per, "canonical_key", F.col("first_arrival").alias("accepted"))
    if seen is not None:
        taken = taken.unionByName(first.filter("known").select(*per, "canonical_key", F.lit(None).cast(first.schema["first_arrival"].dataType).alias("accepted")))
    d = null_safe(d, taken.withColumn("taken", F.lit(True)), [*per, "canonical_key"])
    # A key is accepted at its first arrival or never, so every later arrival of an accepted one is a duplicate.
    late = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("taken").isNull(), "past-max-pages").when(~F.col("arrival").eqNullSafe(F.col("accepted")), "duplicate")
    return d.withColumn("reject_reason", late).drop("early", "accepted", "taken")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys in which null equals null; the keys stand once in the result."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return left.join(right, on, "left").drop(*[f"_r_{k}" for k in keys])


def crawl_levels(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: breadth-first search from ``seeds`` (node) over ``edges`` (src, dst), the least depth of every node
    reached. Each level is an anti-join against the levels before, each of which is written once through the shared folder."""
    level = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for depth in range(1, max_depth + 1):
        found = level.join(edges, level["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        level = cut(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def merge_discovered(candidates: DataFrame) -> DataFrame:
    """One row per URL (``url``, ``source``, ``ord``): from the sitemap before a probe before navigation, then the first."""
    order = F.struct(F.coalesce(*[F.when(F.col("source") == s, F.lit(p)) for s, p in PRIORITY.items()], F.lit(9)), "ord", "url")
    best = candidates.withColumn("key", discovery_key(F.col("url"))).groupBy("key").agg(F.min_by(F.struct("url", "source", "ord"), order).alias("b"))
    return best.select("key", "b.*")


def probe_paths(sites: DataFrame) -> DataFrame:
    """origin, path, url: every usual documentation path of every site (``origin``)."""
    return sites.select("origin", F.posexplode(F.array(*[F.lit(p) for p in DOC_PATHS])).alias("ord", "path")).withColumn("url", F.concat("origin", "path"))


def probe_resolved(status: Column, body: Column, least: int = 256) -> Column:
    return F.coalesce(status.between(200, 299) & (F.length(body) >= least), F.lit(False))


def nav_links(links: DataFrame, least: float = 0.0) -> DataFrame:
    """page_id, url, text, region, score: each link of a page once, from its most telling region, best first."""
    rank = F.when(F.col("region") == "nav", 0).when(F.col("region") == "header", 1).when(F.col("region") == "footer", 2).otherwise(3)
    one = links.groupBy("page_id", "url").agg(F.min_by(F.struct("text", "region", "pos"), F.struct(rank, "pos")).alias("b")).select("page_id", "url", "b.*")
    return one.withColumn("score", doc_likeness(F.col("url"), F.col("text"), F.col("region"))).filter(F.col("score") >= least)


def auto_tier(status: Column, body: Column, fingerprints: list[str]) -> Column:
    """struct(tier, reason): whether the plain fetch will do, or a browser has to look."""
    whole = F.forall(F.array(*[F.lit(f) for f in fingerprints]), lambda f: F.contains(F.coalesce(body, F.lit("")), f)) if fingerprints else F.lit(True)
    blocked = status.isin(401, 403, 429, 503)
    reason = F.when(status.isNull(), "t0-error").when(blocked, "t0-blocked").when(status >= 400, "t0-ok").when(whole, "t0-ok").otherwise("missing-fingerprint")
    return F.struct(F.when(reason == "t0-ok", "static").otherwise("headless").alias("tier"), reason.alias("reason"))


def page_urls(template: str, start: int, end: int) -> list[str]:
    """URLs of numbered pagination."""
    return [template.replace("{page}", str(i)) for i in range(start, end + 1)]


def same_origin(links: DataFrame, base: str = "base") -> DataFrame:
    return links.filter(origin(F.col("url")) == origin(F.col(base)))
