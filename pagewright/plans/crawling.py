"""A whole crawl over a page source, level by level: frontier, robots, politeness, fetch, extract, heal, discover links.

A level is one set of DataFrame operations over all its pages, so depth, not the number of pages, decides how many jobs run;
the levels that are kept are cut off through the shared folder. Pages of a level are taken in the order of a first-in,
first-out queue wherever order matters: which address is accepted under the cap, which page pays for a repair.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pagewright.functions import dom
from pagewright.functions.urls import canonical, origin
from pagewright.operators import crawl, extract, metrics, robots, stateful
from pagewright.plans.program import read_program
from pagewright.plans.proposer import heal
from pagewright.sources.sitemaps import walk_sitemaps
from pagewright.sources.tables import cut


class AuditLog:
    """Append-only events, kept in order; ``path`` names a file of JSON lines that every event is added to as well."""

    def __init__(self, path: str | None = None, now: Callable[[], datetime] | None = None):
        self.path, self.rows, self.now = path, [], now or (lambda: datetime.now(timezone.utc))

    def record(self, event: dict) -> None:
        if event.get("kind") not in metrics.AUDIT_KINDS:
            raise ValueError(f"unknown audit kind {event.get('kind')}")
        row = {"at": self.now().isoformat()} | event
        self.rows.append(row)
        if self.path:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(json.dumps(row) + "\n")

    def counts(self) -> dict[str, int]:
        return {k: sum(r["kind"] == k for r in self.rows) for k in metrics.AUDIT_KINDS}

    def jsonl(self) -> str:
        return "\n".join(map(json.dumps, self.rows))

    def secrets(self, provider, reason: str):
        """``provider`` with every secret that it gives told to the log, by name; what it does not have is no access."""
        log = self

        class Audited:
            def get(self, name: str) -> str | None:
                value = provider.get(name)
                if value is not None:
                    log.record({"kind": "secret-accessed", "secret_name": name, "provider_label": type(provider).__name__, "reason": reason})
                return value

            def __getattr__(self, name):
                return getattr(provider, name)

        return Audited()


@dataclass
class Crawl:
    """What a crawl found. ``visits``: url, canonical_key, depth, arrival, status; the other tables as their names say."""

    outcomes: DataFrame
    visits: DataFrame
    skipped: DataFrame
    failures: DataFrame
    program: dict
    repairs: dict = field(default_factory=dict)
    likely_redesign: bool = False
    aborted: bool = False


FRONTIER = "url string, canonical_key string, depth int, arrival long"


def crawl_site(
    spark: SparkSession, pages: DataFrame, entry: str, value: dict, *, scope: str = "section", max_pages: int = 50, max_depth: int = 3, seeds: list[str] = (), robots_files: DataFrame | None = None,
    policy: str = "respect", user_agent: str = "pagewright/1.0", follow_links: bool = True, proposer=None, repair_budget: int = 20, audit: AuditLog | None = None, auth: dict | None = None,
    stop: Callable[[], bool] | None = None,
) -> Crawl:
    """Crawl ``pages`` (url, status, body; null status: no answer) from ``entry``.

    Addresses are fetched by their canonical form. Pages that robots rules forbid are skipped, statuses from 400 on and
    missing answers are failures. Required fields that fail are repaired while the budget lasts, and the healed program goes
    on to the pages after; nothing is repaired once half of four or more pages fail. ``auth``: secret_name, header_names and
    auth_type of the credentials that are sent, for the log. ``stop`` is asked before every level.
    """
    audit = audit or AuditLog()
    body = pages.select(canonical(F.col("url")).alias("canonical_key"), F.struct("status", "body").alias("page")).filter("canonical_key IS NOT NULL").groupBy("canonical_key").agg(F.max("page").alias("page"))
    files = robots_files if robots_files is not None else spark.createDataFrame([], "origin string, text string")
    first = [entry, *[s for s in seeds if s != entry]]
    level_in = spark.createDataFrame([("c", u, 0, i) for i, u in enumerate(first)], "crawl string, url string, depth int, arrival long")
    seen = spark.createDataFrame([], "crawl string, canonical_key string")
    done: dict[str, list[DataFrame]] = {k: [] for k in ("outcomes", "visits", "skipped", "failures")}
    repairs, failing, total, redesign, aborted, left = {"repaired": 0, "failed": 0, "exhausted": 0}, 0, 0, False, False, repair_budget
    for depth in range(max_depth + 1):
        offered = cut(crawl.enqueue(level_in, F.lit(entry), F.lit(scope), max_depth, max_pages, ["crawl"], seen))
        done["skipped"].append(offered.filter("reject_reason IS NOT NULL AND reject_reason <> 'duplicate'").select("url", F.col("reject_reason").alias("reason")))
        taken = offered.filter("reject_reason IS NULL")
        # At most max_pages addresses are left, so one task may number them.
        level = taken.select("url", "canonical_key", "depth", F.row_number().over(W.orderBy("arrival")).cast("long").alias("arrival"))
        level = cut(level)
        if level.isEmpty():
            break
        if stop is not None and stop():
            aborted = True
            done["skipped"].append(spark.createDataFrame([("(remaining)", "aborted")], "url string, reason string"))
            break
        seen = seen.unionByName(level.select(F.lit("c").alias("crawl"), "canonical_key"))  # levels are written once each
        decided = cut(robots.robots_decision(level, files, user_agent, policy))
        done["skipped"].append(decided.filter("decision = 'skip'").select("url", F.lit("robots-disallow").alias("reason")))
        for r in decided.filter("decision = 'bypass'").select("url", "rule").orderBy("url").collect():  # max_pages rows at most
            audit.record({"kind": "robots-bypass", "url": r.url, "policy": policy, "rule": r.rule})
        fetched = cut(decided.filter("decision <> 'skip'").join(body, "canonical_key", "left").select("url", "canonical_key", "depth", "arrival", "page.status", "page.body"))
        for r in fetched.filter("status IS NOT NULL").select("url", "status").orderBy("arrival").collect() if auth else ():
            audit.record({"kind": "auth-attached", "url": r.url} | auth)
        for r in fetched.filter("status IN (401, 403)").select("url", "status").orderBy("arrival").collect():
            audit.record({"kind": "http-auth-failure", "url": r.url, "status": r.status})
        wrong = F.when(F.col("status").isNull(), "network").when(F.col("status") >= 400, F.concat(F.lit("http-"), F.col("status").cast("string")))
        done["failures"].append(fetched.select("url", wrong.alias("error")).filter("error IS NOT NULL"))
        done["visits"].append(fetched.select("url", "canonical_key", "depth", "arrival", "status"))
        good = fetched.filter("status < 400").select("arrival", "depth", F.col("arrival").alias("page_id"), "url", "body")
        cleaned = cut(good.join(extract.page_struct(good, "body").select("page_id", "html"), "page_id"))
        outcomes = cut(extract.execute(cleaned, read_program(value)))
        marks = outcomes.groupBy("page_id").agg(F.max(~F.col("ok")).alias("failing")).agg(F.count(F.lit(1)).alias("n"), F.count_if("failing").alias("bad")).first()
        total, failing = total + marks.n, failing + marks.bad
        redesign = redesign or (total >= 4 and 2 * failing >= total)
        if proposer is not None and marks.bad and not redesign:
            bad = outcomes.filter("NOT ok AND required").groupBy("template_id", "field_name").agg(F.min("page_id").alias("page_id"))
            bad = bad.join(cleaned.select("page_id", "html"), "page_id").orderBy("page_id", "template_id", "field_name").collect()  # a row a field of the program
            value, what = heal(proposer, value, [(r.template_id, r.field_name, r.html or "") for r in bad], left)
            left -= what["repaired"] + what["failed"]
            repairs = {k: repairs[k] + what[k] for k in repairs}
            if what["repaired"]:
                outcomes = cut(extract.execute(cleaned, read_program(value)))
        done["outcomes"].append(outcomes.withColumn("depth", F.lit(depth)))
        if not follow_links or depth == max_depth:
            break
        links = extract.distinct_links(extract.page_links(good, "body"))
        level_in = links.select(F.lit("c").alias("crawl"), "url", F.lit(depth + 1).alias("depth"), (F.col("page_id") * 1_000_000 + F.col("pos")).alias("arrival"))
    union = lambda name, schema: _union(spark, done[name], schema)
    shape = done["outcomes"][0].schema if done["outcomes"] else T.StructType([])
    return Crawl(union("outcomes", shape), union("visits", FRONTIER + ", status int"), union("skipped", "url string, reason string"), union("failures", "url string, error string"), value, repairs, redesign, aborted)


def _union(spark: SparkSession, parts: list[DataFrame], schema) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out if out is not None else spark.createDataFrame([], schema)


def discover(spark: SparkSession, pages: DataFrame, entry: str, least: float = 0.3) -> DataFrame:
    """key, url, source of what a site offers beyond links: the addresses of its sitemaps (those that its robots file names, else
    /sitemap.xml), the usual documentation paths that answer, and links of the homepage that look like documentation and
    stay on the site. ``pages``: url, status, body."""
    site = spark.createDataFrame([(entry,)], "entry string").select(origin(F.col("entry")).alias("origin"))
    here = pages.withColumn("origin", origin(F.col("url"))).join(site, "origin", "left_semi")
    answers = here.filter("status BETWEEN 200 AND 299")
    named = robots.sitemaps(robots.robots_lines(answers.filter(F.col("url") == F.concat("origin", F.lit("/robots.txt"))).select("origin", F.col("body").alias("text"))))
    usual = site.select("origin", F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap_url"))
    starts = named.unionByName(usual.join(named.select("origin"), "origin", "left_anti")).select(F.col("sitemap_url").alias("url"))
    listed = walk_sitemaps(starts, answers.select("url", F.col("body").alias("xml"))).select(F.col("loc").alias("url"), F.lit("sitemap").alias("source"), F.lit(0).cast("long").alias("ord"))
    probes = crawl.probe_paths(site).join(here.select("url", "status", "body"), "url")
    probes = probes.filter(crawl.probe_resolved(F.col("status"), F.col("body"))).select("url", F.lit("probe").alias("source"), F.col("ord").cast("long").alias("ord"))
    home = answers.filter(F.col("url").isin(entry) | (F.col("url") == F.concat("origin", F.lit("/")))).select(F.lit(1).cast("long").alias("page_id"), "url", "body")
    nav = crawl.nav_links(extract.page_links(home, "body"), least).withColumn("origin", origin(F.col("url"))).join(site, "origin", "left_semi")
    nav = nav.select("url", F.lit("nav").alias("source"), F.xxhash64("url").alias("ord"))
    return crawl.merge_discovered(listed.unionByName(probes).unionByName(nav)).select("key", "url", "source")


def next_pages(pages: DataFrame, pagination: dict, html: str = "html") -> DataFrame:
    """page_id, url of the page that follows, by the rule of a program: ``next-link`` (a link's target) or ``cursor`` (a value of
    the page as a parameter of its address). Pages without one have no row; numbered rules need no page, see ``page_urls``."""
    kind, locator = pagination["type"], pagination.get("locator", "")
    if kind not in ("next-link", "cursor"):
        raise ValueError(f"{kind} does not follow from a page")
    param = pagination.get("param")

    def each(batches):
        import pandas as pd
        from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

        find = dom.compile_locator(locator)
        for batch in batches:
            rows = []
            for i, url, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                found = find(dom.parse_html(page if isinstance(page, str) else None))
                if not found or not url:
                    continue
                node = found[0]
                if kind == "next-link":
                    target = dom.resolve_url(node.attrs["href"], url) if node.attrs.get("href") else None
                else:
                    value = node.attrs.get("data-cursor") or node.attrs.get("value") or dom.text_of(node)
                    u = urlsplit(url)
                    query = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k != param] + [(param, value)]
                    target = urlunsplit(u._replace(query=urlencode(query), fragment="")) if value else None
                if target and target != url:
                    rows.append((i, target))
            yield pd.DataFrame(rows, columns=["page_id", "url"])

    return pages.select("page_id", "url", F.col(html).alias("html")).mapInPandas(each, "page_id long, url string")


def polite(requests: DataFrame, gap_ms: int = 200, slots: int = 2, base_ms: int = 1000, most_ms: int = 60_000) -> DataFrame:
    """``requests`` (origin, seq, ms, status, retry_after_ms, crawl_delay_ms) with start_ms and end_ms of each, as the gate lets
    them go: at most ``slots`` of an origin at a time, ``gap_ms`` (or the longer crawl delay) after the last one that ended, and
    not before the cool-down of a 429, a 503 or no answer is over (Retry-After, else twice as long for every failure in a
    row). The queue of an origin in a crawl is as long as the crawl's cap, which bounds what one task gets."""

    def each(batch):
        import pandas as pd

        gate, rows = stateful.Gate(gap_ms, slots, base_ms, most_ms), []
        for r in batch.sort_values("seq").itertuples():
            number = lambda x: None if x is None or x != x else x
            rows.append((r.origin, int(r.seq), *gate.go(number(r.ms) or 0, number(r.status), number(r.retry_after_ms), number(r.crawl_delay_ms) or 0)))
        return pd.DataFrame(rows, columns=["origin", "seq", "start_ms", "end_ms"])

    return requests.select("origin", "seq", "ms", "status", "retry_after_ms", "crawl_delay_ms").groupBy("origin").applyInPandas(each, "origin string, seq long, start_ms long, end_ms long")
