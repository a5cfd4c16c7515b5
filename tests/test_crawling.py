"""Crawls over a small site: caps, robots, failures, healing, redesign, cancellation; discovery, pagination, politeness."""

from datetime import datetime, timedelta, timezone

import pytest

from pagewright.operators import metrics, robots, stateful
from pagewright.plans import crawling
from pagewright.plans.proposer import RuleProposer

HOME = "https://a.test/docs/"


def program(locator="h1.title", required=True):
    return {"strategyVersion": "1.1.0", "goal": "titles", "target": {"entryUrl": HOME, "scope": "section"}, "pageTemplates": [{"id": "page", "fields": {"title": {"locators": [locator], "type": "string", "required": required}}}]}


def page(title, *links, tag='h1 class="title"'):
    return f"<html><body><main><{tag}>{title}</{tag.split()[0]}><p>{'Some text of the page. ' * 5}</p>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</main></body></html>"


def site(spark, rows):
    return spark.createDataFrame(rows, "url string, status int, body string")


def visited(done):
    return [r.url for r in done.visits.orderBy("depth", "arrival").collect()]


def reasons(done):
    return {(r.url, r.reason) for r in done.skipped.collect()}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (HOME, 200, page("Home", "/docs/a", "b", "/docs/a#again", "/blog/x", "https://b.test/", "mailto:x@y", "/docs/private/p", "/docs/gone", "/docs/lost")),
        ("https://a.test/docs/a", 200, page("A", "/docs/b", "/docs/c?utm_source=x", "/docs/")), ("https://A.test/docs/b", 200, page("B", "/docs/d")), ("https://a.test/docs/c", 200, page("C", "/docs/e")),
        ("https://a.test/docs/d", 200, page("D")), ("https://a.test/docs/e", 200, page("E", "/docs/f")), ("https://a.test/docs/gone", 404, "none"), ("https://a.test/docs/private/p", 200, page("P")), ("https://a.test/docs/auth", 403, ""),
    ]
    return site(spark, rows)


def test_levels_robots_and_failures(spark, pages):
    files = spark.createDataFrame([("https://a.test", "User-agent: *\nDisallow: /docs/private/\n")], "origin string, text string")
    log = crawling.AuditLog()
    done = crawling.crawl_site(spark, pages, HOME, program(), robots_files=files, audit=log, seeds=["https://a.test/docs/auth"], auth={"secret_name": "k", "header_names": ["authorization"], "auth_type": "bearer"})
    assert visited(done) == [HOME, "https://a.test/docs/auth", "https://a.test/docs/a", "https://a.test/docs/b", "https://a.test/docs/gone", "https://a.test/docs/lost", "https://a.test/docs/c?utm_source=x", "https://a.test/docs/d", "https://a.test/docs/e"]
    assert reasons(done) == {("https://a.test/blog/x", "out-of-scope"), ("https://b.test/", "out-of-scope"), ("https://a.test/docs/private/p", "robots-disallow")}
    assert {(r.url, r.error) for r in done.failures.collect()} == {("https://a.test/docs/gone", "http-404"), ("https://a.test/docs/lost", "network"), ("https://a.test/docs/auth", "http-403")}
    assert sorted(r.value for r in done.outcomes.filter("ok").collect()) == ["A", "B", "C", "D", "E", "Home"]
    assert log.counts()["auth-attached"] == 8 and log.counts()["http-auth-failure"] == 1 and log.counts()["robots-bypass"] == 0
    free = crawling.crawl_site(spark, pages, HOME, program(), robots_files=files, policy="warn", audit=log, max_depth=1)
    assert "https://a.test/docs/private/p" in visited(free) and log.counts()["robots-bypass"] == 1


def test_caps_and_depth(spark, pages):
    done = crawling.crawl_site(spark, pages, HOME, program(), max_pages=3)
    assert visited(done) == [HOME, "https://a.test/docs/a", "https://a.test/docs/b"]
    past = {u for u, r in reasons(done) if r == "past-max-pages"}
    assert {"https://a.test/docs/private/p", "https://a.test/docs/gone", "https://a.test/docs/c?utm_source=x", "https://a.test/docs/d"} <= past
    assert visited(crawling.crawl_site(spark, pages, HOME, program(), follow_links=False)) == [HOME]
    asked = iter([False, True])
    done = crawling.crawl_site(spark, pages, HOME, program(), stop=lambda: next(asked))
    assert done.aborted and visited(done) == [HOME] and ("(remaining)", "aborted") in reasons(done)
    done = crawling.crawl_site(spark, pages, "https://a.test/nothing", program())
    assert visited(done) == ["https://a.test/nothing"] and done.failures.first().error == "network"


def test_a_repair_serves_the_pages_after(spark):
    rows = [(HOME, 200, page("Home", "/docs/a", tag='h1 class="title-new"')), ("https://a.test/docs/a", 200, page("A", tag='h1 class="title-new"'))]
    done = crawling.crawl_site(spark, site(spark, rows), HOME, program(), proposer=RuleProposer())
    assert done.repairs == {"repaired": 1, "failed": 0, "exhausted": 0} and len(done.program["pageTemplates"][0]["fields"]["title"]["locators"]) == 2
    assert sorted(r.value for r in done.outcomes.filter("ok").collect()) == ["A", "Home"] and not done.likely_redesign
    done = crawling.crawl_site(spark, site(spark, rows), HOME, program(), proposer=RuleProposer(), repair_budget=0, max_depth=0)
    assert done.repairs["exhausted"] >= 1 and done.repairs["repaired"] == 0 and done.outcomes.filter("ok").isEmpty()


def test_a_redesign_stops_repairs(spark):
    rows = [(HOME, 200, page("Home", *[f"/docs/{i}" for i in range(4)]))] + [(f"https://a.test/docs/{i}", 200, page("X", tag='h1 class="title-new"')) for i in range(4)]
    done = crawling.crawl_site(spark, site(spark, rows), HOME, program(), proposer=RuleProposer())
    assert done.likely_redesign and done.repairs["repaired"] == 0


def test_discovery(spark):
    sitemap = "<urlset><url><loc>https://a.test/docs/one</loc></url></urlset>"
    rows = [
        ("https://a.test/", 200, '<nav><a href="/docs/one/">docs one</a><a href="/api/guide">API guide</a><a href="/imprint">imprint</a><a href="https://b.test/docs/">docs</a></nav>'),
        ("https://a.test/robots.txt", 200, "Sitemap: https://a.test/map.xml"), ("https://a.test/map.xml", 200, sitemap), ("https://a.test/handbook", 200, "x" * 300), ("https://a.test/help", 404, "x" * 300), ("https://a.test/learn", 200, "short"),
    ]
    got = {r.key: r.source for r in crawling.discover(spark, site(spark, rows), "https://a.test/").collect()}
    assert got == {"https://a.test/docs/one": "sitemap", "https://a.test/handbook": "probe", "https://a.test/api/guide": "nav"}
    assert crawling.discover(spark, site(spark, []), "https://a.test/").count() == 0


def test_pagination(spark):
    rows = [(1, "https://a.test/l?p=1", '<a rel="next" href="?p=2">next</a>'), (2, "https://a.test/l?p=2", "<p>end</p>"), (3, "https://a.test/l", '<i id="cur">x y</i>'), (4, None, None), (5, "https://a.test/s", '<a rel="next" href="/s">self</a>')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {tuple(r) for r in crawling.next_pages(df, {"type": "next-link", "locator": "a[rel=next]"}).collect()} == {(1, "https://a.test/l?p=2")}
    assert {tuple(r) for r in crawling.next_pages(df, {"type": "cursor", "locator": "#cur", "param": "c"}).collect()} == {(3, "https://a.test/l?c=x+y")}
    with pytest.raises(ValueError):
        crawling.next_pages(df, {"type": "numbered"})


def test_gate():
    g = stateful.Gate(gap_ms=200, slots=1)
    assert [g.go(50, 200), g.go(50, 429), g.go(50, 429), g.go(50, 200), g.go(50, 503, 700), g.go(10, None), g.go(10, 200)] == [(0, 50), (250, 300), (1300, 1350), (3350, 3400), (3600, 3650), (4350, 4360), (6360, 6370)]
    g = stateful.Gate(gap_ms=0, slots=2)
    assert [g.go(100, 200), g.go(40, 200), g.go(10, 200), g.go(10, 200)] == [(0, 100), (0, 40), (40, 50), (50, 60)]
    assert stateful.Gate(gap_ms=200).go(1, 200, None, 5000) == (0, 1)
    g = stateful.Gate(gap_ms=200, slots=1)
    g.go(10, 200)
    assert g.go(10, 200, None, 5000)[0] == 5010  # the site's own delay is longer


def test_polite_table(spark):
    rows = [("a", i, 50, s, None, None) for i, s in enumerate([200, 429, 200])] + [("b", 0, 10, None, None, 100), ("b", 1, 10, 200, None, 100)]
    df = spark.createDataFrame(rows, "origin string, seq long, ms int, status int, retry_after_ms long, crawl_delay_ms long")
    got = {(r.origin, r.seq): (r.start_ms, r.end_ms) for r in crawling.polite(df, slots=1).collect()}
    assert got == {("a", 0): (0, 50), ("a", 1): (250, 300), ("a", 2): (1300, 1350), ("b", 0): (0, 10), ("b", 1): (1010, 1020)}
    assert crawling.polite(df.limit(0)).count() == 0


def test_robots_expire(spark):
    now = datetime(2025, 1, 2, 12, tzinfo=timezone.utc)
    cache = spark.createDataFrame([("a", "old a", now.replace(tzinfo=None) + timedelta(hours=1)), ("b", "old b", now.replace(tzinfo=None) - timedelta(hours=1)), ("z", "z", now.replace(tzinfo=None) + timedelta(days=1))], "origin string, text string, expires_at timestamp_ntz")
    origins = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "origin string")
    answers = spark.createDataFrame([("a", 200, "new a"), ("b", 200, "new b"), ("c", 404, "not found page")], "origin string, status int, body string")
    got = {r.origin: (r.text, r.expires_at) for r in robots.refreshed(cache, origins, answers, now).collect()}
    day = now.replace(tzinfo=None) + timedelta(hours=24)
    assert got["a"][0] == "old a" and got["b"] == ("new b", day) and got["c"] == ("", day) and got["d"] == ("", day) and got["z"][0] == "z" and len(got) == 5


def test_cost_breakdown(spark):
    usage = spark.createDataFrame([("compile", 1000, 500), ("self-heal", 400, 100), ("self-heal", None, 0)], "phase string, input_tokens long, output_tokens long")
    pages = spark.createDataFrame([("static", 100), ("static", 50), ("headless", 900), (None, None)], "tier string, timing_ms long")
    records = spark.createDataFrame([(i,) for i in range(7)], "id int")
    got = {(r.part, r.name): r.amount for r in metrics.cost_breakdown(usage, pages, records).collect()}
    assert got[("calls", "self-heal")] == 2 and got[("input tokens", "compile")] == 1000 and got[("pages", "static")] == 2 and got[("pages", "unknown")] == 1 and got[("fetch ms", "all")] == 1050
    assert got[("records", "all")] == 7 and got[("records for 1,000 tokens", "all")] == 3.5
    none = {(r.part, r.name): r.amount for r in metrics.cost_breakdown(usage.limit(0), pages.limit(0), records.limit(0)).collect()}
    assert none == {("fetch ms", "all"): 0, ("records", "all"): 0, ("records for 1,000 tokens", "all"): 0}


def test_audit_log(tmp_path):
    log = crawling.AuditLog(str(tmp_path / "a.jsonl"))

    class Box:
        def get(self, name):
            return {"k": "v"}.get(name)

        def put(self, name, value):
            return name, value

    box = log.secrets(Box(), "fetch")
    assert box.get("k") == "v" and box.get("none") is None and box.put("a", "b") == ("a", "b")
    assert log.counts()["secret-accessed"] == 1 and len((tmp_path / "a.jsonl").read_text().splitlines()) == 1 and "v" not in {x for r in log.rows for x in r.values()}
    with pytest.raises(ValueError):
        log.record({"kind": "other"})
