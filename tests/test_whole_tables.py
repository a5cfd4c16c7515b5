"""Queries whose SQL can say only a part: over all rows, held against brute force on small tables."""

import random
from collections import defaultdict
from datetime import UTC, datetime
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.parquet as pq

from pagewright import catalog


def rows(spark, name, d):
    got = [tuple(r) for r in catalog.queries()[name](spark, d).collect()]
    assert len(got) == len(set(got))
    return set(got)


DATES = ["2025-02-16", " 2025-02-16\n", "2024-02-30", "2025-02-16T10:20:30Z", "2025-02-16T10:20:30.5Z", "2023-07-28T00:37:34.462873804Z", "2024-10-28T13:47:15.383+02:00", "2023-01-25T21:00:41+0000", "2024-05-23T04:02:47-0330",
         "2024-11-16T10:23-03:30", "2024-04-11T03:01", "2024-05-14T19:09:46", "2024-11-12 21:56:30", "2024-10-26 14:21", "Mon, 21 Oct 2024 13:27:44 GMT", "Sat, 25 May 2024 08:54:30 +0900", "5 May 2023 10:59:32 -0400", "29 Jun 2024", "August 15, 2025",
         "Apr 2, 2024", "2024-04-20T06:55:00[Europe/Berlin]", "TBA", "2 hours ago", "1751128822", "", None]
FORMS = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M%z", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%a, %d %b %Y %H:%M:%S GMT", "%a, %d %b %Y %H:%M:%S %z", "%d %b %Y %H:%M:%S %z", "%d %b %Y", "%B %d, %Y", "%b %d, %Y"]


def by_hand(text):
    for form in FORMS:
        try:
            m = datetime.strptime((text or "").strip().replace("462873804", "462873"), form)
        except ValueError:
            continue
        m = m.astimezone(UTC) if m.tzinfo else m
        return m.strftime("%Y-%m-%dT%H:%M:%S.") + f"{m.microsecond // 1000:03}Z"
    return None


def test_dates_of_all_forms(spark, tables):
    want = {(i, by_hand(x)) for i, x in enumerate(DATES)}
    assert sum(day is not None for _, day in want) == 19
    assert rows(spark, "ref_F8_parse_date_all", tables(outcomes=[{"outcome_id": i, "raw_text": x} for i, x in enumerate(DATES)])) == want


def test_search_takes_the_edges_of_every_line(spark, tmp_path):
    rng = random.Random(3)
    lines = [(rng.randint(1, 60), rng.randint(1, 40), rng.choice([1.0, 20.0, 45.0, 46.0, 50.0])) for _ in range(90)] + [(1, 1, 3.0)]
    pq.write_table(pa.table({"l_partkey": pa.array([x[0] for x in lines], pa.int64()), "l_suppkey": pa.array([x[1] for x in lines], pa.int64()), "l_quantity": [x[2] for x in lines]}), tmp_path / "lineitem.parquet")
    next_to = defaultdict(set)
    for part, supplier, _ in lines:
        next_to[part].add(-supplier)
        next_to[-supplier].add(part)
    depth, level = {1: 0}, {1}
    for k in (1, 2, 3):
        level = {x for n in level for x in next_to[n]} - set(depth)
        depth |= dict.fromkeys(level, k)
    assert 3 in depth.values() and len(depth) < len(next_to)
    assert rows(spark, "ref_G1_bfs_all", str(tmp_path)) == set(depth.items())


class Headings(HTMLParser):
    """(is a child of an article, text) of every h1."""

    def __init__(self):
        super().__init__()
        self.path, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "h1":
            self.found.append([self.path[-1:] == ["article"], ""])
        if tag != "br":
            self.path.append(tag)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        if "h1" in self.path:
            self.found[-1][1] += data


PAGES = ["<article><h1>Plain</h1><p>x</p></article>", "<article><h1> Caf&eacute; &amp;\n  <b>bar</b>\u00a0 &#8211; \u3000open </h1></article>", "<main><h1>Outside</h1></main>", "<div><h1>First</h1><article><p>x</p><h1>Second</h1></article></div>",
         "<h1>Beside</h1><article><h1>" + "long " * 90 + "</h1></article>", "<article><h1> </h1></article><h1>After</h1>", "<article><h1>" + "x" * 399 + "</h1></article>", "<p>none</p>", "<article><div><h1>Deep</h1></div></article>", "", None]


def title_by_hand(page):
    p = Headings()
    p.feed(page or "")
    # Each locator takes its first h1; the next one is asked if that fails the rule.
    for among in ([x for child, x in p.found if child], [x for _, x in p.found]):
        if among and 0 < len(title := " ".join(among[0].split())) < 400:
            return title
    return None


def test_titles_of_every_page(spark, tables):
    want = {(i, title_by_hand(x)) for i, x in enumerate(PAGES)}
    assert {"Café & bar – open", "Outside", "Second", "Beside", "Deep", None} < {x for _, x in want}
    assert rows(spark, "ref_H9_title_all", tables(pages=[{"page_id": i, "url": f"https://a.example/{i}", "cleaned_html": x} for i, x in enumerate(PAGES)])) == want
