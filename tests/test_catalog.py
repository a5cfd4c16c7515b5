"""Every query of the core that has SQL gives its rows, over whole tables."""

import json
import math
import os
import re
from datetime import datetime, timedelta, timezone

import duckdb
import pyarrow.parquet as pq
import pytest

from pagewright import catalog
from pagewright.functions import dom

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}/*.parquet" if os.path.isdir(f"{DATA}/{f}") else f"{DATA}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n in catalog.oracle_sql()])
def test_rows_are_those_of_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert mine == theirs


# --- queries without SQL: the same rows by a plainer way ----------------------------------------------------------------


def rows(spark, name):
    return [r.asDict(recursive=True) for r in catalog.queries()[name](spark, DATA).collect()]


@pytest.fixture(scope="module")
def read():
    return lambda t: pq.read_table(f"{DATA}/{t}.parquet").to_pylist()


def test_every_query_without_sql_is_held_against_something():
    held = {"ref_K1_K6_json_records", "ref_F36_equal_deliveries", "ref_J11_C4_F42_program_diff", "ref_H1_clean", "ref_H4_markdown", "ref_H5_H6_budget", "ref_A15_shapes", "ref_H13_W14_O2_nav", "ref_H7_H10_execute", "ref_A_percentiles", "p4_found"}
    elsewhere = {"ref_F8_parse_date_all", "ref_G1_bfs_all", "ref_H9_title_all", "p7_configs", "p7_records", "p7_renames"}  # test_whole_tables, test_general_problems, test_column_matching
    assert {n for n in catalog.queries() if n not in catalog.oracle_sql()} == held | elsewhere


def test_json_records(spark, read):
    got = sorted(json.dumps(json.loads(r["json"]), sort_keys=True) for r in rows(spark, "ref_K1_K6_json_records"))
    at = lambda x: None if x is None else x.isoformat(" ") if x.microsecond == 0 else x.isoformat(" ").rstrip("0")
    want = sorted(json.dumps({"_source_url": r["source_url"], "_template_id": r["template_id"], "_extracted_at": at(r["extracted_at"]), "field_name": r["field_name"], "value": r["value"], "ok": r["ok"]}, sort_keys=True) for r in read("outcomes"))
    assert got == want


def programs(read):
    out = {}
    for r in read("strategy_config"):
        out.setdefault((r["job_id"], r["version"]), []).append(r["payload"])
    return out


def test_equal_deliveries(spark, read):
    got = {(r["job_id"], r["version"]): (r["deliveries"], r["meanings"]) for r in rows(spark, "ref_F36_equal_deliveries")}
    same = lambda x: json.loads(x)
    want = {}
    for k, texts in programs(read).items():
        kinds = []
        for x in texts:
            if x is not None and same(x) not in kinds:
                kinds.append(same(x))
        want[k] = (len(texts), len(kinds))
    assert got == want


def test_program_differences(spark, read):
    got = sorted((r["job_id"], r["version"], r["path"], r["op"], r["old"], r["new"]) for r in rows(spark, "ref_J11_C4_F42_program_diff"))
    latest, want = {}, []

    def walk(x, path=()):
        if isinstance(x, (dict, list)) and x:
            for k, v in x.items() if isinstance(x, dict) else enumerate(x):
                yield from walk(v, (*path, k))
        else:
            yield path, x

    name = lambda path: "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in path).lstrip(".")
    text = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)
    for (job, version), texts in sorted(programs(read).items()):
        now = {name(p): text(v) for p, v in walk(json.loads(max(x for x in texts if x is not None)))}
        if job in latest:
            before = latest[job]
            want += [(job, version, p, "add" if p not in before else "remove" if p not in now else "change", before.get(p), now.get(p)) for p in before.keys() | now.keys() if before.get(p) != now.get(p)]
        latest[job] = now
    assert got == sorted(want)


def test_pages_one_at_a_time(spark, read):
    """Plumbing of the page operators: null and empty pages, order, every page once. The functions themselves are tested in test_engine."""
    pages = {r["page_id"]: r for r in read("pages")}
    cleaned = {r.pop("page_id"): r for r in rows(spark, "ref_H1_clean")}
    assert cleaned == {i: dom.clean_page(p["cleaned_html"]) for i, p in pages.items()}
    assert all(not re.search(r"<(?:script|nav|footer|style)\b", r["html"]) for r in cleaned.values())
    assert {r["page_id"]: r["markdown"] for r in rows(spark, "ref_H4_markdown")} == {i: dom.markdown(p["cleaned_html"]) for i, p in pages.items()}
    kept, shapes = [], {}
    for i, p in pages.items():
        used, count = -1, {}
        first = True
        for pos, shape, markup in dom.regions(p["cleaned_html"]):
            shapes.setdefault(shape, []).append(i)
            count[shape] = count.get(shape, 0) + 1
            if count[shape] <= 2:
                used += len(markup) + 1
                if used <= 2000 or first:
                    kept.append((i, pos, shape, markup))
                first = False
    assert sorted((r["page_id"], r["pos"], r["shape"], r["html"]) for r in rows(spark, "ref_H5_H6_budget")) == sorted(kept)
    assert {r["shape"]: (r["regions"], r["pages"]) for r in rows(spark, "ref_A15_shapes")} == {s: (len(x), len(set(x))) for s, x in shapes.items()}


def test_nav_links(spark, read):
    want = {}
    rank = {"nav": 0, "header": 1, "footer": 2, "body": 3}
    for p in read("pages"):
        for pos, url, text, region in dom.links(p["cleaned_html"], p["url"] or ""):
            best = want.get((p["page_id"], url))
            if best is None or (rank[region], pos) < best[0]:
                want[p["page_id"], url] = ((rank[region], pos), text, region, pos)
    got = {(r["page_id"], r["url"]): (r["text"], r["region"], r["pos"]) for r in rows(spark, "ref_H13_W14_O2_nav")}
    assert got == {k: x[1:] for k, x in want.items()}


def test_outcomes_one_at_a_time(spark, read):
    """Every outcome by a plain loop over pages, records and locators."""
    got = {(r["page_id"], r["template_id"], r["rec_idx"], r["field_name"]): (r["ok"], r["value"], r["locator_rank"], r["raw_text"], r["reason"]) for r in rows(spark, "ref_H7_H10_execute")}
    blank = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    norm = lambda x: re.sub(f"[{blank}]+", " ", x).strip(blank)

    def amount(x):
        x = re.sub(r"^\((.*)\)$", r"-\1", re.sub(f"[{blank}]|,", "", x))
        x = re.sub("[$€£¥₹]", "", x)
        return float(x) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x, re.A) else None

    want = {}
    for p in read("pages"):
        root = dom.parse_html(p["cleaned_html"])
        cards = dom.compile_locator("section.card")(root)
        plans = [("page", 0, root, "title", ["article > h1", "h1"], lambda x: norm(x), lambda v: 0 < len(v) < 400), ("page", 0, root, "first", ["//article/p[1]", "p"], lambda x: norm(x), None)]
        plans += [("card", k, c, "name", ["h3"], lambda x: x, None) for k, c in enumerate(cards)] + [("card", k, c, "price", ["div.price", ".price"], amount, lambda v: v > 0) for k, c in enumerate(cards)]
        for template, k, node, field, locators, make, rule in plans:
            last = None
            for rank, locator in enumerate(locators):
                found = dom.compile_locator(locator)(node)
                raw = dom.text_of(found[0]) if found else None
                value = make(raw) if raw is not None else None
                last = "no-match" if raw is None else "transform-failed" if value is None else "validation-failed" if rule and not rule(value) else None
                if last is None:
                    want[p["page_id"], template, k, field] = (True, str(value), rank, raw, None)
                    break
            else:
                want[p["page_id"], template, k, field] = (False, None, None, None, last)
    assert got == want


def test_percentiles(spark, read):
    sizes = {}
    for p in read("pages"):
        sizes.setdefault(p["tier_used"], []).append((len(p["cleaned_html"]) if p["cleaned_html"] is not None else None, p["url"]))
    for r in rows(spark, "ref_A_percentiles"):
        known = sorted(n for n, _ in sizes[r["tier_used"]] if n is not None)
        assert r["size"] == [known[max(0, math.ceil(q * len(known)) - 1)] for q in (0.5, 0.95)]
        assert abs(r["urls"] - len({u for _, u in sizes[r["tier_used"]]})) <= 0.1 * r["urls"] + 1


def test_dates_against_their_values(spark, read):
    """Where an outcome has its moment as a value in ISO form too, the text gives that moment."""
    got = {r["outcome_id"]: r["utc_us"] for r in rows(spark, "p4_found")}
    n = 0
    for r in read("outcomes"):
        if r["value_type"] == "date" and r["raw_text"] is not None and r["ok"] and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", r["value"] or ""):
            t = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", r["value"]).replace("Z", "+00:00"))
            if r["outcome_id"] in got:
                n += 1
                assert abs(got[r["outcome_id"]] - (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)) < 1_000, r
    assert n > 20
