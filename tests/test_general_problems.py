"""The three general operators: brute force, edge cases, empty tables."""

import json
import random
from datetime import datetime, timezone

import pytest
from conftest import at
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.jsontext import canonical, parser
from pagewright.operators import schema_drift, snapshot_diff, timestamps


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_p1_cases(spark, tables):
    runs = [{"run_id": f"r{i}", "job_id": "j", "started_at": at(i), "status": "done", "pages_extracted": None} for i in (1, 2, 3)]
    runs += [{"run_id": "bad", "job_id": "j", "started_at": at(2, 5), "status": "failed"}, {"run_id": "k1", "job_id": "k", "started_at": None, "status": "done"}, {"run_id": "k2", "job_id": "k", "started_at": at(1), "status": "done"}]

    def rec(i, run, url, payload, index=0, when=1, template="t"):
        return {"record_id": f"x{i}", "run_id": run, "page_url": url, "template_id": template, "record_index": index, "payload": payload, "extracted_at": None if when is None else at(when)}

    rows = [
        rec(1, "r1", "https://A.test:443/p/?utm_source=x#top", '{"a":1,"b":null}'), rec(2, "r2", "https://a.test/p", '{"a":1.0}'),  # unchanged
        rec(3, "r1", "https://a.test/q?x=1&gclid=2", '{"a":"1"}'), rec(4, "r2", "https://a.test/q?x=1", '{"a":1}'),  # changed type
        rec(5, "r1", "https://a.test/s", '{"a":true}'), rec(6, "r2", "https://a.test/s", '{"a":1}'),  # true is not 1
        rec(7, "r1", "https://a.test/u", '{"a":1}'), rec(8, "r2", "https://a.test/v", '{"a":1}'),  # removed, added
        rec(9, "r2", "https://a.test/w", '{"a":1}', when=1), rec(10, "r2", "https://a.test/w", '{"a":2}', when=2), rec(11, "r3", "https://a.test/w", '{"a":2}'),
        rec(12, "bad", "https://a.test/z", "{}"), rec(13, "none", "https://a.test/z", "{}"),
        rec(14, "k1", None, None, None, None, None), rec(15, "k2", None, '{"a":null}', None, None, None), rec(16, "k2", "", "broken{"),
    ]
    got = found(snapshot_diff.p1_found(spark, tables(crawl_run=runs, extracted_record=rows)))
    url = "https://a.test/"
    want = {("j", "r2", url + x, "t", 0, k) for x, k in (("q?x=1", "changed"), ("s", "changed"), ("u", "removed"), ("v", "added"), ("w", "added"))}
    want |= {("j", "r3", url + x, "t", 0, "removed") for x in ("p", "q?x=1", "s", "v")} | {("k", "k2", "", "t", 0, "added")}
    assert got == want


def test_p1_empty(spark, tables):
    assert found(snapshot_diff.p1_found(spark, tables())) == set()


@pytest.mark.parametrize("width", [1, 2, 16])
def test_iblt_finds_what_sets_find(spark, width):
    """Buckets far too small for their differences are enlarged, and then compared row by row."""
    rng = random.Random(width)
    snaps = {s: {k: rng.randrange(3) for k in range(200) if rng.random() < 0.8} for s in (1, 2, 3)}
    rows = [(7, s, 3, k % 2, hash((k, "k")), hash((k, 2)), v * 1000 + 5) for s, kv in snaps.items() for k, v in kv.items()]
    items = spark.createDataFrame(rows, "series long, seq int, last_seq int, bucket int, kh long, kh2 long, vh long")
    want = set()
    for s in (2, 3):
        a, b = snaps[s - 1], snaps[s]
        want |= {(7, s, hash((k, "k")), hash((k, 2)), "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert found(snapshot_diff.diff_snapshots(items, width=width, rounds=2 if width == 1 else 3)) == want


def test_pair_hash_is_sparks(spark):
    rows = [(0, 0), (1, -1), (2**62, -(2**63)), (-5, 77)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h"), F.xxhash64("b", "a", "b").alias("h3"))
    for r in df.collect():
        assert snapshot_diff.chain_hash(r.a, r.b) == r.h & snapshot_diff.MASK
        assert snapshot_diff.chain_hash(r.b, r.a, r.b) == r.h3 & snapshot_diff.MASK


def test_buckets_follow_the_rows(spark, tables):
    """A job whose runs do not say how many pages they have is spread all the same; one that says too much is not."""
    runs = [{"run_id": f"r{i}", "job_id": "big", "started_at": at(i + 1), "status": "done", "pages_extracted": None} for i in range(2)] + [{"run_id": "s", "job_id": "small", "status": "done", "pages_extracted": 10**6}]
    rows = [{"record_id": f"{r}-{i}", "run_id": r, "page_url": f"https://a.test/{i}", "template_id": "t", "record_index": 0, "payload": "{}"} for r in ("r0", "r1") for i in range(3000)]
    d = tables(crawl_run=runs, extracted_record=rows)
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    got = {r.run_id: r.buckets for r in snapshot_diff.with_buckets(snapshot_diff.ordered_runs(read("crawl_run")), read("extracted_record")).collect()}
    assert got == {"r0": 125, "r1": 125, "s": 1}
    assert found(snapshot_diff.p1_found(spark, d)) == set()


def test_canonical_json():
    parse = parser()
    same = ['{"a":1,"b":[1.50,{"x":null}]}', '{"b":[15e-1,{}],"a":1.0,"c":null}']
    assert len({canonical(parse(x)) for x in same}) == 1
    assert canonical(parse("1e2")) == canonical(parse("100"))
    assert len({canonical(parse(x)) for x in ('"1"', "1", "true", "null", "[1]")}) == 5
    assert canonical(parse("12345678901234567890")) != canonical(parse("12345678901234567891"))
    assert canonical(parse("1E+400000")) and parse("{bad") == ["broken", "{bad"]


MOMENTS = [
    ("2024-03-10T02:30:00[America/New_York]", "UTC", "ymd", "2024-03-10T07:30:00"), ("2024-11-03 01:30", "America/New_York", "mdy", "2024-11-03T05:30:00"), ("3/10/2024 2:30 AM", "America/New_York", "mdy", "2024-03-10T07:30:00"),
    ("03/04/2024 04:51", "Europe/Paris", "dmy", "2024-04-03T02:51:00"), ("03/04/2024 04:51", "America/Phoenix", "mdy", "2024-03-04T11:51:00"), ("23-05-24", "UTC", "dmy", "2024-05-23T00:00:00"),
    ("Updated on Thu, 25 Jan 2024 06:19:04 GMT", "Asia/Tokyo", "ymd", "2024-01-25T06:19:04"), ("20230111T011729Z", None, None, "2023-01-11T01:17:29"), ("1702448550", None, None, "2023-12-13T06:22:30"),
    ("2023-07-01T12:22:49.191731975Z", None, None, "2023-07-01T12:22:49.191731"), ("2025-06-11 13:36 GMT+05:30", None, None, "2025-06-11T08:06:00"), ("2023-01-19 04:10 AEDT", "Australia/Sydney", "dmy", "2023-01-18T17:10:00"),
    ("2024-01-05 10:00 EST", "Australia/Brisbane", "dmy", "2024-01-05T00:00:00"), ("2024-01-05 10:00 IST", "Asia/Kolkata", "dmy", "2024-01-05T04:30:00"), ("2024-07-05 10:00 CST", "Asia/Shanghai", "ymd", "2024-07-05T02:00:00"),
    ("Publié le 18 octobre 2024 à 4h30", "Europe/Paris", "dmy", "2024-10-18T02:30:00"), ("18. Juli 2024, 05:57 Uhr", "Europe/Berlin", "dmy", "2024-07-18T03:57:00"), ("31 de marzo de 2024, 01:16", "Europe/Madrid", "dmy", "2024-03-31T00:16:00"),
    ("December 18, 2023 at 12:05 AM", "UTC", "mdy", "2023-12-18T00:05:00"), ("2025-02-09 15:42:19+01", None, None, "2025-02-09T14:42:19"),
]
NO_MOMENTS = ["31 February 2024", "2025-13-40", "00/00/0000", "2024", "Spring 2025", "Week 35", "yesterday", "2 hours ago", "n/a", "", None, "2024-01-01 to 2024-02-01", "13:45 PM", "12:30", "2024-01-01 25:00"]


def test_moments():
    clock = timestamps.Clock()
    for text, zone, order, want in MOMENTS:
        t = datetime.fromisoformat(want).replace(tzinfo=timezone.utc)
        assert clock.read(text, zone, order) == int(t.timestamp()) * 10**6 + t.microsecond, text
    for text in NO_MOMENTS:
        assert clock.read(text, "UTC", "dmy") is None, text
    assert clock.read("2024-01-01 10:00", None, "dmy") is None  # no zone to be had
    assert clock.read("x" * 200_000 + " 2024-01-01", "UTC", "ymd") is not None


def test_days():
    for y, m, d in ((1970, 1, 1), (1999, 12, 31), (2000, 2, 29), (2400, 3, 1), (1900, 3, 1)):
        assert timestamps.days(y, m, d) == (datetime(y, m, d) - datetime(1970, 1, 1)).days


def test_p4_table(spark, tables):
    rows = [
        {"outcome_id": 1, "source_url": "https://WWW.A.test/x", "value_type": "date", "raw_text": "2024-01-01"}, {"outcome_id": 2, "source_url": "https://www.a.test", "value_type": "date", "raw_text": None, "value": "1702448550"},
        {"outcome_id": 3, "source_url": "https://b.test/", "value_type": "date", "raw_text": "2024-01-01"}, {"outcome_id": 4, "value_type": "string", "raw_text": "2024-01-01"}, {"outcome_id": 5, "value_type": "date"}, {"outcome_id": None, "value_type": None},
        {"outcome_id": 6, "source_url": None, "value_type": "date", "raw_text": "2024-01-01T00:00:00Z"}, {"outcome_id": 7, "source_url": "https://www.a.test/", "value_type": "date", "raw_text": "soon", "value": "2024-01-01"},
    ]
    d = tables(outcomes=rows, site=[{"host": "www.a.test", "time_zone": "Europe/Berlin", "date_order": "dmy"}])
    assert found(timestamps.p4_found(spark, d)) == {(1, 1704063600000000), (2, 1702448550000000), (6, 1704067200000000)}
    assert found(timestamps.p4_found(spark, tables())) == set()


def program(fields, listed=False):
    f = [{"name": k, "locators": x[0], "type": x[1]} for k, x in fields.items()] if listed else {k: {"locators": x[0], "type": x[1]} for k, x in fields.items()}
    return json.dumps({"pageTemplates": [{"id": "t", "fields": f}]})


def old_program(fields):
    return json.dumps({"templates": [{"id": "t", "fields": [{"name": k, "selectors": x[0], "dtype": x[1]} for k, x in fields.items()]}]})


def test_p7_cases(spark, tables):
    v1 = {"a": ([".a"], "string"), "b": ([".b", ".c"], "number"), "gone": ([".g"], "string")}
    v4 = {"a": ([".a", ".new"], "string"), "b2": ([".b", ".c"], "integer"), "fresh": ([".f"], "string")}
    configs = [{"job_id": "j", "version": v, "payload": p} for v, p in ((1, program(v1)), (1, program(v1, True)), (4, program(v4, True)), (5, old_program(v4)), (6, None), (7, "{bad"))]
    runs = [{"run_id": f"r{i}", "job_id": "j", "started_at": at(i), "status": "done"} for i in (1, 2, 3)]
    rows = [{"record_id": str(i), "run_id": r, "template_id": t, "payload": p} for i, (r, t, p) in enumerate([
        ("r1", "t", '{"a":1,"b":"x","n":null}'), ("r1", "t", '{"a":null}'), ("r2", "t", '{"a":"1","c":null,"n":2}'), ("r2", "u", '{"z":1}'), ("r3", "t", "{}"), ("r3", "t", None), ("r3", "u", '{"z":true}'), ("r3", None, '{"z":true}'),
    ])]
    d = tables(strategy_config=configs, crawl_run=runs, extracted_record=rows)
    want = {("config", "j", "4", "t", "b2", "renamed"), ("config", "j", "4", "t", "fresh", "added"), ("config", "j", "4", "t", "gone", "removed")}
    want |= {("config", "j", "6", "t", k, "removed") for k in v4}
    want |= {("record", "j", "r2", "t", "a", "retyped"), ("record", "j", "r2", "t", "b", "removed"), ("record", "j", "r2", "t", "c", "added")}
    want |= {("record", "j", "r3", "t", k, "removed") for k in ("a", "c", "n")} | {("record", "j", "r3", "u", "z", "retyped")}
    assert found(schema_drift.p7_found(spark, d)) == want
    assert {(r.version, r.column_name) for r in schema_drift.p7_configs(spark, d).collect() if r.field_name == "b"} == {(1, "b2")}
    assert {r.record_id: r.fields for r in schema_drift.p7_records(spark, d).collect()}["0"] == {"a": "1", "b2": "x"}
    assert found(schema_drift.p7_found(spark, tables())) == set()


def test_assignment_is_best():
    from itertools import permutations

    rng = random.Random(1)
    for n, m in ((1, 1), (3, 5), (5, 5)):
        for _ in range(30):
            cost = [[rng.randrange(20) for _ in range(m)] for _ in range(n)]
            got = schema_drift.assign(cost)
            assert len(set(got)) == n
            assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_many_renames_of_one_name():
    out = schema_drift.compare_programs([(False, "old", "string", [".x"]), (True, "n1", "string", [".x"]), (True, "n2", "string", [".x"])])
    assert sorted(out) == [("n1", "renamed", "old"), ("n2", "renamed", "old")]


def test_udf_types_need_no_session():
    assert isinstance(snapshot_diff.payload_hash.returnType, T.LongType)
