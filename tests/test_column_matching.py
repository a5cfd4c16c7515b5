"""Renamed columns of records are found by their values, and the assignment decides where a greedy choice would fail."""

import json

from conftest import at

from pagewright.operators import schema_drift as D


def test_assignment_is_not_greedy():
    """b's best partner is x, and so is a's; taking the best pair first would leave b with nothing."""
    h = lambda *x: sorted(x)
    sides = [(False, "a", ["s"], h(*range(0, 10))), (False, "b", ["s"], h(*range(5, 11), 20, 21)), (True, "x", ["s"], h(*range(1, 11))), (True, "y", ["s"], h(*range(0, 5), 30, 31))]
    score = {(n[1], g[1]): D.overlap(n[3], g[3]) for g in sides[:2] for n in sides[2:]}
    assert max(score, key=score.get) == ("x", "a") and score["y", "b"] < D.LEAST <= score["y", "a"]
    assert sorted((n, w) for n, w, _ in D.match_columns(sides)) == [("x", "b"), ("y", "a")]


def test_overlap_of_sketches():
    assert D.overlap([], [1]) == 0 and D.overlap([1, 2], [1, 2]) == 1 and D.overlap([1, 2, 3, 4], [3, 4, 5]) == 2 / 5
    full = list(range(D.SKETCH))
    assert D.overlap(full, full) == 1 and D.overlap(full, [x + D.SKETCH for x in full]) == 0
    # A full sketch says nothing beyond its end: values of the other one that lie there do not count against it.
    assert D.overlap(full, [*full[:10], 10**6]) == 10 / D.SKETCH


def test_few_values_need_like_names():
    flag = [1, 2]
    assert D.match_columns([(False, "has-trial", ["b"], flag), (True, "visible", ["b"], flag)]) == []
    assert [x[:2] for x in D.match_columns([(False, "trial", ["b"], flag), (True, "has-trial", ["b"], flag)])] == [("has-trial", "trial")]
    assert D.match_columns([]) == [] and D.match_columns([(True, "a", ["s"], [1, 2, 3])]) == []


def test_near_programs_share_a_column():
    out = D.compare_programs([(False, "old", "string", [".a", ".b", ".c"]), (True, "fresh", "string", [".a", ".b", ".d"]), (True, "other", "string", [".z"])])
    assert sorted(out, key=str) == [("fresh", "added", "old"), ("old", "removed", None), ("other", "added", None)]


def test_renames_in_records(spark, tables):
    runs = [{"run_id": f"r{i}", "job_id": "j", "started_at": at(i), "status": "done", "pages_extracted": 1} for i in (1, 2, 3)] + [{"run_id": "bad", "job_id": "j", "status": "failed"}]
    rows = []
    for run, title, price in (("r1", "title", "price"), ("r2", "heading", "price"), ("r3", "heading", "cost")):
        for i in range(200):
            payload = {title: f"Item number {i}", price: i * 1.5 if i % 7 else None, "k": {"deep": i}}
            rows.append({"record_id": f"{run}-{i}", "run_id": run, "page_url": f"https://a.test/{i}", "template_id": None if i % 2 else "t", "record_index": 0, "payload": json.dumps(payload), "extracted_at": at(4)})
    rows += [{"record_id": "n", "run_id": "r2", "template_id": "t", "payload": None}, {"record_id": "b", "run_id": "r2", "template_id": "t", "payload": "{broken"}, {"record_id": "e", "run_id": "none", "template_id": "t", "payload": '{"a":1}'}]
    d = tables(crawl_run=runs, extracted_record=rows)
    got = {(r.layer, r.job_id, r.file_id, r.template_id, r.field_name, r.was) for r in D.p7_renames(spark, d).collect()}
    want = {("record", "j", run, t, new, old) for t in ("t", None) for run, new, old in (("r2", "heading", "title"), ("r3", "cost", "price"))}
    assert got == want
    fields = {r.record_id: r.fields for r in D.p7_records(spark, d).collect()}
    assert len(fields) == len(rows) and fields["r1-2"] == {"heading": "Item number 2", "cost": "3.0", "k": '{"deep":2}'} == fields["r3-2"]
    assert fields["r1-1"]["title"] == "Item number 1" and fields["n"] is None and not fields["b"]
    assert {r.change_kind for r in D.p7_found(spark, d).collect()} == {"added", "removed"}
    assert D.p7_renames(spark, tables()).count() == 0 and D.p7_records(spark, tables()).count() == 0
