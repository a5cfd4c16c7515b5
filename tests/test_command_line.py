"""The command line from program to dashboard, and schedules beyond the due ones."""

import io
import json
import sys
from datetime import datetime, timedelta, timezone

import pytest

from pagewright.__main__ import main
from pagewright.plans.engine import Schedules

PAGE = '<html><body><main><h1 class="title">Kettle</h1><span class="price">$9.50</span><a href="/docs/b">b</a></main></body></html>'


@pytest.fixture
def files(spark, tmp_path):
    (tmp_path / "page.html").write_text(PAGE)
    assert main(["compile", "--goal", "products: title, price", "--page", str(tmp_path / "page.html"), "--entry", "https://a.test/docs/", "--field", "title", "--out", str(tmp_path / "c.json")]) == 0
    spark.createDataFrame([(1, "https://a.test/docs/", PAGE), (2, "https://a.test/docs/b", PAGE.replace("Kettle", "Lamp"))], "page_id long, url string, cleaned_html string").write.parquet(str(tmp_path / "pages.parquet"))
    return tmp_path


def test_programs_runs_and_dashboard(files, capsys):
    c, pages = str(files / "c.json"), str(files / "pages.parquet")
    assert main(["check", c]) == 0 and "1 templates" in capsys.readouterr().out
    for name in ("r1", "r2"):
        assert main(["run", "--config", c, "--pages", pages, "--out", str(files / "runs" / name), *(["--diff-against", str(files / "runs" / "r1")] if name == "r2" else [])]) == 0
    assert (files / "runs" / "r2" / "diff.json").is_dir() and not (files / "runs" / "r1" / "diff.json").exists()
    capsys.readouterr()
    assert main(["diff-records", str(files / "runs" / "r1"), str(files / "runs" / "r2")]) == 0
    assert json.loads(capsys.readouterr().out) == {"added": 0, "removed": 0, "changed": 0, "unchanged": 2}
    assert main(["diff-records", str(files / "runs" / "r1"), str(files / "none")]) == 1
    assert main(["dashboard", "--runs", str(files / "runs"), "--out", str(files / "d.html")]) == 0 and "<td>r2</td>" in (files / "d.html").read_text()
    book = str(files / "s.json")
    assert main(["schedule", "add", "--file", book, "--id", "x", "--config", c, "--every", "1h", "--out", str(files / "runs")]) == 0
    assert main(["schedule", "run-due", "--file", book, "--pages", pages]) == 0 and main(["schedule", "run-now", "--file", book, "--id", "x", "--pages", pages]) == 0
    assert main(["schedule", "remove", "--file", book, "--id", "x"]) == 0 and main(["schedule", "remove", "--file", book, "--id", "x"]) == 1
    want = [{"template_id": "page", "rec_idx": 0, "field_name": "title", "value": "Kettle"}, {"template_id": "page", "rec_idx": 0, "field_name": "title", "value": "no", "exact": False}]
    (files / "f.json").write_text(json.dumps({"page_id": 1, "url": "https://a.test/docs/", "html": PAGE, "expected": want[:1]}))
    assert main(["eval", "--config", c, "--fixtures", str(files / "f.json")]) == 0
    (files / "f.json").write_text(json.dumps({"page_id": 1, "url": "https://a.test/docs/", "html": PAGE.replace("Kettle", "Lamp"), "expected": want}))
    assert main(["eval", "--config", c, "--fixtures", str(files / "f.json")]) == 2


def test_crawl(files, capsys):
    (files / "b.html").write_text(PAGE.replace("Kettle", "Lamp"))
    (files / "manifest.json").write_text(json.dumps([{"url": "https://a.test/docs/", "file": "page.html"}, {"url": "https://a.test/docs/b", "file": "b.html"}]))
    capsys.readouterr()
    assert main(["crawl", "--config", str(files / "c.json"), "--snapshot", str(files), "--entry", "https://a.test/docs/", "--out", str(files / "crawl"), "--heal"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["visited"] == 2


def test_faults_and_secrets(tmp_path, capsys, monkeypatch):
    (tmp_path / "bad.json").write_text('{"strategyVersion": "9.0.0", "pageTemplates": []}')
    assert main(["check", str(tmp_path / "bad.json")]) == 1 and "not readable" in capsys.readouterr().err
    assert main(["check", str(tmp_path / "none.json")]) == 1
    box = str(tmp_path / "box.json")
    monkeypatch.setattr(sys, "stdin", io.StringIO("hidden\n"))
    assert main(["secret", "set", "key", "--file", box]) == 0 and main(["secret", "list", "--file", box]) == 0
    assert capsys.readouterr().out.strip() == "key"
    assert main(["secret", "remove", "key", "--file", box]) == 0 and main(["secret", "remove", "key", "--file", box]) == 1
    assert main(["queries"]) == 0 and "p1_found" in capsys.readouterr().out


def test_schedules_update_and_loop(tmp_path):
    s, now = Schedules(str(tmp_path / "s.json")), datetime(2025, 1, 1, tzinfo=timezone.utc)
    s.add("a", "c.json", "1h", now)
    assert datetime.fromisoformat(s.update("a", now, every="30m")["next_run_at"]) == now + timedelta(minutes=30)
    for bad in (lambda: s.update("b", now, every="1h"), lambda: s.update("a", now, id="z"), lambda: s.run_now("b", print)):
        with pytest.raises(KeyError):
            bad()
    assert s.run_now("a", lambda row: None, now) is None and s.list()[0]["last_run_at"] == now.isoformat()
    clock = [now]
    ran = s.run_daemon(lambda row: None, lambda: clock[0] > now + timedelta(hours=2), lambda sec: clock.__setitem__(0, clock[0] + timedelta(seconds=sec)), lambda: clock[0])
    assert ran == 4
