"""One object for a whole run: execute a program, partition, measure, compare with the run before, write, schedule."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import canonical, origin
from pagewright.operators import extract, metrics, record_diff
from pagewright.plans.program import Program, read_program
from pagewright.plans.proposer import heal
from pagewright.sources import sinks
from pagewright.sources.tables import cut

DURATION = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_every(text: str) -> timedelta:
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", text, re.I)
    if not m:
        raise ValueError(f"invalid duration {text!r}, use 30s, 5m, 2h or 1d")
    return timedelta(seconds=int(m[1]) * DURATION[m[2].lower()])


@dataclass
class Run:
    """What a run made; all but the manifest are lazy."""

    outcomes: DataFrame
    records: DataFrame
    clean: DataFrame
    review: DataFrame
    coverage: DataFrame
    manifest: dict
    program: dict
    healed: dict
    diff: DataFrame | None = None


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def run_job(self, pages: DataFrame, value: dict, html: str = "html", previous: DataFrame | None = None, proposer=None, repair_budget: int = 20) -> Run:
        """Run a program over pages (page_id, url, ``html``). With a proposer, fields that are required and failed get one
        round of repairs, and only then the program runs again; the manifest is that of the healed program."""
        program = read_program(value)
        outcomes = cut(extract.execute(pages, program, html))
        healed = {"repaired": 0, "failed": 0, "exhausted": 0}
        if proposer is not None:
            failed = outcomes.filter("NOT ok AND required").groupBy("template_id", "field_name").agg(F.min("page_id").alias("page_id"))
            bad = failed.join(pages.select("page_id", F.col(html).alias("html")), "page_id").orderBy("template_id", "field_name").collect()  # one row a field of the program
            value, healed = heal(proposer, value, [(r.template_id, r.field_name, r.html or "") for r in bad], repair_budget)
            if healed["repaired"]:
                program = read_program(value)
                outcomes = cut(extract.execute(pages, program, html))
        records = extract.records(outcomes, program)
        verdict = extract.partition_by_confidence(outcomes, program.floor)
        key = ["page_id", "template_id", "rec_idx"]
        clean = records.join(verdict.filter("NOT review").select(key), key, "left_semi")
        review = records.join(verdict.filter("review").select(key), key, "left_semi")
        row = metrics.manifest(outcomes).first().asDict()
        fields = list(dict.fromkeys(f.name for t in program.templates for f in t.fields))
        diff = record_diff.diff_records(previous, records, ["source_url", "template_id", "rec_idx"], fields) if previous is not None else None
        return Run(outcomes, records, clean, review, metrics.field_coverage(outcomes), row, value, healed, diff)

    def write(self, run: Run, path: str, form: str = "json") -> None:
        fields = [c for c in run.records.columns if c not in ("page_id", "source_url", "template_id", "rec_idx")]
        manifest = self.spark.createDataFrame([tuple(run.manifest.values())], list(run.manifest))
        sinks.write_run(path, run.clean, fields, form, manifest, None, run.diff.drop("before", "after") if run.diff is not None else None)
        run.records.write.mode("overwrite").json(f"{path}/all_records.json")

    def previous(self, path: str) -> DataFrame | None:
        """The records of a run that was written to ``path``, null where there is none; for ``run_job(previous=...)``."""
        folder = f"{path}/all_records.json"
        files = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files):
            return None
        return self.spark.read.json(folder)

    def sample_links(self, page: DataFrame, html: str = "html", n: int = 10) -> list[str]:
        """The first ``n`` distinct links of the same site on a page, in the order in which they stand."""
        links = extract.distinct_links(extract.page_links(page, html)).join(page.select("page_id", F.col("url").alias("base")), "page_id")
        return [r.url for r in links.filter(origin(F.col("url")) == origin(F.col("base"))).orderBy("page_id", "pos").limit(n).collect()]

    def estimate_scope(self, program: Program, page: DataFrame, html: str = "html") -> dict:
        """What a run would be about: templates, fields, required ones, distinct links of the same site on the entry page."""
        links = extract.page_links(page, html).join(page.select("page_id", F.col("url").alias("base")), "page_id")
        n = links.filter(origin(F.col("url")) == origin(F.col("base"))).select(canonical(F.col("url")).alias("k")).distinct().count()
        fields = [f for t in program.templates for f in t.fields]
        return {"templates": len(program.templates), "fields": len(fields), "required": sum(f.required for f in fields), "links": n}

    def run_eval(self, pages: DataFrame, value: dict, expected: DataFrame, html: str = "html") -> DataFrame:
        """Expected (page_id, template_id, rec_idx, field_name, value, exact) against what the program gives: a verdict a field."""
        got = extract.execute(pages, read_program(value), html).select("page_id", "template_id", "rec_idx", "field_name", "ok", F.col("value").alias("got"))
        d = expected.join(got, ["page_id", "template_id", "rec_idx", "field_name"], "left")
        mismatch = F.col("exact") & ~F.col("value").eqNullSafe(F.col("got"))
        verdict = F.when(F.col("ok").isNull(), "missing").when(~F.col("ok"), "unexpected-failure").when(mismatch, "value-mismatch").otherwise("ok")
        return d.withColumn("verdict", verdict)


class Schedules:
    """Schedules in one JSON file. A missed time does not pile up; a failed run is due again."""

    def __init__(self, path: str):
        self.path = path

    def list(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def _write(self, rows: list[dict]) -> None:
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=2)
        os.replace(self.path + ".new", self.path)

    def add(self, id_: str, config_path: str, every: str, now: datetime, form: str = "json", out_dir: str = "runs") -> dict:
        if any(r["id"] == id_ for r in self.list()):
            raise ValueError(f"schedule {id_} is there already")
        row = {"id": id_, "config_path": config_path, "every": every, "format": form, "out_dir": out_dir, "created_at": now.isoformat(), "last_run_at": None, "next_run_at": (now + parse_every(every)).isoformat()}
        self._write([*self.list(), row])
        return row

    def remove(self, id_: str) -> bool:
        rows = self.list()
        self._write([r for r in rows if r["id"] != id_])
        return any(r["id"] == id_ for r in rows)

    def update(self, id_: str, now: datetime, **changes) -> dict:
        """Change config_path, every, format or out_dir; a new interval counts from the last run, or from now."""
        rows = self.list()
        row = next((r for r in rows if r["id"] == id_), None)
        if row is None or set(changes) - {"config_path", "every", "format", "out_dir"}:
            raise KeyError(f"no schedule {id_}" if row is None else f"cannot change {', '.join(sorted(changes))}")
        new = row | changes
        if "every" in changes:
            start = datetime.fromisoformat(row["last_run_at"]) if row["last_run_at"] else now
            new["next_run_at"] = (start + parse_every(new["every"])).isoformat()
        self._write([new if r["id"] == id_ else r for r in rows])
        return new

    def run_now(self, id_: str, run, now: datetime | None = None) -> str | None:
        """Run one schedule whether it is due or not; its error, or None."""
        rows = [r for r in self.list() if r["id"] == id_]
        if not rows:
            raise KeyError(f"no schedule {id_}")
        return self._run(rows[0], run, now or datetime.now(timezone.utc))

    def run_daemon(self, run, stop, wait, now=lambda: datetime.now(timezone.utc)) -> int:
        """Run what is due until ``stop()``; ``wait(seconds)`` passes the time to the next one, a minute at most. How many ran."""
        n = 0
        while not stop():
            n += len(self.run_due(run, now()))
            times = [datetime.fromisoformat(r["next_run_at"]) for r in self.list()]
            wait(max(0.0, min([60.0, *((t - now()).total_seconds() for t in times)])) or 1.0)
        return n

    def due(self, now: datetime) -> list[dict]:
        return [r for r in self.list() if datetime.fromisoformat(r["next_run_at"]) <= now]

    def run_due(self, run, now: datetime | None = None) -> list[tuple[str, str | None]]:
        """Run what is due with ``run(row)``: (id, error or None) each; only a run that ended well moves on."""
        now = now or datetime.now(timezone.utc)
        return [(row["id"], self._run(row, run, now)) for row in self.due(now)]

    def _run(self, row: dict, run, now: datetime) -> str | None:
        try:
            run(row)
        except Exception as e:  # noqa: BLE001 - a schedule must not stop the others
            return f"{type(e).__name__}: {e}"
        done = row | {"last_run_at": now.isoformat(), "next_run_at": (now + parse_every(row["every"])).isoformat()}
        self._write([done if r["id"] == row["id"] else r for r in self.list()])
        return None
