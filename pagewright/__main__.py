"""Command line: compile, check and run programs, crawl, evaluate, compare, schedule, keep secrets, list and run queries."""

from __future__ import annotations

import argparse
import getpass
import json
import sys
from datetime import datetime, timezone


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagewright")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help_)
        for k, v in options.items():
            p.add_argument(f"--{k.replace('_', '-')}", **v)
        return p

    need, html, form = {"required": True}, {"default": "cleaned_html"}, {"default": "json", "choices": ["json", "csv", "markdown"]}
    command("run", "run a program over a parquet table of pages", config=need, pages=need, html=html, out=need, format=form, diff_against={"help": "folder of an earlier run"})
    command("crawl", "crawl a snapshot folder from an entry address", config=need, snapshot=need, entry=need, out=need, scope={"default": "section"}, max_pages={"type": int, "default": 50}, max_depth={"type": int, "default": 3}, robots={"default": "respect", "choices": ["respect", "warn", "ignore"]}, heal={"action": "store_true"})
    command("compile", "propose a program for a page", goal=need, page=need, entry=need, field={"action": "append", "default": []}, out=need)
    command("eval", "hold a program against fixtures", config=need, fixtures=need)
    command("check", "read a program strictly").add_argument("config")
    for name, what in (("diff", "compare two programs"), ("diff-records", "compare the records of two runs")):
        p = command(name, what)
        p.add_argument("before")
        p.add_argument("after")
    p = command("schedule", "keep schedules in a file", file=need, id={}, config={}, every={}, format=form, out={"default": "runs"}, pages={}, html=html)
    p.add_argument("action", choices=["add", "list", "remove", "update", "run-due", "run-now"])
    p = command("secret", "keep secrets in a file that only its owner may read", file=need)
    p.add_argument("action", choices=["set", "list", "remove"])
    p.add_argument("name", nargs="?")
    command("dashboard", "a page of the runs under a folder", runs=need, out=need)
    command("query", "run a query of the catalog over a folder of tables", tables=need, out={}).add_argument("name")
    command("queries", "names of all queries")
    return parser


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("pagewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    from pagewright.plans.program import ProgramError

    try:
        return globals()["do_" + a.command.replace("-", "_")](a)
    except (ProgramError, KeyError, ValueError, FileNotFoundError, PermissionError) as e:
        print(e.args[0] if isinstance(e, KeyError) and e.args else e, file=sys.stderr)
        return 1


def do_queries(a) -> int:
    from pagewright import catalog

    print("\n".join(catalog.queries()))
    return 0


def do_query(a) -> int:
    from pagewright import catalog

    df = catalog.queries()[a.name](session(), a.tables)
    df.write.mode("overwrite").parquet(a.out) if a.out else df.show(20, False)
    return 0


def do_check(a) -> int:
    from pagewright.plans.program import import_program

    print(f"{len(import_program(read(a.config)).templates)} templates")
    return 0


def do_diff(a) -> int:
    from pagewright.plans.program import diff_programs, format_diff

    print(format_diff(diff_programs(json.loads(read(a.before)), json.loads(read(a.after)))))
    return 0


def do_diff_records(a) -> int:
    from pagewright.operators.record_diff import diff_counts, diff_records
    from pagewright.plans.engine import Engine

    engine = Engine(session())
    before, after = engine.previous(a.before), engine.previous(a.after)
    if before is None or after is None:
        raise FileNotFoundError(f"no records under {a.before if before is None else a.after}")
    key = ["source_url", "template_id", "rec_idx"]
    both = sorted((set(before.columns) | set(after.columns)) - {*key, "page_id"})
    from pyspark.sql import functions as F

    whole = lambda df: df.select(*key, *[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in both])
    print(json.dumps(diff_counts(diff_records(whole(before), whole(after), key, both)).first().asDict()))
    return 0


def _run(spark, config: str, pages: str, html: str, out: str, form: str, against: str | None = None) -> dict:
    from pagewright.plans.engine import Engine
    from pagewright.plans.program import import_program

    engine = Engine(spark)
    done = engine.run_job(spark.read.parquet(pages), import_program(read(config)).source, html, engine.previous(against) if against else None)
    engine.write(done, out, form)
    return done.manifest


def do_run(a) -> int:
    from pagewright.plans.program import import_program

    import_program(read(a.config))  # a faulty one is told before a session is made
    print(json.dumps(_run(session(), a.config, a.pages, a.html, a.out, a.format, a.diff_against)))
    return 0


def do_crawl(a) -> int:
    from pagewright.functions.urls import origin
    from pagewright.plans.crawling import crawl_site
    from pagewright.plans.program import import_program
    from pagewright.plans.proposer import RuleProposer
    from pagewright.sources.pagesource import read_pages
    from pyspark.sql import functions as F

    program, spark = import_program(read(a.config)).source, session()
    pages = read_pages(spark, a.snapshot)
    files = pages.filter(F.endswith("url", F.lit("/robots.txt")) & F.col("status").between(200, 299)).select(origin(F.col("url")).alias("origin"), F.col("body").alias("text"))
    done = crawl_site(spark, pages, a.entry, program, scope=a.scope, max_pages=a.max_pages, max_depth=a.max_depth, robots_files=files, policy=a.robots, proposer=RuleProposer() if a.heal else None)
    done.outcomes.drop("attempts").write.mode("overwrite").json(f"{a.out}/outcomes.json")
    for name in ("visits", "skipped", "failures"):
        getattr(done, name).write.mode("overwrite").json(f"{a.out}/{name}.json")
    spark.createDataFrame([(json.dumps(done.program),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/program.json")
    print(json.dumps({"visited": done.visits.count(), "skipped": done.skipped.count(), "failures": done.failures.count(), "repairs": done.repairs, "likely_redesign": done.likely_redesign}))
    return 0


def do_compile(a) -> int:
    from pagewright.plans.program import export_program, read_program
    from pagewright.plans.proposer import RuleProposer, compile_program

    value = compile_program(RuleProposer(), a.goal, [{"name": x} for x in a.field], read(a.page), a.entry)
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(export_program(read_program(value)))
    print(", ".join(value["pageTemplates"][0]["fields"]))
    return 0


def do_eval(a) -> int:
    """Fixtures are JSON rows: page_id, url, html, and expected as a list of {template_id, rec_idx, field_name, value, exact}."""
    from pyspark.sql import functions as F

    from pagewright.plans.engine import Engine
    from pagewright.plans.program import import_program

    program, spark = import_program(read(a.config)).source, session()
    schema = "page_id long, url string, html string, expected array<struct<template_id:string,rec_idx:int,field_name:string,value:string,exact:boolean>>"
    rows = spark.read.schema(schema).json(a.fixtures)
    expected = rows.select("page_id", F.inline("expected")).withColumn("exact", F.coalesce("exact", F.lit(True)))
    verdicts = Engine(spark).run_eval(rows.select("page_id", "url", "html"), program, expected).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r.verdict: r.n for r in verdicts}
    print(json.dumps(counts))
    return 0 if set(counts) <= {"ok"} else 2


def do_schedule(a) -> int:
    from pagewright.plans.engine import Schedules

    book, now = Schedules(a.file), datetime.now(timezone.utc)
    if a.action == "list":
        print(json.dumps(book.list(), indent=2))
    elif a.action == "add":
        print(json.dumps(book.add(a.id, a.config, a.every, now, a.format, a.out)))
    elif a.action == "remove":
        return 0 if book.remove(a.id) else 1
    elif a.action == "update":
        print(json.dumps(book.update(a.id, now, **{k: v for k, v in (("config_path", a.config), ("every", a.every)) if v})))
    else:
        spark = session()
        run = lambda row: _run(spark, row["config_path"], a.pages, a.html, f"{row['out_dir']}/{row['id']}-{now:%Y%m%dT%H%M%S}", row["format"])
        told = book.run_due(run, now) if a.action == "run-due" else [(a.id, book.run_now(a.id, run, now))]
        print(json.dumps(told))
        return 1 if any(error for _, error in told) else 0
    return 0


def do_secret(a) -> int:
    from pagewright.plans.secrets import FileSecrets

    box = FileSecrets(a.file)
    if a.action == "list":
        print("\n".join(box.names()))
    elif a.action == "remove":
        return 0 if box.remove(a.name) else 1
    else:
        box.put(a.name, getpass.getpass("value: ") if sys.stdin.isatty() else sys.stdin.readline().rstrip("\n"))
    return 0


def do_dashboard(a) -> int:
    from pyspark.sql import functions as F

    from pagewright.sources.sinks import dashboard_html, read_manifests

    rows = read_manifests(session(), a.runs, "manifest.json").withColumn("run", F.regexp_extract(F.input_file_name(), "([^/]+)/manifest.json", 1)).orderBy(F.desc("run")).limit(200).collect()
    rows = [r.asDict() for r in rows]
    totals = {k: sum(r[k] or 0 for r in rows) for k in ("pages", "records", "fields_ok", "fields_failed") if rows and k in rows[0]}
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(dashboard_html(rows, {"runs": len(rows)} | totals))
    print(len(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
