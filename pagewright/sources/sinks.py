"""Outputs of a run: JSON, CSV, Markdown, JSON lines, a page for people, and the files of a run.

Rows are turned into text as Columns and written by Spark, a file a partition; only summaries of a bounded number of rows
come to the driver.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.scalars import csv_cell, markdown_cell


def json_records(records: DataFrame, fields: list[str], meta: tuple[str, ...] = ("source_url", "template_id", "extracted_at")) -> DataFrame:
    """json: one object a record, values first named by ``_`` for what is not a field; nulls stay as null."""
    cols = [F.col(m).cast("string").alias(f"_{m}") for m in meta if m in records.columns] + [F.col(f) for f in fields]
    return records.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def csv_lines(records: DataFrame, fields: list[str], meta: tuple[str, ...] = ("source_url", "template_id")) -> DataFrame:
    cols = [*meta, *fields]
    return records.select(F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in cols]).alias("line"))


def csv_header(fields: list[str], meta: tuple[str, ...] = ("source_url", "template_id")) -> str:
    return ",".join([f"_{m}" for m in meta] + fields)


def markdown_rows(records: DataFrame, fields: list[str]) -> DataFrame:
    return records.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(c).cast("string")) for c in fields]), F.lit(" |")).alias("line"))


def field_names(payloads: DataFrame, payload: str, order: list[str]) -> DataFrame:
    """name, first: the union of the keys of all payloads and where each was first seen (row by ``order``, then place)."""
    keys = payloads.select(*order, F.posexplode(F.json_object_keys(payload)).alias("pos", "name"))
    return keys.groupBy("name").agg(F.min(F.struct(*order, "pos")).alias("first"))


def write_run(path: str, records: DataFrame, fields: list[str], form: str = "json", manifest: DataFrame | None = None, audit: DataFrame | None = None, diff: DataFrame | None = None) -> None:
    """The files of a run: records in the form asked for, manifest, audit log and difference, each a folder."""
    if form == "json":
        json_records(records, fields).write.mode("overwrite").text(f"{path}/records.json")
    elif form == "csv":
        records.select(*[F.col(c).cast("string") for c in fields]).write.mode("overwrite").csv(f"{path}/records.csv", header=True, escape='"', nullValue="", emptyValue="")
    elif form == "markdown":
        markdown_rows(records, fields).write.mode("overwrite").text(f"{path}/records.md")
    else:
        raise ValueError(f"unknown form: {form}")
    for name, part in (("manifest.json", manifest), ("audit.jsonl", audit), ("diff.json", diff)):
        if part is not None:
            part.write.mode("overwrite").json(f"{path}/{name}")


def read_manifests(spark, path: str, folder: str | None = None) -> DataFrame:
    """All manifests under a folder; malformed ones are passed over. ``folder``: the name of the folders that hold them, one
    below each run's, as ``write_run`` makes them."""
    reader = spark.read.option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
    return reader.json(f"{path}/*/{folder}") if folder else reader.option("recursiveFileLookup", "true").json(path)


def dashboard_html(rows: list[dict], totals: dict) -> str:
    """A page that shows the latest runs and their totals; every value is escaped."""
    cell = lambda x: html.escape("" if x is None else str(x))
    names = list(rows[0]) if rows else []
    cards = "".join(f"<div class='card'><b>{cell(v)}</b> {cell(k)}</div>" for k, v in totals.items())
    body = "".join("<tr>" + "".join(f"<td>{cell(r[n])}</td>" for n in names) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>Runs</title>{cards}<table><tr>{''.join(f'<th>{cell(n)}</th>' for n in names)}</tr>{body}</table>"


def jsonl(events: DataFrame, order: str) -> DataFrame:
    """One JSON object a line, in the order of insertion."""
    return events.orderBy(order).select(F.to_json(F.struct(*events.columns)).alias("line"))


def report_text(rows: list[dict]) -> str:
    """PASS or FAIL a page, with the fields that differ."""
    return "\n".join(f"{'PASS' if not r['diffs'] else 'FAIL'} {r['page']}" + "".join(f"\n  {json.dumps(d, ensure_ascii=False)}" for d in r["diffs"]) for r in rows)
