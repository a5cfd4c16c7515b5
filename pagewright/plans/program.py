"""Extraction programs: strict reading, versions, differences, repairs, and their exploded relation."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.transforms import TRANSFORMS, pipeline
from pagewright.plans.expression import check_rule

VERSION = (1, 1, 0)
TYPES = ("string", "number", "integer", "boolean", "date", "url")
SCOPES = ("single", "section", "site")
PAGINATION = {"none": (), "next-link": ("locator",), "numbered": ("template", "start", "end"), "cursor": ("locator", "param"), "infinite-scroll": ("maxScrolls",)}
KNOWN = {"strategyVersion", "createdBy", "createdAt", "reason", "lastValidated", "target", "goal", "pageTemplates", "pagination", "fetchProfile", "confidenceFloor", "auth"}
FIELD_KEYS = {"locators", "semanticAnchor", "type", "transform", "validate", "required", "description"}


class ProgramError(ValueError):
    """All that is wrong with a program, one line each."""


@dataclass
class Field:
    name: str
    locators: list[str]
    type: str = "string"
    anchor: str = ""
    transform: str | None = None
    validate: str | None = None
    required: bool = True


@dataclass
class Template:
    id: str
    fields: list[Field]
    roots: list[str] = field(default_factory=list)
    multi: bool = False


@dataclass
class Program:
    templates: list[Template]
    version: str = "1.1.0"
    goal: str = ""
    entry: str = ""
    scope: str = "section"
    floor: float = 0.8
    pagination: dict = field(default_factory=lambda: {"type": "none"})
    source: dict = field(default_factory=dict)


def parse_version(text: str) -> tuple[int, int, int] | None:
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", text or "")
    return tuple(map(int, m.groups())) if m else None


def compatible(text: str) -> bool:
    """Same major version, and a minor one that this engine knows."""
    v = parse_version(text)
    return bool(v) and v[0] == VERSION[0] and v[1] <= VERSION[1]


def read_program(value: dict) -> Program:
    """A program from its JSON value; every fault is named at once."""
    faults: list[str] = []
    say = faults.append
    if not isinstance(value, dict):
        raise ProgramError("the program is no object")
    for k in sorted(set(value) - KNOWN):
        say(f"unknown key {k}")
    if not compatible(value.get("strategyVersion", "1.0.0")):
        say(f"version {value.get('strategyVersion')} is not readable here")
    templates = []
    for t in value.get("pageTemplates") or []:
        fields = []
        for name, f in (t.get("fields") or {}).items():
            where = f"{t.get('id')}.{name}"
            for k in sorted(set(f) - FIELD_KEYS):
                say(f"{where}: unknown key {k}")
            if not f.get("locators"):
                say(f"{where}: no locator")
            if f.get("type") not in TYPES:
                say(f"{where}: unknown type {f.get('type')}")
            try:
                pipeline(f.get("transform"))
            except ValueError as e:
                say(f"{where}: {e}")
            if f.get("validate") and (fault := check_rule(f["validate"])):
                say(f"{where}: {fault}")
            locators = list(dict.fromkeys(f.get("locators") or []))
            fields.append(Field(name, locators, f.get("type", "string"), f.get("semanticAnchor", ""), f.get("transform"), f.get("validate"), f.get("required", True)))
        if not fields:
            say(f"template {t.get('id')} has no field")
        roots = [x.strip() for x in (t.get("matchHeuristic") or "").split(" | ") if x.strip()]
        templates.append(Template(t.get("id", "page"), fields, roots, bool(t.get("multiRecord", False))))
    if not templates:
        say("no template")
    target = value.get("target") or {}
    if target.get("scope", "section") not in SCOPES:
        say(f"unknown scope {target.get('scope')}")
    pagination = value.get("pagination") or {"type": "none"}
    if pagination.get("type") not in PAGINATION or any(k not in pagination for k in PAGINATION.get(pagination.get("type"), ())):
        say(f"pagination {pagination.get('type')} is unknown or incomplete")
    floor = value.get("confidenceFloor", 0.8)
    if not isinstance(floor, (int, float)) or not 0 <= floor <= 1:
        say("the confidence floor is not between 0 and 1")
    if faults:
        raise ProgramError("\n".join(faults))
    return Program(templates, value.get("strategyVersion", "1.1.0"), value.get("goal", ""), target.get("entryUrl", ""), target.get("scope", "section"), float(floor), pagination, value)


def import_program(text: str) -> Program:
    """A program from a file's text, in its envelope or bare; both are held against the version."""
    value = json.loads(text)
    return read_program(value["config"] if isinstance(value, dict) and "config" in value else value)


def export_program(program: Program, now: datetime | None = None) -> str:
    at = (now or datetime.now(timezone.utc)).isoformat().replace("+00:00", "Z")
    return json.dumps({"envelope": 1, "exportedAt": at, "config": program.source}, indent=2, ensure_ascii=False)


def leaves(value, path: str = "") -> dict[str, str]:
    """Path -> JSON text of every leaf of a value; lists go by index."""
    if isinstance(value, dict) and value:
        return {k: v for name in value for k, v in leaves(value[name], f"{path}.{name}" if path else name).items()}
    if isinstance(value, list) and value:
        return {k: v for i, x in enumerate(value) for k, v in leaves(x, f"{path}[{i}]").items()}
    return {path: json.dumps(value, sort_keys=True, ensure_ascii=False)}


def diff_programs(before: dict, after: dict) -> list[tuple[str, str, str | None, str | None]]:
    """(path, add|remove|change, before, after) in the order of paths."""
    a, b = leaves(before), leaves(after)
    out = []
    for k in sorted(a.keys() | b.keys()):
        if a.get(k) != b.get(k):
            out.append((k, "add" if k not in a else "remove" if k not in b else "change", a.get(k), b.get(k)))
    return out


def format_diff(changes: list[tuple]) -> str:
    sign = {"add": "+", "remove": "-", "change": "~"}
    text = lambda c: c[3] if c[1] == "add" else c[2] if c[1] == "remove" else f"{c[2]} -> {c[3]}"
    return "\n".join(f"{sign[c[1]]} {c[0]}: {text(c)}" for c in changes)


def apply_repairs(value: dict, patches: list[tuple[str, str, str]], now: datetime | None = None) -> dict:
    """The program with (template, field, locator) appended; unknown fields and known locators are passed over."""
    out, changed = copy.deepcopy(value), False
    for template, name, locator in patches:
        for t in out.get("pageTemplates", []):
            f = t.get("fields", {}).get(name) if t.get("id") == template else None
            if f is not None and locator not in f["locators"]:
                f["locators"].append(locator)
                changed = True
    if changed:
        out["reason"] = "self-heal"
        out["lastValidated"] = (now or datetime.now(timezone.utc)).isoformat().replace("+00:00", "Z")
    return out


def program_relation(spark: SparkSession, program: Program) -> DataFrame:
    """The program as rows: one per template, field and locator."""
    rows = [
        (t.id, t.multi, n, f.name, rank, x, len(f.locators), f.type, f.transform, f.validate, f.required)
        for t in program.templates for n, f in enumerate(t.fields) for rank, x in enumerate(f.locators)
    ]
    return spark.createDataFrame(
        rows, "template_id string, multi_record boolean, field_ord int, field_name string, locator_rank int, locator string, n_locators int, type string, transform string, validate string, required boolean"
    )


class ProgramStore:
    """Insert-only versions of programs in one folder of JSON rows; the latest is the one with the highest version."""

    COLUMNS = "job_id string, version int, payload string, created_by string, reason string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.COLUMNS).json(self.path)
        except Exception:  # noqa: BLE001 - nothing was saved yet
            return self.spark.createDataFrame([], self.COLUMNS)

    def save(self, job_id: str, value: dict, created_by: str = "", reason: str = "") -> int:
        read_program(value)
        version = (self.table().filter(F.col("job_id") == job_id).agg(F.max("version")).first()[0] or 0) + 1
        row = [(job_id, version, json.dumps(value), created_by, reason)]
        self.spark.createDataFrame(row, self.COLUMNS).coalesce(1).write.mode("append").json(self.path)
        return version

    def load(self, job_id: str, version: int | None = None) -> dict | None:
        rows = self.table().filter(F.col("job_id") == job_id)
        rows = rows.filter(F.col("version") == version) if version is not None else rows
        row = rows.groupBy("job_id").agg(F.max_by("payload", "version").alias("payload")).first()
        return json.loads(row.payload) if row else None

    def restore(self, job_id: str, version: int) -> int:
        """A copy of an old version as the newest."""
        value = self.load(job_id, version)
        if value is None:
            raise KeyError(f"{job_id} has no version {version}")
        return self.save(job_id, value, "restore", f"restore of {version}")

    def versions(self, job_id: str) -> DataFrame:
        """All but the payload, newest first."""
        return self.table().filter(F.col("job_id") == job_id).drop("payload").orderBy(F.desc("version"))

    def diff(self, job_id: str, a: int, b: int) -> list[tuple]:
        return diff_programs(self.load(job_id, a) or {}, self.load(job_id, b) or {})


def merge_schema(user: list[dict], inferred: list[dict]) -> list[dict]:
    """Fields by normalized name: the user's come first and win, then the inferred ones that are new."""
    from pagewright.plans.proposer import slug_name

    out: dict[str, dict] = {}
    for item in [*user, *inferred]:
        out.setdefault(slug_name(item["name"]), item | {"name": slug_name(item["name"])})
    return list(out.values())


__all__ = [n for n in dir() if not n.startswith("_")] + ["TRANSFORMS"]
