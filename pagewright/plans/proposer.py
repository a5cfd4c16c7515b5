"""The model-driven steps with a provider that can be swapped: infer fields, propose locators, compile, repair.

``RuleProposer`` works without a network: it reads field names from the goal and proposes locators from a page's own
classes, ids and data attributes. Any object with the same two methods takes its place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pagewright.functions import dom
from pagewright.plans.program import ProgramError, apply_repairs, merge_schema, read_program

TYPE_WORDS = {"number": ("price", "amount", "rating", "salary", "weight"), "integer": ("count", "reviews", "seats", "quantity"), "date": ("date", "published", "updated", "posted", "at"), "url": ("link", "url", "href"), "boolean": ("in-stock", "remote", "available", "trial")}
DEFAULT_TRANSFORM = {"number": "stripCurrency|toFloat", "integer": "stripCurrency|toInt", "date": "parseDate", "url": "absoluteUrl", "boolean": "toBool", "string": "normalizeWhitespace"}


def slug_name(name: str) -> str:
    """Kebab-case of a field's name."""
    return re.sub(r"^-+|-+$", "", re.sub(r"[\s_\-]+", "-", re.sub(r"[^a-z0-9\s_\-]", "", name.strip().lower())))


def guess_type(name: str) -> str:
    parts = slug_name(name)
    return next((t for t, words in TYPE_WORDS.items() if any(parts == w or parts.endswith("-" + w) or parts.startswith(w + "-") for w in words)), "string")


@dataclass
class Usage:
    calls: int = 0
    input_tokens: int = 0
    output_tokens: int = 0

    def add(self, text_in: str, text_out: str) -> None:
        self.calls += 1
        self.input_tokens += -(-len(text_in) // 4)
        self.output_tokens += -(-len(text_out) // 4)


@dataclass
class RuleProposer:
    """A deterministic stand-in for a model; keeps count of what it was asked."""

    usage: Usage = field(default_factory=Usage)

    def fields(self, goal: str, excerpt: str) -> list[dict]:
        names = re.findall(r"[a-z][a-z-]{2,}", goal.lower().split(":", 1)[-1]) if ":" in goal else []
        out = [{"name": n, "type": guess_type(n)} for n in dict.fromkeys(names) if n not in ("and", "the", "with", "for")]
        self.usage.add(goal + excerpt[:4000], str(out))
        return out

    def locators(self, name: str, page: str) -> list[str]:
        root, word, out = dom.parse_html(page), slug_name(name), []
        for n in root.walk():
            classes = n.attrs.get("class", "").split()
            if n.attrs.get("data-field") == name:
                out.append(f'[data-field="{name}"]')
            out += [f"{n.tag}.{c}" for c in classes if word in slug_name(c) or (len(c) > 3 and slug_name(c) in word)]
            if n.attrs.get("id") and word in slug_name(n.attrs["id"]):
                out.append(f"#{n.attrs['id']}")
        if word in ("title", "headline", "name"):
            out += ["h1", "h2"]
        out = list(dict.fromkeys(out))
        self.usage.add(name + page, str(out))
        return out


def resolving(locators: list[str], page: str) -> list[str]:
    """Those that find something on the page."""
    root = dom.parse_html(page)
    return [x for x in locators if dom.compile_locator(x)(root)]


def compile_program(proposer, goal: str, user_fields: list[dict], page: str, entry: str, scope: str = "section", multi: bool = False, roots: str | None = None) -> dict:
    """A program for a page, or a ProgramError that names the required fields no locator was found for."""
    schema = merge_schema(user_fields, proposer.fields(goal, dom.text_of(dom.parse_html(page))[:4000]))
    fields, lost = {}, []
    for f in schema:
        found = resolving(proposer.locators(f["name"], page), page)
        if found:
            kind = f.get("type") or guess_type(f["name"])
            fields[f["name"]] = {"locators": found[:4], "semanticAnchor": f.get("description", f["name"]), "type": kind, "transform": DEFAULT_TRANSFORM[kind], "required": f.get("required", True)}
        elif f.get("required", True) and any(slug_name(u["name"]) == f["name"] for u in user_fields):
            lost.append(f["name"])
    if lost or not fields:
        raise ProgramError(f"no locator for {', '.join(lost) or 'any field'}")
    template = {"id": "page", "multiRecord": multi, "fields": fields} | ({"matchHeuristic": roots} if roots else {})
    program = {"strategyVersion": "1.1.0", "createdBy": "compiler", "reason": "compile", "goal": goal, "target": {"entryUrl": entry, "scope": scope}, "pageTemplates": [template], "pagination": {"type": "none"}, "confidenceFloor": 0.8}
    read_program(program)
    return program


def repair_field(proposer, name: str, page: str, known: list[str]) -> str | None:
    """The first new locator that finds something, None if there is none."""
    fresh = [x for x in proposer.locators(name, page) if x not in known]
    found = resolving(fresh, page)
    return found[0] if found else None


def heal(proposer, program: dict, failed: list[tuple[str, str, str]], budget: int) -> tuple[dict, dict]:
    """The program with a locator for each failed (template, field, page) that could be repaired, and what was done.

    One attempt a field; attempts beyond the budget are exhausted. All calls and tokens count, those of failures too.
    """
    patches, done, asked = [], {"repaired": 0, "failed": 0, "exhausted": 0}, set()
    for template, name, page in failed:
        if (template, name) in asked:
            continue
        asked.add((template, name))
        if len(asked) > budget:
            done["exhausted"] += 1
            continue
        known = next((t["fields"][name]["locators"] for t in program["pageTemplates"] if t["id"] == template and name in t["fields"]), None)
        new = repair_field(proposer, name, page, known) if known is not None else None
        done["repaired" if new else "failed"] += 1
        if new:
            patches.append((template, name, new))
    return apply_repairs(program, patches), done
