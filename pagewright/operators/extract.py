"""Extraction programs over pages.

Python does only what Catalyst cannot: one pass over a page parses it once and resolves every locator of the program. All
that follows — transform, coerce, validate, ground, score, choose the first locator that passes — is Columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import dom
from pagewright.functions.scalars import confidence, grounded_in
from pagewright.functions.transforms import coerce, let, normalize_whitespace, pipeline
from pagewright.plans.expression import compile_rule
from pagewright.plans.program import Program
from pagewright.sources.tables import spread

RAW = "page_id long, source_url string, template_id string, rec_idx int, source_text string, texts array<string>"


def resolve(pages: DataFrame, program: Program, html: str = "html", url: str = "url") -> DataFrame:
    """One row per page, template and record root: ``texts`` has the text of each distinct locator, null where it finds nothing.

    Null pages give one record of nulls, as an empty page does.
    """
    plan = [(t.id, t.multi, t.roots, list(dict.fromkeys(x for f in t.fields for x in f.locators))) for t in program.templates]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(t, m, [dom.compile_locator(x) for x in roots], [dom.compile_locator(x) for x in locs]) for t, m, roots, locs in plan]
        for batch in batches:
            rows = []
            for page_id, source, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                root = dom.parse_html(page if isinstance(page, str) else None)
                text = dom.text_of(root)
                for template, multi, roots, locs in compiled:
                    found = [root]
                    if roots:
                        seen: set = set()
                        found = [n for r in roots for n in r(root) if id(n) not in seen and not seen.add(id(n))]
                        found = found if multi else found[:1]
                    for k, r in enumerate(found):
                        rows.append((page_id, source, template, k, text, [dom.text_of(x[0]) if (x := loc(r)) else None for loc in locs]))
            yield pd.DataFrame(rows, columns=["page_id", "source_url", "template_id", "rec_idx", "source_text", "texts"])

    return spread(pages.select("page_id", F.col(url).alias("url"), F.col(html).alias("html"))).mapInPandas(each, RAW)


def _attempt(raw: Column, field, rank: int, source: Column) -> Column:
    """struct of one locator's attempt at a field. Each step is bound once, so that the plan stays small."""
    typed = {"number": "double", "integer": "long", "boolean": "boolean"}.get(field.type, "string")

    def judge(x: Column) -> Column:
        valid = compile_rule(field.validate, x["value"].try_cast(typed), field.type) if field.validate else F.lit(True)
        result = F.when(x["raw"].isNull(), "no-match").when(x["made"].isNull(), "transform-failed").when(x["value"].isNull(), "type-coercion-failed").when(~valid, "validation-failed").otherwise("ok")
        score = confidence(F.lit(rank), F.lit(len(field.locators)), x["reason"].isNull(), F.lit(bool(field.validate)))
        return F.struct(
            F.lit(rank).alias("locator_rank"), F.lit(field.locators[rank]).alias("locator"), x["raw"].alias("raw_text"), F.when(result == "ok", x["value"]).alias("value"), result.alias("result"),
            x["reason"].isNull().alias("grounded"), x["reason"].alias("grounding_reason"), score.alias("confidence"),
        )

    def values(x: Column) -> Column:
        value = let(x["made"], lambda made: coerce(made, field.type))
        return let(F.struct(x["raw"].alias("raw"), x["made"].alias("made"), value.alias("value"), grounded_in(normalize_whitespace(x["raw"]), source).alias("reason")), judge)

    return let(raw, lambda r: let(F.struct(r.alias("raw"), pipeline(field.transform)(r).cast("string").alias("made")), values))


def execute(pages: DataFrame, program: Program, html: str = "html", url: str = "url") -> DataFrame:
    """Outcomes of a program: a row per page, template, record and field with the first locator that passes, or with the
    last failure and all attempts."""
    raw = resolve(pages, program, html, url)
    # One pass for all templates: a row's template says which of the arrays of fields is worked out for it.
    fields = None
    for t in program.templates:
        locs = list(dict.fromkeys(x for f in t.fields for x in f.locators))
        own = []
        for n, f in enumerate(t.fields):
            attempts = F.array(*[_attempt(F.col("texts")[locs.index(x)], f, rank, F.col("source_text")) for rank, x in enumerate(f.locators)])
            own.append(F.struct(F.lit(n).alias("field_ord"), F.lit(f.name).alias("field_name"), F.lit(f.type).alias("value_type"), F.lit(f.required).alias("required"), attempts.alias("attempts")))
        mine = F.col("template_id") == t.id
        fields = F.when(mine, F.array(*own)) if fields is None else fields.when(mine, F.array(*own))
    out = raw.select("page_id", "source_url", "template_id", "rec_idx", F.inline(fields))
    passed = F.filter("attempts", lambda a: a["result"] == "ok")
    first = F.when(F.size(passed) > 0, passed[0])
    out = out.withColumn("first", first).withColumn("ok", F.col("first").isNotNull())
    reason = F.when(~F.col("ok"), F.element_at("attempts", -1)["result"])
    return out.select(
        "page_id", "source_url", "template_id", "rec_idx", "field_ord", "field_name", "value_type", "required", "ok", "first.value", "first.locator", "first.locator_rank", "first.raw_text",
        "first.grounded", "first.grounding_reason", "first.confidence", reason.alias("reason"), "attempts",
    )


def partition_by_confidence(outcomes: DataFrame, floor: float) -> DataFrame:
    """Outcomes with ``review``: a record goes there if any field that is ok is ungrounded or scores under the floor."""
    doubtful = F.col("ok") & (~F.coalesce("grounded", F.lit(False)) | (F.col("confidence") < floor))
    records = outcomes.groupBy("page_id", "template_id", "rec_idx").agg(F.max(doubtful).alias("review"))
    return records


def records(outcomes: DataFrame, program: Program) -> DataFrame:
    """One row per record with a column per field of the program."""
    names = list(dict.fromkeys(f.name for t in program.templates for f in t.fields))
    return outcomes.groupBy("page_id", "source_url", "template_id", "rec_idx").agg(*[F.max(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in names])


def page_struct(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id and html, text, readable, title, lang of the cleaned page."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"page_id": i} | dom.clean_page(x if isinstance(x, str) else None) for i, x in zip(batch["page_id"], batch["html"], strict=True)], columns=["page_id", "html", "text", "readable", "title", "lang"])

    return spread(pages.select("page_id", F.col(html).alias("html"))).mapInPandas(each, "page_id long, html string, text string, readable boolean, title string, lang string")


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos, url, text, region of every http(s) link of every page."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *x) for i, u, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True) for x in dom.links(page if isinstance(page, str) else None, u or "")]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "url", "text", "region"])

    return spread(pages.select("page_id", "url", F.col(html).alias("html"))).mapInPandas(each, "page_id long, pos int, url string, text string, region string")


def distinct_links(links: DataFrame) -> DataFrame:
    """page_id, pos, url, text, region of each link of a page once, where it stands first."""
    first = links.groupBy("page_id", "url").agg(F.min_by(F.struct("pos", "text", "region"), "pos").alias("f"))
    return first.select("page_id", "f.pos", "url", "f.text", "f.region")


def page_regions(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, pos, shape, html of the top elements of every page."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *x) for i, page in zip(batch["page_id"], batch["html"], strict=True) for x in dom.regions(page if isinstance(page, str) else None)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "shape", "html"])

    return spread(pages.select("page_id", F.col(html).alias("html"))).mapInPandas(each, "page_id long, pos int, shape string, html string")


def page_markdown(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id and the page as Markdown."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "markdown": [dom.markdown(x if isinstance(x, str) else None) for x in batch["html"]]})

    return spread(pages.select("page_id", F.col(html).alias("html"))).mapInPandas(each, "page_id long, markdown string")


def probe_locators(pages: DataFrame, locators: list[str], html: str = "html", sample: int = 120) -> DataFrame:
    """page_id, locator, resolves, matches, sample (at most ``sample`` characters) of every locator on every page."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(x, dom.compile_locator(x)) for x in locators]
        for batch in batches:
            rows = []
            for i, page in zip(batch["page_id"], batch["html"], strict=True):
                root = dom.parse_html(page if isinstance(page, str) else None)
                for name, loc in compiled:
                    found = loc(root)
                    text = dom.text_of(found[0]) if found else None
                    rows.append((i, name, bool(found), len(found), text if text is None or len(text) <= sample else text[:sample] + "…"))
            yield pd.DataFrame(rows, columns=["page_id", "locator", "resolves", "matches", "sample"])

    return spread(pages.select("page_id", F.col(html).alias("html"))).mapInPandas(each, "page_id long, locator string, resolves boolean, matches int, sample string")


def fit_budget(regions: DataFrame, budget: int, examples: int = 2) -> DataFrame:
    """Regions of a page that are kept for a token budget: the first ``examples`` of each shape, in order, as long as their
    length with line ends stays under four signs a token; the first is kept whatever its length."""
    from pyspark.sql import Window as W

    shape = regions.withColumn("nth", F.row_number().over(W.partitionBy("page_id", "shape").orderBy("pos"))).filter(F.col("nth") <= examples)
    page = W.partitionBy("page_id").orderBy("pos")
    run = shape.withColumn("end", F.sum(F.length("html") + 1).over(page.rowsBetween(W.unboundedPreceding, 0)) - 1).withColumn("first", F.row_number().over(page) == 1)
    return run.filter((F.col("end") <= 4 * budget) | F.col("first")).select("page_id", "pos", "shape", "html")
