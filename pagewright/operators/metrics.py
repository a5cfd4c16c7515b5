"""What a run tells about itself: coverage, audit, cost in tokens, manifest, dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.scalars import half_up

# Kinds of audit events.
AUDIT_KINDS = ["robots-bypass", "auth-attached", "secret-accessed", "redaction-applied", "http-auth-failure"]


def field_coverage(outcomes: DataFrame) -> DataFrame:
    """Share of outcomes of a field that are ok, to three places."""
    rate = F.avg(F.coalesce("ok", F.lit(False)).cast("double"))
    return outcomes.groupBy("template_id", "field_name").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("hits"), half_up(rate, 3).alias("coverage"))


def audit_counts(events: DataFrame, kinds: list[str], kind: str = "kind") -> DataFrame:
    """Events of every kind, zero for those that did not occur."""
    dim = events.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    n = events.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def compliance(events: DataFrame) -> DataFrame:
    """One row: counts of the audit kinds and the distinct secrets' names in order."""
    names = F.concat_ws(",", F.array_sort(F.collect_set("secret_name")))
    return events.agg(*[F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in AUDIT_KINDS], names.alias("secrets"))


def token_usage(usage: DataFrame, phase: str = "phase") -> DataFrame:
    return usage.groupBy(phase).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def manifest(outcomes: DataFrame) -> DataFrame:
    """One row of counts over outcomes."""
    return outcomes.agg(
        F.count_distinct("page_id").alias("pages"), F.count_distinct(F.struct("page_id", "template_id", "rec_idx")).alias("records"), F.count_if("ok").alias("fields_ok"), F.count_if(~F.col("ok")).alias("fields_failed")
    )


def run_success(records, pages, failed):
    """A run is a success if it made records, or fetched pages without a failure."""
    return (records > 0) | ((pages > 0) & (failed == 0))


def latest_runs(runs: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` runs; a top-k, so only k rows of each task are kept."""
    return runs.orderBy(F.desc(time), tie).limit(n)


def cost_breakdown(usage: DataFrame, pages: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (part, name, amount) of what a run took: calls and tokens by ``phase`` of ``usage`` (phase, input_tokens, output_tokens),
    pages by ``tier`` and the time of their fetches from ``pages`` (tier, timing_ms), records, and records for 1,000 tokens (0
    without any). Prices are not counted."""
    phase = usage.groupBy("phase").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"))
    by_phase = phase.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col("phase").alias("name"), F.coalesce(c, F.lit(0)).cast("double").alias("amount")) for n, c in (("calls", "calls"), ("input tokens", "input"), ("output tokens", "output"))])).alias("r")).select("r.*")
    tier = pages.groupBy(F.coalesce("tier", F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("amount")).select(F.lit("pages").alias("part"), "name", "amount")
    total = lambda df, c, part: df.agg(F.coalesce(c, F.lit(0)).cast("double").alias("amount")).select(F.lit(part).alias("part"), F.lit("all").alias("name"), "amount")
    tokens = usage.agg(F.coalesce(F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))), F.lit(0)).alias("tokens"), F.lit(1).alias("one"))
    count = records.agg(F.count(F.lit(1)).alias("records"), F.lit(1).alias("one"))
    rate = count.join(tokens, "one").select(F.lit("records for 1,000 tokens").alias("part"), F.lit("all").alias("name"), F.when(F.col("tokens") == 0, 0.0).otherwise(half_up(F.col("records") * 1000 / F.col("tokens"), 4)).alias("amount"))
    parts = [by_phase, tier, total(pages, F.sum("timing_ms"), "fetch ms"), total(records, F.count(F.lit(1)), "records"), rate]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def template_mismatch(expected, actual):
    """Whether a record came from another template than was asked for; never where none was."""
    return F.coalesce(expected != F.coalesce(actual, F.lit("")), F.lit(False))
