"""Queries of the joins, aggregations, windows, set operations, graph and stateful operators, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pagewright.functions import scalars as S
from pagewright.functions import transforms as X
from pagewright.functions import urls as U
from pagewright.operators import crawl, extract, metrics, record_diff, robots, stateful
from pagewright.operators.prefix import running
from pagewright.plans.program import read_program
from pagewright.plans.queries_scalar import HOST, PATH, QUERY, sql_canonical, sql_origin
from pagewright.plans.registry import Registry
from pagewright.sources import sinks
from pagewright.sources.tables import table as t

R = Registry()
n = lambda: F.count(F.lit(1))


# --- joins -------------------------------------------------------------------------------------------------------------


def two_runs(spark, d):
    """lineitem as two runs: the first lacks every 7th part, the second every 11th and has another tax for every 5th."""
    items = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    before = items.filter("l_partkey % 7 <> 0")
    after = items.filter("l_partkey % 11 <> 0").withColumn("l_tax", F.when(F.col("l_partkey") % 5 == 0, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return before, after


TWO_RUNS = """with a as (select l_orderkey, l_linenumber, l_quantity, l_tax, true as was from lineitem where l_partkey % 7 <> 0),
 b as (select l_orderkey, l_linenumber, l_quantity, case when l_partkey % 5 = 0 then l_tax + 1 else l_tax end as l_tax, true as is_ from lineitem where l_partkey % 11 <> 0),
 d as (select coalesce(a.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) as l_linenumber,
   case when was is null then 'added' when is_ is null then 'removed' when a.l_quantity is distinct from b.l_quantity or a.l_tax is distinct from b.l_tax then 'changed' else 'unchanged' end as kind
   from a full join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber) """


@R.query("ref_J1_D1_D2_run_diff", TWO_RUNS + "select l_orderkey, l_linenumber, kind from d")
def _(spark, d):
    return record_diff.diff_records(*two_runs(spark, d), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "kind")


@R.query("ref_J1_run_diff_counts", TWO_RUNS + "select count(*) filter (kind = 'added') as added, count(*) filter (kind = 'removed') as removed, count(*) filter (kind = 'changed') as changed, count(*) filter (kind = 'unchanged') as unchanged from d")
def _(spark, d):
    return record_diff.diff_counts(record_diff.diff_records(*two_runs(spark, d), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"]))


@R.query("ref_J2_program_relation", "select o.page_id, count(distinct o.template_id || '|' || o.field_name) as fields from outcomes o join pages p on o.page_id = p.page_id group by o.page_id")
def _(spark, d):
    """Fields that a program asks of every page: pages meet the exploded program."""
    asked = t(spark, d, "outcomes").select("page_id", "template_id", "field_name").distinct()
    return t(spark, d, "pages").select("page_id").join(asked, "page_id").groupBy("page_id").agg(n().alias("fields"))


ROBOTS = "# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /*-0x1*\nDisallow: /*-0x1\nDisallow: /*0x2*/*a\nAllow: /*0x2*/*ra$\nDisallow:\nCrawl-delay: 2\nSitemap: /map.xml\n"


def robots_files(spark, d):
    return t(spark, d, "site").select(F.concat(F.lit("https://"), "host").alias("origin"), F.lit(ROBOTS).alias("text"))


_path = f"({PATH.format('url')})"
ROBOTS_SQL = f"""with m as (select page_id, url, regexp_matches({_path}, '^/.*-0x1.*') as a1, regexp_matches({_path}, '^/.*-0x1') as d1, regexp_matches({_path}, '^/.*0x2.*/.*a') as d2, regexp_matches({_path}, '^/.*0x2.*/.*ra$') as a2 from pages)
 select page_id, case when not s then 'fetch' when a2 then 'fetch' when d2 then 'skip' when a1 then 'fetch' when d1 then 'skip' else 'fetch' end as decision, case when s and not a2 and d2 then '/*0x2*/*a' end as rule
 from (select m.*, host is not null as s from m left join site on host = {HOST.format('url')})"""


@R.query("ref_J3_W4_P10_robots_decision", ROBOTS_SQL)
def _(spark, d):
    return robots.robots_decision(t(spark, d, "pages").select("page_id", "url"), robots_files(spark, d), "pagewright/1.0").select("page_id", "decision", "rule")


@R.query("ref_P11_robots_bypass", f"select 'robots-bypass' as kind, url, 'warn' as policy, rule from ({ROBOTS_SQL.replace('select page_id, case', 'select url, case')}) where decision = 'skip'")
def _(spark, d):
    return robots.bypass_events(robots.robots_decision(t(spark, d, "pages").select("url"), robots_files(spark, d), "pagewright/1.0", "warn"), "warn")


@R.query("ref_S11_F40_robots_rules", "select 'https://' || host as origin, g as group_id, kind, pattern, regex from site, (values (1, 'disallow', '/', '^/'), (2, 'allow', '/*-0x1*', '^/.*-0x1.*'), (2, 'disallow', '/*-0x1', '^/.*-0x1'), (2, 'disallow', '/*0x2*/*a', '^/.*0x2.*/.*a'), (2, 'allow', '/*0x2*/*ra$', '^/.*0x2.*/.*ra$')) r(g, kind, pattern, regex)")
def _(spark, d):
    rules = robots.robots_rules(robots.robots_lines(robots_files(spark, d)))
    return rules.select("origin", F.col("group_id").cast("int").alias("group_id"), "kind", "pattern", "regex")


@R.query("ref_W5_robots_group", "select 'https://' || host as origin, 2 as group_id, 2.0::double as crawl_delay from site")
def _(spark, d):
    chosen = robots.chosen_group(robots.robots_agents(robots.robots_lines(robots_files(spark, d))), "pagewright/1.0")
    return chosen.select("origin", F.col("group_id").cast("int").alias("group_id"), "crawl_delay")


@R.query("ref_J4_frontier_antijoin", f"select distinct {sql_canonical('j.url')} as canonical_key from (select starting_url as url from crawl_job union all select page_url from extracted_record) j where {sql_canonical('j.url')} not in (select {sql_canonical('url')} from pages where url is not null)")
def _(spark, d):
    seen = t(spark, d, "pages").select(U.canonical(F.col("url")).alias("canonical_key"))
    found = t(spark, d, "crawl_job").select(F.col("starting_url").alias("url")).unionByName(t(spark, d, "extracted_record").select(F.col("page_url").alias("url")))
    return found.select(U.canonical(F.col("url")).alias("canonical_key")).distinct().join(seen, "canonical_key", "left_anti").filter("canonical_key IS NOT NULL")


@R.query("ref_J5_frontier_fetch", f"select e.key as canonical_key, coalesce(p.status, -1) as status from (select distinct {sql_canonical('page_url')} as key from extracted_record) e left join (select {sql_canonical('url')} as key, max(status) as status from pages group by 1) p on e.key = p.key")
def _(spark, d):
    """Every address of the frontier with what was fetched for it; -1 where nothing was."""
    pages = t(spark, d, "pages").groupBy(U.canonical(F.col("url")).alias("canonical_key")).agg(F.max("status").alias("status"))
    front = t(spark, d, "extracted_record").select(U.canonical(F.col("page_url")).alias("canonical_key")).distinct()
    return front.join(pages, "canonical_key", "left").select("canonical_key", F.coalesce("status", F.lit(-1)).alias("status"))


_key = f"({sql_origin('url')} || regexp_replace({PATH.format('url')}, '(.)/$', '\\1') || case when {QUERY.format('url')} = '' then '' else '?' || {QUERY.format('url')} end)"


@R.query("ref_J6_G5_D3_discovery_merge", f"select key, source from (select {_key} as key, source, row_number() over (partition by {_key} order by p, ord, url) as r from (select page_url as url, 'nav' as source, 2 as p, record_index as ord from extracted_record union all select url, 'sitemap', 0, page_id from pages union all select starting_url, 'probe', 1, 0 from crawl_job)) where r = 1 and key is not null")
def _(spark, d):
    parts = [
        t(spark, d, "extracted_record").select(F.col("page_url").alias("url"), F.lit("nav").alias("source"), F.col("record_index").cast("long").alias("ord")),
        t(spark, d, "pages").select("url", F.lit("sitemap").alias("source"), F.col("page_id").alias("ord")),
        t(spark, d, "crawl_job").select(F.col("starting_url").alias("url"), F.lit("probe").alias("source"), F.lit(0).cast("long").alias("ord")),
    ]
    return crawl.merge_discovered(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("key", "source").filter("key IS NOT NULL")


@R.query("ref_J7_M1_schema_merge", "select job_id, name, min(who) as who from (select job_id, unnest(from_json(requested_fields, '[\"VARCHAR\"]')) as name, 'a-user' as who from crawl_job union all select r.job_id, unnest(json_keys(payload)), 'b-seen' from extracted_record e join crawl_run r on e.run_id = r.run_id) group by job_id, name")
def _(spark, d):
    """Fields of a job: those the user asked for win over those that were found."""
    user = t(spark, d, "crawl_job").select("job_id", F.explode(F.from_json("requested_fields", "array<string>")).alias("name"), F.lit("a-user").alias("who"))
    runs = t(spark, d, "crawl_run").select("run_id", "job_id")
    keys = t(spark, d, "extracted_record").select("run_id", F.explode(F.json_object_keys("payload")).alias("name")).distinct()
    return user.unionByName(keys.join(runs, "run_id").select("job_id", "name", F.lit("b-seen").alias("who"))).groupBy("job_id", "name").agg(F.min("who").alias("who"))


@R.query("ref_J8_M2_unresolved", "select distinct template_id, field_name from outcomes where field_name not in (select field_name from outcomes where ok) union select distinct template_id, field_name from outcomes where not ok")
def _(spark, d):
    """Fields of a template that failed somewhere."""
    return t(spark, d, "outcomes").filter("NOT ok").select("template_id", "field_name").distinct()


@R.query("ref_J9_C7_A20_positional_eval", """with e as (select page_id, template_id, field_name, row_number() over (partition by page_id, template_id, field_name order by outcome_id) as i, value from outcomes where outcome_id % 2 = 0),
 a as (select page_id, template_id, field_name, row_number() over (partition by page_id, template_id, field_name order by outcome_id) as i, value from outcomes where outcome_id % 2 = 1)
 select coalesce(e.page_id, a.page_id) as page_id, coalesce(e.template_id, a.template_id) as template_id, coalesce(e.field_name, a.field_name) as field_name, coalesce(e.i, a.i) as place,
  case when a.i is null then 'missing' when e.i is null then 'extra' when e.value is distinct from a.value then 'value-mismatch' else 'ok' end as verdict
 from e full join a on e.page_id = a.page_id and e.template_id = a.template_id and e.field_name = a.field_name and e.i = a.i""")
def _(spark, d):
    """Two halves of the outcomes held against each other by place, as expected and actual records are."""
    def side(odd, value):
        half = t(spark, d, "outcomes").filter(F.col("outcome_id") % 2 == odd).select("outcome_id", "page_id", "template_id", "field_name", F.col("value").alias(value), F.lit(True).alias(value + "_is"))
        return record_diff.with_place(half, ["page_id", "template_id", "field_name"], ["outcome_id"]).withColumn("place", F.col("place") + 1).drop("outcome_id")

    both = side(0, "expected").join(side(1, "actual"), ["page_id", "template_id", "field_name", "place"], "full_outer")
    verdict = F.when(F.col("actual_is").isNull(), "missing").when(F.col("expected_is").isNull(), "extra").when(~F.col("expected").eqNullSafe(F.col("actual")), "value-mismatch").otherwise("ok")
    return both.select("page_id", "template_id", "field_name", "place", verdict.alias("verdict"))


@R.query("ref_J11_C4_F42_program_diff", None)
def _(spark, d):
    """Path-wise difference of every program from the version before: job_id, version, path, op, old, new."""
    from pagewright.plans.program import leaves

    flat = F.udf(lambda x: _leaves(x, leaves), T.MapType(T.StringType(), T.StringType()), useArrow=True)
    programs = t(spark, d, "strategy_config").groupBy("job_id", "version").agg(F.max("payload").alias("payload"))
    order = W.partitionBy("job_id").orderBy("version")
    programs = programs.withColumn("next", F.lead("version").over(order)).withColumn("leaves", flat("payload"))
    now = programs.withColumn("previous", F.lag("version").over(order)).filter("previous IS NOT NULL").select("job_id", "version", F.explode("leaves").alias("path", "value"))
    before = programs.filter("next IS NOT NULL").select("job_id", F.col("next").alias("version"), F.explode("leaves").alias("path", "value"))
    return record_diff.leaf_diff(before, now, ["job_id", "version"])


def _leaves(text, leaves):
    import json

    try:
        return leaves(json.loads(text))
    except (TypeError, ValueError):
        return {}


@R.query("ref_J12_M6_patches", "select o.template_id, o.field_name, array_to_string(list_sort(list_distinct(list(o.locator) || list('.patched-' || o.field_name))), '|') as locators from (select distinct template_id, field_name, locator from outcomes where locator is not null) o group by o.template_id, o.field_name")
def _(spark, d):
    """The locators of a field with a repair appended; a known one is not taken twice."""
    known = t(spark, d, "outcomes").filter("locator IS NOT NULL").groupBy("template_id", "field_name").agg(F.collect_set("locator").alias("locators"))
    patches = known.select("template_id", "field_name", F.array(F.concat(F.lit(".patched-"), "field_name")).alias("new"))
    merged = known.join(patches, ["template_id", "field_name"], "left").withColumn("locators", F.array_sort(F.array_union("locators", F.coalesce("new", F.array()))))
    return merged.select("template_id", "field_name", F.concat_ws("|", "locators").alias("locators"))


@R.query("ref_J13_J14_lookup", "select user_id, sum(coalesce(w, 0)) as weight from events left join (values ('click', 1), ('view', 2), ('purchase', 5)) k(event_type, w) on events.event_type = k.event_type group by user_id")
def _(spark, d):
    """A small dimension looked up, zero for what it does not know."""
    dim = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 5)], "event_type string, w int")
    return t(spark, d, "events").join(dim, "event_type", "left").groupBy("user_id").agg(F.sum(F.coalesce("w", F.lit(0))).alias("weight"))


@R.query("ref_S8_S9_J16_auto_tier", "select page_id, case when status in (401, 403, 429, 503) or (status < 400 and not contains(coalesce(cleaned_html, ''), '<article')) then 'headless' else 'static' end as tier, case when status in (401, 403, 429, 503) then 't0-blocked' when status < 400 and not contains(coalesce(cleaned_html, ''), '<article') then 'missing-fingerprint' else 't0-ok' end as reason from pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", crawl.auto_tier(F.col("status"), F.col("cleaned_html"), ["<article"]).alias("x")).select("page_id", "x.*")


@R.query("ref_S14_P16_path_probe", f"""with p as (select 'https://' || host as origin, x.path from site, (values {', '.join(f"('{x}')" for x in crawl.DOC_PATHS)}) x(path))
 select p.origin, p.path, coalesce(bool_or(status between 200 and 299 and length(cleaned_html) >= 256), false) as resolved from p left join pages on starts_with(pages.url, p.origin || p.path || '/') group by p.origin, p.path""")
def _(spark, d):
    """Whether a page of substance stands under each usual path of each site: an equi-join on origin and first segment."""
    probes = crawl.probe_paths(t(spark, d, "site").select(F.concat(F.lit("https://"), "host").alias("origin")))
    u = U.split_url(F.col("url"))
    pages = t(spark, d, "pages").select(U.origin(F.col("url")).alias("origin"), F.regexp_extract(u["path"], "^(/[^/]*)/", 1).alias("path"), crawl.probe_resolved(F.col("status"), F.col("cleaned_html")).alias("resolved"))
    pages = pages.groupBy("origin", "path").agg(F.max("resolved").alias("resolved"))
    return probes.join(pages, ["origin", "path"], "left").select("origin", "path", F.coalesce("resolved", F.lit(False)).alias("resolved"))


# --- aggregations ------------------------------------------------------------------------------------------------------


@R.query("ref_A1_field_coverage", "select template_id, field_name, count(*) as total, count(*) filter (ok) as hits, floor(avg(case when ok then 1.0 else 0.0 end) * 1000 + 0.5) / 1000 as coverage from outcomes group by template_id, field_name")
def _(spark, d):
    return metrics.field_coverage(t(spark, d, "outcomes"))


@R.query("ref_A2_D4_compliance", "select count(*) filter (event_type = 'error') as robots_bypass, count(*) filter (event_type = 'signup') as auth_attached, count(*) filter (event_type = 'purchase') as secret_accessed, 0 as redaction_applied, 0 as http_auth_failure, array_to_string(list_sort(list_distinct(list(event_type || '-key') filter (event_type = 'purchase'))), ',') as secrets from events")
def _(spark, d):
    kinds = F.when(F.col("event_type") == "error", "robots-bypass").when(F.col("event_type") == "signup", "auth-attached").when(F.col("event_type") == "purchase", "secret-accessed").otherwise("other")
    return metrics.compliance(t(spark, d, "events").select(kinds.alias("kind"), F.when(F.col("event_type") == "purchase", F.concat("event_type", F.lit("-key"))).alias("secret_name")))


@R.query("ref_A3_manifest", "select count(distinct page_id) as pages, count(distinct page_id || '|' || template_id || '|' || rec_idx) as records, count(*) filter (ok) as fields_ok, count(*) filter (not ok) as fields_failed from outcomes")
def _(spark, d):
    return metrics.manifest(t(spark, d, "outcomes"))


@R.query("ref_A4_cost_tokens", "select event_type as phase, count(*) as calls, cast(sum(event_id % 900) as bigint) as input_tokens, cast(sum(event_id % 70) as bigint) as output_tokens from events group by event_type")
def _(spark, d):
    usage = t(spark, d, "events").select(F.col("event_type").alias("phase"), (F.col("event_id") % 900).alias("input_tokens"), (F.col("event_id") % 70).alias("output_tokens"))
    return metrics.token_usage(usage)


@R.query("ref_A4_pages_by_tier", "select coalesce(tier_used, 'unknown') as tier, count(*) as n, count(distinct url) as urls from pages group by 1")
def _(spark, d):
    return t(spark, d, "pages").groupBy(F.coalesce("tier_used", F.lit("unknown")).alias("tier")).agg(n().alias("n"), F.count_distinct("url").alias("urls"))


@R.query("ref_A7_A8_O1_dashboard", "select count(*) as runs, cast(sum(pages_fetched) as bigint) as pages, count(*) filter (pages_extracted > 0 or (pages_fetched > 0 and status <> 'failed')) as successful, strftime(min(started_at), '%Y-%m-%d %H:%M:%S') as earliest, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') as latest from (select * from crawl_run order by started_at desc, run_id limit 200)")
def _(spark, d):
    """Totals over the newest 200 runs: the limit is the feature, as the dashboard shows no more."""
    top = metrics.latest_runs(t(spark, d, "crawl_run"), "started_at", "run_id", 200)
    good = metrics.run_success(F.col("pages_extracted"), F.col("pages_fetched"), F.when(F.col("status") == "failed", 1).otherwise(0))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return top.agg(n().alias("runs"), F.sum("pages_fetched").alias("pages"), F.count_if(good).alias("successful"), stamp(F.min("started_at")).alias("earliest"), stamp(F.max("started_at")).alias("latest"))


@R.query("ref_P14_P20_run_rows", "select run_id, pages_extracted > 0 or (pages_fetched > 0 and status <> 'failed') as successful, coalesce(cast(epoch(finished_at) - epoch(started_at) as bigint), 0) as seconds from crawl_run")
def _(spark, d):
    good = metrics.run_success(F.col("pages_extracted"), F.col("pages_fetched"), F.when(F.col("status") == "failed", 1).otherwise(0))
    seconds = F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return t(spark, d, "crawl_run").select("run_id", good.alias("successful"), F.coalesce(seconds, F.lit(0)).alias("seconds"))


@R.query("ref_A9_audit_counts", "select k.kind, count(e.event_id) as n from (values ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('never')) k(kind) left join events e on e.event_type = k.kind group by k.kind")
def _(spark, d):
    return metrics.audit_counts(t(spark, d, "events"), ["click", "error", "purchase", "signup", "view", "never"], "event_type")


@R.query("ref_A10_A11_template_counts", "select template_id, count(distinct page_id || '|' || rec_idx) as records, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed from outcomes group by template_id")
def _(spark, d):
    return t(spark, d, "outcomes").groupBy("template_id").agg(F.count_distinct(F.struct("page_id", "rec_idx")).alias("records"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


@R.query("ref_A12_A13_eval_totals", "with r as (select page_id, template_id, rec_idx, bool_and(coalesce(ok, false)) as good, count(*) filter (ok) as fields_ok, count(*) filter (not ok) as fields_failed from outcomes group by 1, 2, 3), p as (select page_id, bool_and(good) as good, sum(fields_ok) as fields_ok, sum(fields_failed) as fields_failed from r group by 1) select count(*) as pages, count(*) filter (good) as pages_passed, cast(sum(fields_ok) as bigint) as fields_ok, cast(sum(fields_failed) as bigint) as fields_failed from p")
def _(spark, d):
    record = t(spark, d, "outcomes").groupBy("page_id", "template_id", "rec_idx").agg(F.every(F.coalesce("ok", F.lit(False))).alias("good"), F.count_if("ok").alias("y"), F.count_if(~F.col("ok")).alias("x"))
    page = record.groupBy("page_id").agg(F.every("good").alias("good"), F.sum("y").alias("y"), F.sum("x").alias("x"))
    return page.agg(n().alias("pages"), F.count_if("good").alias("pages_passed"), F.sum("y").alias("fields_ok"), F.sum("x").alias("fields_failed"))


@R.query("ref_A14_W15_C2_latest_version", "select job_id, max(version) as latest, max(version) + 1 as next, arg_max(created_by, version) as created_by from strategy_config group by job_id")
def _(spark, d):
    return t(spark, d, "strategy_config").groupBy("job_id").agg(F.max("version").alias("latest"), (F.max("version") + 1).alias("next"), F.max_by("created_by", "version").alias("created_by"))


@R.query("ref_A16_A17_scope_estimate", f"select r.job_id, count(distinct {sql_canonical('page_url')}) as links, count(distinct template_id) as templates, cast(sum(length(payload)) as bigint) as size from extracted_record e join crawl_run r on e.run_id = r.run_id group by r.job_id")
def _(spark, d):
    runs = t(spark, d, "crawl_run").select("run_id", "job_id")
    rows = t(spark, d, "extracted_record").select("run_id", U.canonical(F.col("page_url")).alias("key"), "template_id", F.length("payload").alias("size"))
    return rows.join(runs, "run_id").groupBy("job_id").agg(F.count_distinct("key").alias("links"), F.count_distinct("template_id").alias("templates"), F.sum("size").alias("size"))


@R.query("ref_A18_heal_usage", "select user_id, count(*) filter (event_type <> 'view') as calls, cast(sum(case when event_type = 'purchase' then event_id % 50 else 0 end) as bigint) as tokens from events group by user_id")
def _(spark, d):
    tokens = F.sum(F.when(F.col("event_type") == "purchase", F.col("event_id") % 50).otherwise(0))
    return t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("calls"), tokens.alias("tokens"))


@R.query("ref_A19_P17_redesign_ratio", "select job_id, count(*) as runs, avg(case when status = 'failed' then 1.0 else 0.0 end) as ratio, count(*) >= 4 and avg(case when status = 'failed' then 1.0 else 0.0 end) >= 0.5 as likely_redesign from crawl_run group by job_id")
def _(spark, d):
    ratio = F.avg((F.col("status") == "failed").cast("double"))
    return t(spark, d, "crawl_run").groupBy("job_id").agg(n().alias("runs"), ratio.alias("ratio"), ((n() >= 4) & (ratio >= 0.5)).alias("likely_redesign"))


@R.query("ref_A22_progress", "select run_id, cast(coalesce(sum(pages_fetched) over w, 0) as bigint) as fetched, cast(coalesce(sum(pages_extracted) over w, 0) as bigint) as extracted from crawl_run window w as (partition by job_id order by started_at, run_id rows unbounded preceding)")
def _(spark, d):
    runs = t(spark, d, "crawl_run").select("run_id", "job_id", "started_at", F.col("pages_fetched").cast("long"), F.col("pages_extracted").cast("long"))
    d_ = running(runs, ["job_id"], ["started_at", "run_id"], {"fetched": F.col("pages_fetched"), "extracted": F.col("pages_extracted")})
    return d_.select("run_id", "fetched", "extracted")


# --- windows, sorts, sets ----------------------------------------------------------------------------------------------


@R.query("ref_W1_place_in_page", "select record_id, row_number() over (partition by run_id, page_url, template_id order by record_index, record_id) - 1 as place from extracted_record")
def _(spark, d):
    rows = t(spark, d, "extracted_record").select("record_id", "run_id", "page_url", "template_id", "record_index")
    return record_diff.with_place(rows, ["run_id", "page_url", "template_id"], ["record_index", "record_id"]).select("record_id", "place")


@R.query("ref_W2_W3_first_pass", "select page_id, template_id, rec_idx, field_name, arg_min(locator, locator_rank) filter (ok) as locator, case when bool_or(ok) then null else max(reason) end as reason from (select *, coalesce(locator_rank, 99) as lr from outcomes) group by 1, 2, 3, 4")
def _(spark, d):
    """The first locator that passed, else why the field failed; ties of rank give the same locator for a field."""
    good = F.when(F.col("ok") & F.col("locator_rank").isNotNull() & F.col("locator").isNotNull(), F.col("locator_rank"))
    key = ["page_id", "template_id", "rec_idx", "field_name"]
    return t(spark, d, "outcomes").groupBy(*key).agg(F.min_by("locator", good).alias("locator"), F.when(F.max("ok"), None).otherwise(F.max("reason")).alias("reason"))


@R.query("ref_W6_first_n", "select doc_id from (select doc_id, row_number() over (partition by lang, source order by doc_id) as r from documents) where r <= 2")
def _(spark, d):
    """The first two documents of each language and source, as a ranked top-k per group that Spark cuts before the shuffle."""
    w = W.partitionBy("lang", "source").orderBy("doc_id")
    return t(spark, d, "documents").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("doc_id")


@R.query("ref_W7_token_budget", "select doc_id from (select doc_id, row_number() over w as i, coalesce(sum(length(text) + 1) over w, 0) - 1 as used from documents window w as (partition by source order by doc_id rows unbounded preceding)) where used <= 4 * 3000 or i = 1")
def _(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("size"))
    d_ = running(docs, ["source"], ["doc_id"], {"used": F.col("size") + 1, "i": F.lit(1).cast("long")})
    return d_.filter("used - 1 <= 4 * 3000 OR i = 1").select("doc_id")


@R.query("ref_W8_T3_repair_budget", "select event_id, case when row_number() over (partition by user_id order by ts, event_id) <= 20 then 'attempt' else 'budget-exhausted' end as outcome from events")
def _(spark, d):
    return stateful.within_budget(t(spark, d, "events"), "user_id", ["ts", "event_id"], 20).select("event_id", "outcome")


@R.query("ref_W9_T4_redesign", "select event_id, count(*) over w as pages, cast(count(*) filter (event_type = 'error') over w as bigint) as failing_pages, count(*) over w >= 4 and count(*) filter (event_type = 'error') over w >= 0.5 * count(*) over w as likely_redesign from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def _(spark, d):
    events = t(spark, d, "events").withColumn("failing", F.col("event_type") == "error")
    return stateful.redesign(events, "user_id", "failing", ["ts", "event_id"]).select("event_id", "pages", "failing_pages", "likely_redesign")


@R.query("ref_W10_T1_failure_streak", "with a as (select event_id, user_id, ts, event_type = 'error' as bad, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events), b as (select event_id, cast(count(*) filter (bad) over (partition by user_id, island order by ts, event_id rows unbounded preceding) as bigint) as streak from a) select event_id, streak, case when streak > 0 then cast(least(60000.0, 1000 * pow(2.0, streak - 1)) as bigint) else 0 end as cooldown_ms from b")
def _(spark, d):
    events = t(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return stateful.failure_streaks(events, "user_id", "failed", ["ts", "event_id"]).select("event_id", "streak", "cooldown_ms")


@R.query("ref_W11_T1_earliest_start", "select event_id, lag(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) + 200 as earliest_ms from events")
def _(spark, d):
    events = t(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return stateful.earliest_start(events, "user_id", "ms", 200, ["ts", "event_id"]).select("event_id", "earliest_ms")


@R.query("ref_W12_D6_first_seen", f"select key as canonical_key, min(record_id) as record_id from (select record_id, {sql_canonical('page_url')} as key from extracted_record) group by key")
def _(spark, d):
    return t(spark, d, "extracted_record").groupBy(U.canonical(F.col("page_url")).alias("canonical_key")).agg(F.min("record_id").alias("record_id"))


@R.query("ref_W13_O6_page_cap", "select run_id from (select run_id, row_number() over (partition by job_id order by started_at, run_id) as r from crawl_run) where r <= 3")
def _(spark, d):
    w = W.partitionBy("job_id").orderBy("started_at", "run_id")
    return t(spark, d, "crawl_run").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("run_id")


@R.query("ref_G2_enqueue", f"""with c as (select e.record_id, r.job_id, e.page_url as url, e.record_index as depth, {sql_canonical('e.page_url')} as key, {sql_origin('e.page_url')} = {sql_origin('j.starting_url')} as inside
   from extracted_record e join crawl_run r on e.run_id = r.run_id join crawl_job j on r.job_id = j.job_id),
 k as (select *, case when key is null then 'malformed' when not inside then 'out-of-scope' when depth > 3 then 'past-max-depth' end as early from c),
 f as (select job_id, key, min(record_id) as first_id from k where early is null group by 1, 2),
 p as (select *, row_number() over (partition by job_id order by first_id) as place from f)
 select k.record_id, case when early is not null then early when p.place > 50 then 'past-max-pages' when p.first_id <> k.record_id then 'duplicate' end as reject_reason from k left join p on k.job_id = p.job_id and k.key = p.key""")
def _(spark, d):
    """Every address that the records name, offered to the frontier of its job; what the cap refused, it refuses again."""
    return offered(spark, d)


def offered(spark, d, seen=None):
    runs = t(spark, d, "crawl_run").join(t(spark, d, "crawl_job").select("job_id", "starting_url"), "job_id").select("run_id", "job_id", "starting_url")
    c = t(spark, d, "extracted_record").join(runs, "run_id").select("job_id", "starting_url", F.col("page_url").alias("url"), F.col("record_index").alias("depth"), F.col("record_id").alias("arrival"))
    return crawl.enqueue(c, F.col("starting_url"), F.lit("site"), 3, 50, ["job_id"], seen).select(F.col("arrival").alias("record_id"), "reject_reason")


@R.query("ref_G2_enqueue_seen", f"""with c as (select e.record_id, r.job_id, e.record_index as depth, {sql_canonical('e.page_url')} as key, {sql_origin('e.page_url')} = {sql_origin('j.starting_url')} as inside
   from extracted_record e join crawl_run r on e.run_id = r.run_id join crawl_job j on r.job_id = j.job_id),
 s as (select distinct job_id, key from c where depth = 0 and key is not null), u as (select job_id, count(*) as used from s group by job_id),
 k as (select *, case when key is null then 'malformed' when not inside then 'out-of-scope' when depth > 3 then 'past-max-depth' end as early from c),
 f as (select job_id, key, min(record_id) as first_id from k where early is null and (job_id, key) not in (select job_id, key from s) group by 1, 2),
 p as (select f.*, row_number() over (partition by f.job_id order by first_id) + coalesce(used, 0) as place from f left join u on f.job_id = u.job_id)
 select k.record_id, case when early is not null then early when s.key is not null then 'duplicate' when p.place > 50 then 'past-max-pages' when p.first_id <> k.record_id then 'duplicate' end as reject_reason
 from k left join p on k.job_id = p.job_id and k.key = p.key left join s on k.job_id = s.job_id and k.key = s.key""")
def _(spark, d):
    """The same after the first records of all pages were accepted in an earlier level: they count against the cap."""
    runs = t(spark, d, "crawl_run").join(t(spark, d, "crawl_job").select("job_id"), "job_id").select("run_id", "job_id")
    first = t(spark, d, "extracted_record").filter("record_index = 0").join(runs, "run_id").select("job_id", U.canonical(F.col("page_url")).alias("canonical_key"))
    return offered(spark, d, first.filter("canonical_key IS NOT NULL"))


@R.query("ref_O3_sorted_params", f"select record_id, array_to_string(list_sort(list_filter(string_split({QUERY.format('page_url')}, '&'), lambda p: p <> '')), '&') as params from extracted_record")
def _(spark, d):
    params = F.filter(F.split(U.split_url(F.col("page_url"))["query"], "&"), lambda p: p != "")
    return t(spark, d, "extracted_record").select("record_id", F.concat_ws("&", F.array_sort(params)).alias("params"))


@R.query("ref_P21_O4_metadata", "select distinct job_id, version, created_by, reason from strategy_config")
def _(spark, d):
    return t(spark, d, "strategy_config").select("job_id", "version", "created_by", "reason").distinct()


@R.query("ref_D5_J10_key_union", "select run_id, template_id, count(distinct k) as keys from (select run_id, template_id, unnest(json_keys(payload)) as k from extracted_record) group by 1, 2")
def _(spark, d):
    keys = t(spark, d, "extracted_record").select("run_id", "template_id", F.explode(F.json_object_keys("payload")).alias("k"))
    return keys.groupBy("run_id", "template_id").agg(F.count_distinct("k").alias("keys"))


@R.query("ref_D8_content_dedup", "select doc_id from (select doc_id, row_number() over (partition by sha256(regexp_replace(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), '^ | $', '', 'g')) order by doc_id) as r from documents where text is not null) where r = 1")
def _(spark, d):
    docs = t(spark, d, "documents").filter("text IS NOT NULL")
    return docs.groupBy(record_diff.content_key(F.col("text")).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@R.query("ref_K4_values", "select outcome_id, case when ok then value end as value from outcomes")
def _(spark, d):
    return t(spark, d, "outcomes").select("outcome_id", F.when(F.col("ok"), F.col("value")).alias("value"))


@R.query("ref_K5_column_union", "select name, min(record_id) as first_record from (select record_id, unnest(json_keys(payload)) as name from extracted_record) group by name")
def _(spark, d):
    return sinks.field_names(t(spark, d, "extracted_record"), "payload", ["record_id"]).select("name", F.col("first.record_id").alias("first_record"))


@R.query("ref_K2_csv_lines", "select outcome_id, concat_ws(',', case when regexp_matches(source_url, '[\",\\r\\n]') then '\"' || replace(source_url, '\"', '\"\"') || '\"' else coalesce(source_url, '') end, coalesce(template_id, ''), case when regexp_matches(value, '[\",\\r\\n]') then '\"' || replace(value, '\"', '\"\"') || '\"' else coalesce(value, '') end) as line from outcomes")
def _(spark, d):
    o = t(spark, d, "outcomes")
    return o.select("outcome_id", F.concat_ws(",", *[S.csv_cell(F.col(c)) for c in ("source_url", "template_id", "value")]).alias("line"))


@R.query("ref_K1_K6_json_records", None)
def _(spark, d):
    """One JSON object per outcome; key order and number style are the writer's own."""
    return sinks.json_records(t(spark, d, "outcomes"), ["field_name", "value", "ok"])


@R.query("ref_K3_markdown_rows", "select page_id, '| ' || replace(replace(coalesce(url, ''), '|', '\\|'), chr(10), ' ') || ' | ' || coalesce(cast(status as varchar), '') || ' |' as line from pages")
def _(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", F.concat(F.lit("| "), F.concat_ws(" | ", S.markdown_cell(F.col("url")), S.markdown_cell(F.col("status").cast("string"))), F.lit(" |")).alias("line"))


@R.query("ref_P8_confidence_partition", "select page_id, template_id, rec_idx, bool_or(ok and (not coalesce(grounded, false) or confidence < 0.8)) as review from (select page_id, template_id, rec_idx, coalesce(ok, false) as ok, grounded, coalesce(confidence, 1) as confidence from outcomes) group by 1, 2, 3")
def _(spark, d):
    o = t(spark, d, "outcomes").withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return extract.partition_by_confidence(o, 0.8)


@R.query("ref_P24_required_failed", "select distinct template_id, field_name from outcomes where not ok and field_name in ('title', 'price', 'author')")
def _(spark, d):
    required = spark.createDataFrame([("title",), ("price",), ("author",)], "field_name string")
    return t(spark, d, "outcomes").filter("NOT ok").join(required, "field_name", "left_semi").select("template_id", "field_name").distinct()


@R.query("ref_P13_T7_due", "select job_id from crawl_job where created_at + interval 7 day <= timestamp '2024-06-01'")
def _(spark, d):
    return t(spark, d, "crawl_job").filter("created_at + INTERVAL 7 DAYS <= TIMESTAMP_NTZ '2024-06-01'").select("job_id")


# --- graph, pages, streams ---------------------------------------------------------------------------------------------


@R.query("ref_G1_bfs", "with recursive e as (select distinct l_partkey as src, -l_suppkey as dst from lineitem where l_quantity > 45 union select distinct -l_suppkey, l_partkey from lineitem where l_quantity > 45), w as (select cast(1 as bigint) as node, 0 as depth union select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 3) select node, min(depth) as depth from w group by node")
def _(spark, d):
    """Parts and suppliers as a graph, searched from part 1 to depth 3; over the share of lineitem that recursive SQL can do."""
    return parts_and_suppliers(spark, t(spark, d, "lineitem").filter("l_quantity > 45"))


def parts_and_suppliers(spark, items):
    there = items.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"))
    edges = there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return crawl.crawl_levels(spark.createDataFrame([(1,)], "node long"), edges, 3)


@R.query("ref_G1_bfs_all", None)
def _(spark, d):
    """The search of ``ref_G1_bfs`` over the edges of every line."""
    return parts_and_suppliers(spark, t(spark, d, "lineitem"))


@R.query("ref_G6_pagination", "select job_id, starting_url || '?page=' || i as url from crawl_job, range(1, 4) r(i)")
def _(spark, d):
    return t(spark, d, "crawl_job").select("job_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"), "starting_url").select("job_id", F.concat("starting_url", F.lit("?page="), F.col("i").cast("string")).alias("url"))


PROGRAM = {
    "strategyVersion": "1.1.0", "goal": "titles", "target": {"entryUrl": "https://hub.orlinstead.example/", "scope": "site"},
    "pageTemplates": [{"id": "page", "fields": {
        "title": {"locators": ["article > h1", "h1"], "type": "string", "transform": "trim|normalizeWhitespace", "validate": "len > 0 && len < 400"},
        "first": {"locators": ["//article/p[1]", "p"], "type": "string", "transform": "normalizeWhitespace"},
    }}, {"id": "card", "multiRecord": True, "matchHeuristic": "section.card", "fields": {
        "name": {"locators": ["h3"], "type": "string"}, "price": {"locators": ["div.price", ".price"], "type": "number", "transform": "stripCurrency|toFloat", "validate": "value > 0"},
    }}],
}


@R.query("ref_H7_H10_execute", None)
def _(spark, d):
    """A program over every page: outcomes with the first locator that passes, score and reason. Held against a page-at-a-time
    extraction in the tests, as DuckDB has no DOM."""
    return extract.execute(t(spark, d, "pages"), read_program(PROGRAM), "cleaned_html").drop("attempts")


@R.query("ref_H9_title", r"""select page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(cleaned_html, '<article><h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')), '') as title from pages where starts_with(cleaned_html, '<article><h1>') and not regexp_matches(regexp_extract(cleaned_html, '<article><h1>(.*?)</h1>', 1), '[<\x{00A0}\x{2000}-\x{3000}\x{FEFF}\x{0085}\x{001C}-\x{001F}]|&[A-Za-z]{5,}|&#') and not contains(cleaned_html, '﻿')""")
def _(spark, d):
    pages = t(spark, d, "pages").filter(F.startswith("cleaned_html", F.lit("<article><h1>")))
    odd = F.rlike(F.regexp_extract("cleaned_html", "<article><h1>(.*?)</h1>", 1), F.lit("[<\\x{00A0}\\x{2000}-\\x{3000}\\x{FEFF}\\x{0085}\\x{001C}-\\x{001F}]|&[A-Za-z]{5,}|&#"))
    program = read_program(PROGRAM | {"pageTemplates": [{"id": "page", "fields": {"title": PROGRAM["pageTemplates"][0]["fields"]["title"] | {"validate": None}}}]})
    return extract.execute(pages.filter(~odd), program, "cleaned_html").select("page_id", F.nullif(F.col("value"), F.lit("")).alias("title"))


@R.query("ref_H9_title_all", None)
def _(spark, d):
    """The title field with its rule over every page, null where no locator passes; ``ref_H9_title`` is the part of it that a
    regular expression can say."""
    program = read_program(PROGRAM | {"pageTemplates": [{"id": "page", "fields": {"title": PROGRAM["pageTemplates"][0]["fields"]["title"]}}]})
    return extract.execute(t(spark, d, "pages"), program, "cleaned_html").select("page_id", F.col("value").alias("title"))


@R.query("ref_H1_clean", None)
def _(spark, d):
    """Every page without boilerplate: markup, text, title, language."""
    return extract.page_struct(t(spark, d, "pages"), "cleaned_html")


@R.query("ref_H4_markdown", None)
def _(spark, d):
    return extract.page_markdown(t(spark, d, "pages"), "cleaned_html")


@R.query("ref_H5_H6_budget", None)
def _(spark, d):
    """The top elements of every page that fit a budget of 500 tokens, at most two of a shape."""
    return extract.fit_budget(extract.page_regions(t(spark, d, "pages"), "cleaned_html"), 500)


@R.query("ref_A15_shapes", None)
def _(spark, d):
    return extract.page_regions(t(spark, d, "pages"), "cleaned_html").groupBy("shape").agg(n().alias("regions"), F.count_distinct("page_id").alias("pages"))


@R.query("ref_H11_F23_links", "select distinct page_id, case when starts_with(h, '/') then regexp_extract(url, '^(https?://[^/]+)', 1) || h else h end as url from (select page_id, url, unnest(regexp_extract_all(cleaned_html, '<a href=\"([^\"]*)\"', 1)) as h from pages) where h <> ''")
def _(spark, d):
    """The distinct links of every page."""
    return extract.distinct_links(extract.page_links(t(spark, d, "pages"), "cleaned_html")).select("page_id", "url")


@R.query("ref_H13_W14_O2_nav", None)
def _(spark, d):
    return crawl.nav_links(extract.page_links(t(spark, d, "pages"), "cleaned_html"))


@R.query("ref_H14_H15_locators", "select page_id, locator, case locator when 'td' then (length(cleaned_html) - length(replace(cleaned_html, '<td>', ''))) // 4 else (length(cleaned_html) - length(replace(cleaned_html, '<li>', ''))) // 4 end as matches from pages, (values ('td'), ('//li')) l(locator) where cleaned_html is not null and not contains(cleaned_html, '<!--')")
def _(spark, d):
    pages = t(spark, d, "pages").filter("cleaned_html IS NOT NULL").filter(~F.contains("cleaned_html", F.lit("<!--")))
    return extract.probe_locators(pages, ["td", "//li"], "cleaned_html").select("page_id", "locator", F.col("matches").cast("long").alias("matches"))


@R.query("ref_H16_S12_sitemap", "select host, 'https://' || host || p as loc, m as lastmod from site, (values ('/a', '2025-01-01'), ('/b', '2025-02-01')) x(p, m)")
def _(spark, d):
    """Addresses of sitemaps, read with the built-in XPath of well-formed XML."""
    from pagewright.sources.sitemaps import sitemap_entries

    entry = lambda p, m: F.concat(F.lit("<url><loc> https://"), "host", F.lit(f"{p} </loc><lastmod>{m}</lastmod></url>"))
    files = t(spark, d, "site").select("host", F.concat(F.lit("<urlset>"), entry("/a", "2025-01-01"), entry("/b", "2025-02-01"), F.lit("</urlset>")).alias("xml"))
    return sitemap_entries(files, "xml").select("host", "loc", "lastmod")


@R.query("ref_S13_gzip", "select doc_id, length(text) as size from documents where text is not null")
def _(spark, d):
    """Texts packed and unpacked again: the body decoder over gzip and plain bodies."""
    from pagewright.sources.sitemaps import decoded, packed

    return t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length(decoded(packed("text"))).alias("size"))


@R.query("ref_T_tumbling", "select event_type, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from events group by 1, 2")
def _(spark, d):
    """Beyond the reference: events per hour and kind."""
    w = F.window("ts", "1 hour")
    return t(spark, d, "events").groupBy("event_type", w.alias("w")).agg(n().alias("n")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@R.query("ref_T_sessions", "with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as s from events), b as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from a) select user_id, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start from b group by user_id, k")
def _(spark, d):
    """Beyond the reference: visits of a user, half an hour apart."""
    w = F.session_window("ts", "30 minutes")
    return t(spark, d, "events").groupBy("user_id", w.alias("w")).agg(n().alias("n")).select("user_id", "n", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@R.query("ref_A_percentiles", None)
def _(spark, d):
    """Beyond the reference: median and 95th percentile of page sizes by tier, approximate."""
    size = F.length("cleaned_html")
    return t(spark, d, "pages").groupBy("tier_used").agg(F.percentile_approx(size, [0.5, 0.95], 1000).alias("size"), F.approx_count_distinct("url").alias("urls"))
