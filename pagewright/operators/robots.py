"""robots.txt as tables, and its decisions as a join with the longest matching pattern."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.functions.scalars import glob_regex, without_comment
from pagewright.functions.urls import origin, path_and_query


def robots_lines(files: DataFrame) -> DataFrame:
    """origin, line, field, value, group_id of robots files (``origin``, ``text``). A group begins with a user-agent line
    that follows no other one directly, blank lines and comments aside; what stands before the first group has group 0."""
    lines = files.select("origin", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("line", "raw"))
    lines = lines.withColumn("raw", F.trim(without_comment(F.col("raw")))).filter(F.contains("raw", F.lit(":")))
    lines = lines.select("origin", "line", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("field"), F.trim(F.expr("substr(raw, instr(raw, ':') + 1)")).alias("value"))
    file = W.partitionBy("origin").orderBy("line")
    agent = F.col("field") == "user-agent"
    opens = agent & F.coalesce(F.lag("field").over(file) != "user-agent", F.lit(True))
    return lines.withColumn("group_id", F.sum(opens.cast("int")).over(file))


def robots_rules(lines: DataFrame) -> DataFrame:
    """origin, group_id, rule_ord, kind, pattern, regex; an empty disallow is no rule, nor is one before any group."""
    rules = lines.filter("field IN ('allow', 'disallow') AND group_id > 0 AND NOT (field = 'disallow' AND value = '')")
    return rules.select("origin", "group_id", F.col("line").alias("rule_ord"), F.col("field").alias("kind"), F.col("value").alias("pattern"), glob_regex(F.col("value")).alias("regex"))


def robots_agents(lines: DataFrame) -> DataFrame:
    """origin, group_id, user_agent (lower case), crawl_delay of the group (the last one given)."""
    delay = lines.filter("field = 'crawl-delay'").groupBy("origin", "group_id").agg(F.max_by(F.col("value").try_cast("double"), "line").alias("crawl_delay"))
    agents = lines.filter("field = 'user-agent'").select("origin", "group_id", "line", F.lower("value").alias("user_agent"))
    return agents.join(delay, ["origin", "group_id"], "left")


def sitemaps(lines: DataFrame) -> DataFrame:
    return lines.filter("field = 'sitemap' AND value <> ''").select("origin", F.col("value").alias("sitemap_url"))


def chosen_group(agents: DataFrame, user_agent: str) -> DataFrame:
    """origin, group_id, crawl_delay: the group whose agent is the longest prefix of ours (the first of equals), else the last ``*`` group."""
    ours = F.lit(user_agent.lower())
    fits = agents.filter((F.col("user_agent") == "*") | F.startswith(ours, F.col("user_agent")))
    star = F.col("user_agent") == "*"
    order = F.struct(~star, F.when(star, F.lit(0)).otherwise(F.length("user_agent")), F.when(star, F.col("line")).otherwise(-F.col("line")))
    return fits.groupBy("origin").agg(F.max_by(F.struct("group_id", "crawl_delay"), order).alias("g")).select("origin", "g.*")


def robots_decision(urls: DataFrame, files: DataFrame, user_agent: str, policy: str = "respect") -> DataFrame:
    """``urls`` (with ``url``) plus origin, allowed, rule and decision (fetch, skip, or bypass of a rule under warn or ignore).

    The join is an equi-join on the origin; a URL meets only the rules of its own site, and the longest pattern that
    matches wins, allow before disallow. No URL is compared with another, so a hot origin costs its rules times its URLs.
    """
    lines = robots_lines(files)
    rules = robots_rules(lines).join(chosen_group(robots_agents(lines), user_agent), ["origin", "group_id"])
    by_origin = rules.groupBy("origin").agg(F.collect_list(F.struct("kind", "pattern", "regex", "rule_ord")).alias("rules"))
    d = urls.withColumn("origin", origin(F.col("url"))).join(by_origin, "origin", "left")
    path = path_and_query(F.col("url"))
    hits = F.filter(F.coalesce("rules", F.expr("cast(array() as array<struct<kind:string,pattern:string,regex:string,rule_ord:int>>)")), lambda r: F.rlike(path, r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), (r["kind"] == "allow").alias("allow"), r["pattern"].alias("pattern"))))
    d = d.withColumn("best", best).withColumn("allowed", F.coalesce("best.allow", F.lit(True))).withColumn("rule", F.when(~F.col("allowed"), F.col("best.pattern")))
    decision = F.when(F.col("allowed"), "fetch").when(F.lit(policy == "respect"), "skip").otherwise("bypass")
    return d.drop("rules", "best").withColumn("decision", decision)


def bypass_events(decisions: DataFrame, policy: str) -> DataFrame:
    """Audit rows of the rules that were not kept."""
    return decisions.filter("decision = 'bypass'").select(F.lit("robots-bypass").alias("kind"), "url", F.lit(policy).alias("policy"), "rule")


def refreshed(cache: DataFrame, origins: DataFrame, answers: DataFrame, now: datetime, ttl: timedelta = timedelta(hours=24)) -> DataFrame:
    """The robots files of ``origins`` after a look at ``now``: origin, text, expires_at. An entry of ``cache`` holds until it
    expires; the others are taken from ``answers`` (origin, status, body) anew, and whatever is no 2xx allows all. Entries of
    other origins stay."""
    at = F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz")
    fresh = cache.filter(F.col("expires_at") > at)
    asked = origins.select("origin").distinct().join(fresh, "origin", "left_anti")
    text = F.when(F.col("status").between(200, 299), F.col("body"))
    got = answers.groupBy("origin").agg(F.max(text).alias("text"))
    new = asked.join(got, "origin", "left").select("origin", F.coalesce("text", F.lit("")).alias("text"), F.lit((now + ttl).replace(tzinfo=None)).cast("timestamp_ntz").alias("expires_at"))
    return fresh.select("origin", "text", "expires_at").unionByName(new)
