"""Schemas that drift between versions and runs: one consistent table, and a list of every change.

Two neighbouring versions of a schema are compared per template. Fields that are gone and fields that are new form the
two sides of a bipartite graph whose edges are scored by sketches, type and similarity of names; a minimum-cost matching
finds the renames. The sketch of a declared field is its list of locators, that of a delivered column its SKETCH smallest
value hashes. The matched names then become one column.

All comparisons are made per (job, version, template): a group holds the fields of two versions of one template, which is
bounded by the size of a program, whatever the number of rows. Only columns that are gone or new are sketched; a sketch is
made by partial aggregation (distinct hashes, then a top-k that every task cuts before the shuffle), so a column of any
number of rows sends each task's SKETCH hashes on and no more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pagewright.operators.snapshot_diff import ordered_runs
from pagewright.sources.tables import cut, table

FIELD = T.StructType(
    [T.StructField("template_id", T.StringType()), T.StructField("field_name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("locators", T.ArrayType(T.StringType()))]
)
CHANGE = T.ArrayType(T.StructType([T.StructField("field_name", T.StringType()), T.StructField("change_kind", T.StringType()), T.StructField("was", T.StringType())]))


def program_fields(text: str | None) -> list[tuple]:
    """(template, field, type, locators) of a program in any of its layouts; null or broken text has none."""
    try:
        program = json.loads(text or "")
        templates = program.get("pageTemplates", program.get("templates")) or []
        if isinstance(templates, dict):
            templates = [x | {"id": k} for k, x in templates.items()]
        out = []
        for t in templates:
            fields = t.get("fields") or {}
            for name, x in fields.items() if isinstance(fields, dict) else ((x.get("name"), x) for x in fields):
                locators = x.get("locators", x.get("selectors")) or []
                out.append((t.get("id"), name, x.get("type", x.get("dtype")), [str(y) for y in ([locators] if isinstance(locators, str) else locators)]))
        return out
    except (ValueError, AttributeError, TypeError, RecursionError):
        return []


_program_fields = F.udf(program_fields, T.ArrayType(FIELD), useArrow=True)


def assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to columns (rows <= columns) by shortest augmenting paths; O(n^2 m)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not row_of[j0]:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def name_likeness(a: str, b: str) -> float:
    """Share of common letter pairs, 0 to 1."""
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    x, y = pairs(a.lower()), pairs(b.lower())
    return len(x & y) / len(x | y)


#: Smallest value hashes of a column that are kept, and the least share of them that two columns of one meaning have in common.
SKETCH, LEAST = 64, 0.3
#: Least share of the locators that two fields of different names have in common to become one column.
LOCATORS = 0.5


def overlap(a, b) -> float:
    """Share of common values of two sketches (smallest hashes, ascending): of the hashes up to where the shorter view of a
    full sketch ends, those that both have. Exact for columns of fewer than SKETCH values."""
    a, b = list(a or ()), list(b or ())
    if not a or not b:
        return 0.0
    end = min(x[-1] for x in (a, b) if len(x) >= SKETCH) if max(len(a), len(b)) >= SKETCH else max(a[-1], b[-1])
    x, y = {h for h in a if h <= end}, {h for h in b if h <= end}
    return len(x & y) / len(x | y) if x | y else 0.0


def match_fields(gone: dict, new: dict, sketch_likeness, least: float) -> dict[str, str]:
    """New name -> gone name. Sides map a name to (type, sketch); the score is 4 x sketch + type + name, pairs whose sketch is under ``least`` never match."""
    if not gone or not new:
        return {}
    old, fresh = sorted(gone), sorted(new)
    score = [[(s * 4 + (gone[o][0] == new[f][0]) + name_likeness(o, f)) if (s := sketch_likeness(gone[o][1], new[f][1])) >= least else 0 for o in old] for f in fresh]
    cost = [[-x for x in row] + [0.0] * len(fresh) for row in score]
    return {fresh[i]: old[j] for i, j in enumerate(assign(cost)) if 0 <= j < len(old) and score[i][j] > 0}


def match_columns(sides: list) -> list[tuple[str, str, float]]:
    """(new name, gone name, share of common values) of the columns that are one. ``sides``: (now, name, types, sketch).

    Columns meet only where their sketches share a hash; what meets, directly or through others, is matched together."""
    gone = {x[1]: (tuple(x[2] or ()), tuple(x[3] or ())) for x in sides if not x[0]}
    new = {x[1]: (tuple(x[2] or ()), tuple(x[3] or ())) for x in sides if x[0]}
    holders: dict = {}
    for name in sorted(gone):
        for h in gone[name][1]:
            holders.setdefault(h, []).append((0, name))
    for name in sorted(new):
        for h in new[name][1]:
            if h in holders:
                holders[h].append((1, name))
    root: dict = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for nodes in holders.values():
        for x in nodes[1:]:
            root[top(x)] = top(nodes[0])
    groups: dict = {}
    for x in sorted(root):
        groups.setdefault(top(x), []).append(x)
    out = []
    for nodes in groups.values():
        g, n = {k: gone[k] for side, k in nodes if side == 0}, {k: new[k] for side, k in nodes if side == 1}
        for name, was in match_fields(g, n, overlap, LEAST).items():
            # One or two values in common say little; then the names must be alike.
            if min(len(g[was][1]), len(n[name][1])) > 2 or name_likeness(was, name) >= 0.5:
                out.append((name, was, overlap(g[was][1], n[name][1])))
    return out


def shared_locators(a: tuple, b: tuple) -> float:
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def compare_programs(fields: list) -> list[tuple]:
    """Changes of one template between two versions: (field_name, change_kind, was). ``fields``: (now, field_name, type, locators).

    A field whose locators are those of one that is gone is ``renamed``. Of the others, those that the matching pairs by a
    good share of their locators stay ``added`` and ``removed``, as their locators changed too, but ``was`` names the pair."""
    now = {f[1]: (f[2], tuple(f[3] or ())) for f in fields if f[0]}
    before = {f[1]: (f[2], tuple(f[3] or ())) for f in fields if not f[0]}
    gone, new = {k: x for k, x in before.items() if k not in now}, {k: x for k, x in now.items() if k not in before}
    matched = match_fields(gone, new, lambda a, b: float(a == b and bool(a)), 1.0)
    for k in new.keys() - matched.keys():  # several new names with the locators of one that is gone
        if same := [g for g in sorted(gone) if gone[g][1] == new[k][1] and new[k][1]]:
            matched[k] = same[0]
    taken = set(matched.values()) | {g for g in gone if any(gone[g][1] == new[k][1] for k in matched)}
    near = match_fields({k: x for k, x in gone.items() if k not in taken}, {k: x for k, x in new.items() if k not in matched}, shared_locators, LOCATORS)
    out = [(k, "renamed", matched[k]) if k in matched else (k, "added", near.get(k)) for k in new]
    out += [(k, "removed", None) for k in gone if k not in taken]
    return out + [(k, "retyped", None) for k in now.keys() & before.keys() if now[k][0] != before[k][0]]


_compare_programs = F.udf(lambda fields: compare_programs([tuple(f) for f in fields]), CHANGE, useArrow=True)


def config_changes(configs: DataFrame) -> DataFrame:
    """job_id, version, template_id, field_name, change_kind, was (the name that a renamed or near field had). Of repeated (job, version) rows one counts."""
    programs = configs.groupBy("job_id", "version").agg(F.max("payload").alias("payload"))
    job = W.partitionBy("job_id").orderBy("version")
    programs = programs.withColumn("next", F.lead("version").over(job)).withColumn("first", F.lag("version").over(job).isNull())
    fields = programs.select("job_id", "version", "next", "first", F.explode(_program_fields("payload")).alias("f"))
    sides = F.array(F.struct(F.when(~F.col("first"), F.col("version")).alias("at"), F.lit(True).alias("now")), F.struct(F.col("next").alias("at"), F.lit(False).alias("now")))
    fields = fields.select("job_id", "f", F.explode(F.filter(sides, lambda s: s["at"].isNotNull())).alias("s"))
    field = F.struct(F.col("s.now").alias("now"), "f.field_name", "f.type", "f.locators")
    groups = fields.groupBy("job_id", F.col("s.at").alias("version"), F.col("f.template_id").alias("template_id")).agg(F.collect_list(field).alias("fields"))
    changes = groups.select("job_id", "version", "template_id", F.explode(_compare_programs("fields")).alias("c"))
    return changes.select("job_id", "version", "template_id", "c.field_name", "c.change_kind", "c.was")


def payload_signature(text: str | None, loads=json.loads) -> str:
    """Sorted ``key<tab>type`` lines of a payload; type is s, n, b, - (null) or o (object or list). Null or broken text has none."""
    if text is None:
        return ""
    try:
        record = loads(text)
    except (ValueError, RecursionError):
        return ""
    if not isinstance(record, dict):
        return ""
    kinds = {str: "s", bool: "b", int: "n", float: "n", type(None): "-"}
    return "\n".join(sorted([k.replace("\\", "\\\\").replace("\n", "\\n").replace("\t", "\\t") + "\t" + kinds.get(type(v), "o") for k, v in record.items()]))


@F.pandas_udf(T.StringType())
def _signatures(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in payloads:
        yield pd.Series([payload_signature(x) for x in batch], dtype=object)


def run_profiles(records: DataFrame, runs: DataFrame) -> DataFrame:
    """series, seq, last_seq, run_id, template_id, keys: map of each payload key to the set of its value types.

    Rows are reduced to distinct signatures before anything is shuffled by run: many rows of a run share one.
    """
    signed = records.select("run_id", "template_id", _signatures("payload").alias("signature")).groupBy("run_id", "template_id", "signature").agg(F.lit(1).alias("one"))
    split = F.split("signature", "\n")
    cells = signed.select("run_id", "template_id", F.explode(F.when(F.col("signature") == "", F.array(F.lit(None).cast("string"))).otherwise(split)).alias("cell"))
    name = F.substring_index("cell", "\t", 1)
    name = F.replace(F.replace(F.replace(name, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    keys = cells.groupBy("run_id", "template_id", name.alias("key")).agg(F.array_sort(F.collect_set(F.substring_index("cell", "\t", -1))).alias("types"))
    keys = keys.withColumn("types", F.filter("types", lambda t: t.isin("s", "n", "b")))
    return keys.join(runs.select("run_id", "series", "seq", "last_seq"), "run_id")


def _record_changes(records: DataFrame, runs: DataFrame) -> DataFrame:
    """series, seq, template_id, key, change_kind, now, before (sets of types) of the columns that changed."""
    keys = run_profiles(records, runs)
    sides = F.array(F.struct(F.col("seq").alias("at"), F.lit(True).alias("now")), F.struct((F.col("seq") + 1).alias("at"), F.lit(False).alias("now")))
    sides = F.filter(sides, lambda s: (s["at"] > 1) & (s["at"] <= F.col("last_seq")))
    keys = keys.select("series", "template_id", "key", "types", F.explode(sides).alias("s"))
    types = lambda now: F.max(F.when(F.col("s.now") == F.lit(now), F.col("types")))
    both = keys.groupBy("series", F.col("s.at").alias("seq"), "template_id", "key").agg(types(True).alias("now"), types(False).alias("before"))
    # The marker row of a template without any key (null key) also tells that it has rows in a run.
    template = W.partitionBy("series", "seq", "template_id")
    both = both.withColumn("in_both", F.max(F.col("now").isNotNull()).over(template) & F.max(F.col("before").isNotNull()).over(template))
    kind = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when((F.col("now") != F.col("before")) & (F.size("now") > 0) & (F.size("before") > 0), "retyped")
    )
    return both.filter("in_both AND key IS NOT NULL").withColumn("change_kind", kind).filter("change_kind IS NOT NULL").drop("in_both")


def record_changes(records: DataFrame, runs: DataFrame) -> DataFrame:
    """job_id, run_id, template_id, field_name, change_kind between neighbouring done runs, for templates with rows in both."""
    both = _record_changes(records, runs).join(runs.select("series", "seq", "run_id"), ["series", "seq"])
    return both.select(F.col("series").alias("job_id"), "run_id", "template_id", F.col("key").alias("field_name"), "change_kind")


_match_columns = F.udf(lambda sides: match_columns([tuple(x) for x in sides]), T.ArrayType(T.StructType([T.StructField("field_name", T.StringType()), T.StructField("was", T.StringType()), T.StructField("share", T.DoubleType())])), useArrow=True)


def record_renames(records: DataFrame, runs: DataFrame) -> DataFrame:
    """job_id, run_id, seq, template_id, field_name, was, share: columns of a run that hold what another one, gone since the run
    before, held. Null values say nothing; nested values count by their JSON text."""
    changed = cut(_record_changes(records, runs).filter("change_kind IN ('added', 'removed')"))
    template = W.partitionBy("series", "seq", "template_id")
    has = lambda kind: F.max(F.col("change_kind") == kind).over(template)
    changed = changed.withColumn("both", has("added") & has("removed")).filter("both")
    sides = changed.select("series", "seq", "template_id", "key", (F.col("change_kind") == "added").alias("now"), F.coalesce("now", "before").alias("types"))
    at = sides.select("*", F.when(F.col("now"), F.col("seq")).otherwise(F.col("seq") - 1).alias("at")).join(runs.select("series", F.col("seq").alias("at"), "run_id"), ["series", "at"])
    # Only the columns asked for are read out of the payloads; a null template is one of its own.
    marked = F.coalesce(F.concat(F.lit("t"), F.col("template_id")), F.lit("n"))
    asked = at.select("run_id", marked.alias("template"), "key", "series", "seq", "now")
    payloads = records.join(asked.select("run_id").distinct(), "run_id", "left_semi").select("run_id", marked.alias("template"), F.explode(F.from_json("payload", "map<string,string>")).alias("key", "value"))
    hashes = payloads.filter("value IS NOT NULL").join(asked, ["run_id", "template", "key"]).groupBy("series", "seq", "template", "key", "now", F.xxhash64("value").alias("h")).agg(F.count(F.lit(1)).alias("rows"))
    column = ["series", "seq", "template", "key", "now"]
    least = hashes.withColumn("place", F.row_number().over(W.partitionBy(*column).orderBy("h"))).filter(F.col("place") <= SKETCH)
    sketches = least.groupBy(*column).agg(F.array_sort(F.collect_list("h")).alias("sketch"))
    sides = sides.withColumn("template", marked).join(sketches, column)
    groups = sides.groupBy("series", "seq", "template").agg(F.first("template_id").alias("template_id"), F.collect_list(F.struct("now", "key", "types", "sketch")).alias("sides"))
    found = groups.select("series", "seq", "template_id", F.inline(_match_columns("sides"))).join(runs.select("series", "seq", "run_id"), ["series", "seq"])
    return found.select(F.col("series").alias("job_id"), "run_id", "seq", "template_id", "field_name", "was", "share")


def p7_found(spark, sf_dir: str) -> DataFrame:
    """Every change of a declared or delivered field. Null or broken programs and payloads have no fields; repeated
    deliveries of a version count once; empty tables give no rows."""
    config = config_changes(table(spark, sf_dir, "strategy_config"))
    config = config.select(F.lit("config").alias("layer"), "job_id", F.col("version").cast("string").alias("file_id"), "template_id", "field_name", "change_kind")
    record = record_changes(table(spark, sf_dir, "extracted_record"), ordered_runs(table(spark, sf_dir, "crawl_run")))
    record = record.select(F.lit("record").alias("layer"), "job_id", F.col("run_id").alias("file_id"), "template_id", "field_name", "change_kind")
    return config.unionByName(record)


def p7_renames(spark, sf_dir: str) -> DataFrame:
    """layer, job_id, file_id, template_id, field_name, was: every name that the matching takes for another one, in programs (by
    locators) and in records (by values). p7_found shows record renames as removed and added, as its definition asks."""
    config = config_changes(table(spark, sf_dir, "strategy_config")).filter("was IS NOT NULL")
    config = config.select(F.lit("config").alias("layer"), "job_id", F.col("version").cast("string").alias("file_id"), "template_id", "field_name", "was")
    record = record_renames(table(spark, sf_dir, "extracted_record"), ordered_runs(table(spark, sf_dir, "crawl_run")))
    return config.unionByName(record.select(F.lit("record").alias("layer"), "job_id", F.col("run_id").alias("file_id"), "template_id", "field_name", "was"))


def p7_configs(spark, sf_dir: str) -> DataFrame:
    """All programs in one layout: a row per (job, version, template, field) with the field's latest name as column_name."""
    configs = table(spark, sf_dir, "strategy_config")
    programs = configs.groupBy("job_id", "version").agg(F.max("payload").alias("payload"))
    fields = programs.select("job_id", "version", F.explode(_program_fields("payload")).alias("f")).select("job_id", "version", "f.*")
    names = latest_names(config_changes(configs).filter("was IS NOT NULL"))
    return fields.join(names, ["job_id", "template_id", "field_name"], "left").withColumn("column_name", F.coalesce("column_name", "field_name"))


def latest_names(edges: DataFrame) -> DataFrame:
    """job_id, template_id, field_name, column_name: the name that a field came to have through its renames (``version``, was,
    field_name). Renames of a template are as many as its versions' fields."""

    def resolve(edges):
        latest: dict = {}
        for _, was, name in sorted(tuple(e) for e in edges):
            for k in [k for k, x in latest.items() if x == was]:
                latest[k] = name
            latest[was] = name
            latest.pop(name, None)
        return list(latest.items())

    pairs = F.udf(resolve, T.ArrayType(T.StructType([T.StructField("field_name", T.StringType()), T.StructField("column_name", T.StringType())])), useArrow=True)
    edges = edges.groupBy("job_id", "template_id").agg(F.collect_set(F.struct("version", "was", "field_name")).alias("edges"))
    return edges.select("job_id", "template_id", F.inline(pairs("edges")))


def p7_records(spark, sf_dir: str) -> DataFrame:
    """All records in one table: payload as a map from each field's latest name to its JSON text; nulls are left out. Names are
    those of the program where it renamed a field, else those that the values' sketches matched between runs. A null template
    has no renames."""
    configs = config_changes(table(spark, sf_dir, "strategy_config")).filter("was IS NOT NULL").select("job_id", "template_id", "version", "was", "field_name")
    crawl_runs = table(spark, sf_dir, "crawl_run")
    record = record_renames(table(spark, sf_dir, "extracted_record"), ordered_runs(crawl_runs))
    known = configs.select("job_id", "template_id", "was").distinct()
    # Ordered after all versions: the program's own word comes first.
    record = record.join(known, ["job_id", "template_id", "was"], "left_anti").select("job_id", "template_id", (F.lit(1_000_000_000) + F.col("seq")).alias("version"), "was", "field_name")
    names = latest_names(configs.unionByName(record))
    names = names.groupBy("job_id", "template_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "column_name"))).alias("names"))
    runs = table(spark, sf_dir, "crawl_run").select("run_id", "job_id").dropDuplicates(["run_id"])
    records = table(spark, sf_dir, "extracted_record").join(runs, "run_id", "left").join(names, ["job_id", "template_id"], "left")
    fields = F.map_filter(F.from_json("payload", "map<string,string>"), lambda _, v: v.isNotNull())
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(F.coalesce(F.try_element_at("names", e["key"]), e["key"]).alias("key"), e["value"].alias("value"), e["key"].alias("old")))
    # Where an old and a new name stand side by side, the new one counts.
    entries = F.filter(entries, lambda e: (e["key"] == e["old"]) | ~F.map_contains_key(fields, e["key"]))
    entries = F.array_distinct(F.transform(entries, lambda e: F.struct(e["key"], e["value"])))
    unique = F.aggregate(entries, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, e: F.when(F.exists(acc, lambda a: a["key"] == e["key"]), acc).otherwise(F.concat(acc, F.array(e))))
    return records.select("record_id", "run_id", "job_id", "template_id", "record_index", F.map_from_entries(unique).alias("fields"))
