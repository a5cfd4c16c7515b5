"""Two runs' records side by side: keyed by page, template and place, compared field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.prefix import running


def with_place(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``place``: running number of a record within its keys, from 0; a key may hold any share of the rows."""
    return running(records, keys, order, {"place": F.lit(1).cast("long")}).withColumn("place", F.col("place") - 1)


def diff_records(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, kind (added, removed, changed, unchanged), changed_fields. A null and a value differ, two nulls do not."""
    a = before.select(*keys, F.struct(*fields).alias("before"), F.lit(True).alias("was"))
    b = after.select(*keys, F.struct(*fields).alias("after"), F.lit(True).alias("is"))
    d = a.join(b, keys, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return d.select(*keys, kind.alias("kind"), F.when(kind == "changed", F.concat_ws(",", changed)).otherwise(F.lit("")).alias("changed_fields"), "before", "after")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed", "unchanged")])


def leaf_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Path-wise difference of flattened trees (keys, path, value): op add, remove or change."""
    d = before.withColumnRenamed("value", "old").join(after.withColumnRenamed("value", "new"), [*keys, "path"], "full_outer")
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").otherwise("change")
    return d.filter(~F.col("old").eqNullSafe(F.col("new"))).select(*keys, "path", op.alias("op"), "old", "new")


def content_key(text: Column) -> Column:
    """Hash of a text without regard to white space; texts with the same words in the same order share it."""
    return F.sha2(F.regexp_replace(F.regexp_replace(text, "[ \\t\\n\\r]+", " "), "^ | $", ""), 256)
