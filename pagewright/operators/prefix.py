"""Running sums and previous values over keys of any size.

A window over a key puts all its rows into one task. Here the rows are cut by range into chunks, so that a hot key lies in
many; each chunk is summed up on its own, and what came before it in its key is added from the chunks' totals, of which a
key has as many as there are chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagewright.sources.tables import cut


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], previous: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a running sum (this row included) for each of ``sums``, and for each of ``previous`` the value that the
    named column had in the row before. ``order`` must tell the rows of a key apart; nulls in a summed column count nothing."""
    previous = previous or {}
    d = df.withColumns({f"_s_{n}": c for n, c in sums.items()})
    d = cut(d.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id()))
    here = W.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    totals = d.groupBy(*keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums], *[F.max_by(F.struct(c), F.struct(*order)).alias(f"_l_{n}") for n, c in previous.items()]
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.last(f"_l_{n}").over(before).alias(f"_p_{n}") for n in previous]
    )
    d = d.withColumns({n: F.sum(f"_s_{n}").over(upto) for n in sums} | {f"_q_{n}": F.lag(F.struct(c)).over(here) for n, c in previous.items()})
    # Null keys are keys too.
    on = [d[k].eqNullSafe(offsets[k]) for k in [*keys, "_chunk"]]
    joined = d.join(offsets, on, "left").drop(*[offsets[k] for k in [*keys, "_chunk"]])
    joined = joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"_o_{n}") for n in sums} | {n: F.coalesce(f"_q_{n}", f"_p_{n}")[c] for n, c in previous.items()})
    return joined.drop("_chunk", *[f"{p}{n}" for n in sums for p in ("_s_", "_o_")], *[f"{p}{n}" for n in previous for p in ("_q_", "_p_")])
