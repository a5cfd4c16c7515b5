"""What changed between consecutive full snapshots of a keyed table.

Every snapshot is summed up, per hash bucket of its keys, as an invertible Bloom lookup table (IBLT). The tables of two
neighbouring snapshots are subtracted cell by cell, which cancels all that stayed; what is left is peeled into the
(key hash, value hash) pairs that differ. A bucket that does not peel to nothing, or whose digest disagrees, is built
again with more cells; one that fails three times is compared row by row. Spark's own partial aggregation (``sum`` and
``bit_xor`` per cell) builds and subtracts the tables; only cells that did not cancel reach Python.

Rows are shuffled once, as seven numbers each, by (series, bucket): a hot series is spread over its buckets. A key is known by
two hashes, 128 bits; equal ones of two keys of one series are not to be expected below 10**15 keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pagewright.functions.jsontext import canonical, parser
from pagewright.functions.urls import record_url
from pagewright.sources.tables import cut, table

MASK = (1 << 64) - 1
P1, P2, P3, P4, P5 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def _xx_long(x: int, seed: int) -> int:
    """XXH64 of one 8-byte integer, as Spark's ``xxhash64`` does it."""
    h = (seed + P5 + 8) & MASK
    k = (x * P2) & MASK
    h ^= (((k << 31) | (k >> 33)) * P1) & MASK
    h = ((((h << 27) | (h >> 37)) & MASK) * P1 + P4) & MASK
    h = ((h ^ (h >> 33)) * P2) & MASK
    h = ((h ^ (h >> 29)) * P3) & MASK
    return h ^ (h >> 32)


def chain_hash(*numbers: int) -> int:
    """``xxhash64`` of bigint columns, unsigned."""
    h = 42
    for x in numbers:
        h = _xx_long(x & MASK, h)
    return h


def positions(c: int, width: int) -> tuple[int, int, int]:
    """The three cells, one per subtable of ``width`` cells (at most 2**20), of a pair with hash ``c``."""
    return (c & 0xFFFFF) % width, width + ((c >> 20) & 0xFFFFF) % width, 2 * width + ((c >> 40) & 0xFFFFF) % width


def peel(cells: list, width: int) -> tuple[bool, list[tuple[int, int, int, int]]]:
    """Peel a subtracted table given as (cell, n, keys, second keys, values, checks); cell -1 is the digest.

    Returns whether it peeled to nothing and the digest agrees, and the pairs as (sign, key hash, second key hash, value hash).
    """
    table_, digest, net = {}, 0, 0
    for cell, n, k, k2, v, c in cells:
        if cell < 0:
            digest, net = c & MASK, n
        else:
            table_[cell] = [n, k & MASK, k2 & MASK, v & MASK, c & MASK]
    out, todo = [], [i for i, x in table_.items() if x[0] in (1, -1)]
    while todo:
        x = table_[todo.pop()]
        n, k, k2, v, c = x
        if n not in (1, -1) or chain_hash(k, k2, v) != c:
            continue
        out.append((n, k, k2, v))
        digest ^= chain_hash(v, k2, k)
        net -= n
        for i in positions(c, width):
            y = table_.setdefault(i, [0, 0, 0, 0, 0])
            y[0] -= n
            y[1] ^= k
            y[2] ^= k2
            y[3] ^= v
            y[4] ^= c
            if y[0] in (1, -1):
                todo.append(i)
    return digest == 0 and net == 0 and not any(any(x) for x in table_.values()), out


_signed = lambda x: x - (1 << 64) if x >> 63 else x
PEELED = "series {kind}, bucket int, seq int, whole boolean, pairs array<struct<sign:int,kh:long,kh2:long,vh:long>>"


def _peel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peels the tables of a batch; cells come as flat columns, so no object is made for a cell but its numbers."""
    pair = pa.struct([("sign", pa.int32()), ("kh", pa.int64()), ("kh2", pa.int64()), ("vh", pa.int64())])
    for batch in batches:
        tables, widths = batch.column("cells"), batch.column("width").to_pylist()
        ends = tables.offsets.to_pylist()
        flat = [x.to_pylist() for x in tables.values.flatten()]
        whole, offsets, sign, hashes = [], [0], [], ([], [], [])
        for i, width in enumerate(widths):
            a, b = ends[i], ends[i + 1]
            good, pairs = peel(list(zip(*(x[a:b] for x in flat))), width)
            whole.append(good)
            for n, *three in pairs if good else ():
                sign.append(n)
                for column, x in zip(hashes, three, strict=True):
                    column.append(_signed(x))
            offsets.append(len(sign))
        values = pa.StructArray.from_arrays([pa.array(sign, pa.int32()), *(pa.array(x, pa.int64()) for x in hashes)], fields=list(pair))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("bucket"), batch.column("seq"), pa.array(whole, pa.bool_()), lists], names=["series", "bucket", "seq", "whole", "pairs"])


def _recover(items: DataFrame, width: Column) -> DataFrame:
    """(series, seq, bucket, whole, pairs) of every bucket that differs. ``items``: series, seq, last_seq, bucket, kh, kh2, vh."""
    check = F.xxhash64("kh", "kh2", "vh")
    low = lambda shift: F.shiftrightunsigned(F.col("c"), shift).bitwiseAND(F.lit(0xFFFFF).cast("long"))
    d = items.withColumn("width", width).withColumn("c", check)
    cells = [F.struct(F.lit(-1).alias("cell"), F.xxhash64("vh", "kh2", "kh").alias("c"))]
    for i in range(3):
        cells.append(F.struct((F.lit(i) * F.col("width") + (low(20 * i) % F.col("width")).cast("int")).cast("int").alias("cell"), F.col("c")))
    sides = F.array(F.struct(F.col("seq").alias("at"), F.lit(1).alias("n")), F.struct((F.col("seq") + 1).alias("at"), F.lit(-1).alias("n")))
    sides = F.filter(sides, lambda s: (s["at"] > 1) & (s["at"] <= F.col("last_seq")))
    d = d.select("series", "bucket", "width", "kh", "kh2", "vh", F.explode(sides).alias("s"), F.array(*cells).alias("cells"))
    d = d.select("series", "bucket", "width", "kh", "kh2", "vh", F.col("s.at").alias("seq"), F.col("s.n").alias("n"), F.explode("cells").alias("x"))
    d = d.groupBy("series", "bucket", "seq", "width", F.col("x.cell").alias("cell")).agg(
        F.sum("n").cast("int").alias("n"), F.bit_xor("kh").alias("k"), F.bit_xor("kh2").alias("k2"), F.bit_xor("vh").alias("v"), F.bit_xor("x.c").alias("c")
    )
    d = d.filter((F.col("n") != 0) | (F.col("k") != 0) | (F.col("k2") != 0) | (F.col("v") != 0) | (F.col("c") != 0))
    d = d.groupBy("series", "bucket", "seq", "width").agg(F.collect_list(F.struct("cell", "n", "k", "k2", "v", "c")).alias("cells"))
    return d.mapInArrow(_peel_batches, PEELED.format(kind=items.schema["series"].dataType.simpleString()))


def diff_snapshots(items: DataFrame, width: int = 40, rounds: int = 3) -> DataFrame:
    """Differences of consecutive snapshots.

    ``items``: series, seq (1, 2, ... per series, without gaps), last_seq, bucket, kh and kh2 (two hashes of the key), vh (value hash); one
    row per key and snapshot. A snapshot without rows counts as empty; the first has no cases. Returns series, seq (the
    later one), kh, kh2, kind (added, removed or changed). An empty input gives an empty result. Cells are kept sparse, so a
    wide table costs no more than the pairs in it; only buckets with far more differences than planned are built again.
    """
    items = cut(items)
    found = cut(_recover(items, F.lit(width)))
    done, left = [found.filter("whole")], found.filter(~F.col("whole"))
    for r in range(1, rounds):
        failed = left.select("series", "bucket", "seq").withColumn("at", F.explode(F.array("seq", F.col("seq") - 1)))
        if failed.isEmpty():
            left = None
            break
        # As many cells as a bucket of this snapshot and the one before has rows, and more from round to round.
        again = items.join(failed.select("series", "bucket", F.col("at").alias("seq")).distinct(), ["series", "bucket", "seq"], "left_semi")
        rows = F.count(F.lit(1)).over(W.partitionBy("series", "bucket"))
        wide = F.least(F.lit(1 << 20), F.greatest(F.lit(4 * width), rows * r).cast("int")).cast("int")
        found = cut(_recover(again, wide).join(failed.select("series", "bucket", "seq").distinct(), ["series", "bucket", "seq"], "left_semi"))
        done.append(found.filter("whole"))
        left = found.filter(~F.col("whole"))
    pairs = done[0]
    for d in done[1:]:
        pairs = pairs.unionByName(d)
    pairs = pairs.select("series", "seq", F.explode("pairs").alias("p")).select("series", "seq", "p.kh", "p.kh2", "p.sign")
    if left is not None and not left.isEmpty():
        where = left.select("series", "bucket", "seq")
        now = items.join(where, ["series", "bucket", "seq"]).select("series", "seq", "kh", "kh2", "vh", F.lit(1).alias("sign"))
        before = items.withColumn("seq", F.col("seq") + 1).join(where, ["series", "bucket", "seq"]).select("series", "seq", "kh", "kh2", "vh", F.lit(-1).alias("sign"))
        exact = now.unionByName(before).groupBy("series", "seq", "kh", "kh2", "vh").agg(F.sum("sign").cast("int").alias("sign")).filter("sign != 0")
        pairs = pairs.unionByName(exact.select("series", "seq", "kh", "kh2", "sign"))
    kinds = pairs.groupBy("series", "seq", "kh", "kh2").agg(F.max("sign").alias("hi"), F.min("sign").alias("lo"))
    return kinds.select("series", "seq", "kh", "kh2", F.when(F.col("hi") != F.col("lo"), "changed").when(F.col("hi") > 0, "added").otherwise("removed").alias("kind"))


@F.pandas_udf(T.LongType())
def payload_hash(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit hash of a payload's fields by name and JSON value; null, absent and an empty object are the same."""
    import xxhash

    parse = parser()
    for batch in payloads:
        yield pd.Series([_signed(xxhash.xxh64_intdigest(canonical(parse(x) or {}))) for x in batch], dtype="int64")


#: Runs up to this number are broadcast to the records (about 100 bytes each); more are joined by a shuffle.
FEW_RUNS = 200_000


def with_runs(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Records with their run's columns; the runs are broadcast only after they were counted."""
    return records.join(F.broadcast(runs) if runs.count() <= FEW_RUNS else runs, "run_id")


def numbered(runs: DataFrame) -> DataFrame:
    """Runs with ``series`` as a number instead of a text: a hash of the job, salted anew until no two jobs share one."""
    for salt in range(8):
        out = runs.withColumn("job_id", F.col("series")).withColumn("series", F.xxhash64("series", F.lit(salt)))
        if out.groupBy("series").agg(F.min("job_id").alias("a"), F.max("job_id").alias("b")).filter("a <> b").isEmpty():
            return out
    raise RuntimeError("jobs cannot be told apart by hash")


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Done runs with their place in the job: run_id, series (job), seq, last_seq. Ordered by started_at, ties by run_id,
    null first; of runs with one id one counts."""
    runs = runs.filter("status = 'done'").select("run_id", F.col("job_id").alias("series"), "started_at").dropDuplicates(["run_id"])
    job = W.partitionBy("series")
    return runs.select(
        "run_id", "series", F.row_number().over(job.orderBy(F.col("started_at").asc_nulls_first(), "run_id")).alias("seq"), F.count(F.lit(1)).over(job).cast("int").alias("last_seq")
    )


def with_buckets(runs: DataFrame, records: DataFrame, rows_per_bucket: int = 24) -> DataFrame:
    """``runs`` with buckets: parts of a job's keys, by the rows of its largest run. They are counted in a scan of run_id
    alone, so no bucket of any job holds more than a few times ``rows_per_bucket`` rows a run, whatever the table says of it."""
    rows = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    largest = F.max(F.coalesce("rows", F.lit(0))).over(W.partitionBy("series"))
    return runs.join(rows, "run_id", "left").withColumn("buckets", F.greatest(F.lit(1), F.ceil(largest / rows_per_bucket).cast("int"))).drop("rows")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Records added, removed or changed between consecutive done runs of a job.

    Of repeated rows of a record in a run the latest extracted_at counts (null first; ties by
    value hash). Null key parts
    are values of their own. Runs that are not done, and records of unknown runs, play no part.
    """
    all_records = table(spark, sf_dir, "extracted_record")
    runs = cut(with_buckets(numbered(ordered_runs(table(spark, sf_dir, "crawl_run"))), all_records))
    records = all_records.select("run_id", record_url(F.col("page_url")).alias("page_url"), "template_id", "record_index", "payload", "extracted_at")
    parts = [x for c in ("page_url", "template_id", "record_index") for x in (F.col(c), F.col(c).isNull())]
    keys = [F.xxhash64(*parts).alias("kh"), F.xxhash64(F.lit(1), *parts).alias("kh2")]
    slim = with_runs(records.select("run_id", *keys, payload_hash("payload").alias("vh"), "extracted_at"), runs.drop("job_id"))
    slim = slim.withColumn("bucket", F.pmod("kh", "buckets").cast("int")).drop("run_id", "buckets").repartition("series", "bucket")
    items = slim.groupBy("series", "bucket", "seq", "last_seq", "kh", "kh2").agg(F.max_by("vh", F.struct("extracted_at", "vh")).alias("vh"))
    found = cut(diff_snapshots(items))
    # Names of the keys that differ, from a scan without payloads; the other keys go before anything is aggregated.
    names = with_runs(records.select("run_id", "page_url", "template_id", "record_index", *keys), runs.select("run_id", "series"))
    names = names.drop("run_id").join(found.select("series", "kh", "kh2").distinct(), ["series", "kh", "kh2"], "left_semi")
    names = names.groupBy("series", "kh", "kh2").agg(*[F.max(c).alias(c) for c in ("page_url", "template_id", "record_index")])
    found = found.join(names, ["series", "kh", "kh2"]).join(runs.select("run_id", "job_id", "series", "seq"), ["series", "seq"])
    return found.select("job_id", "run_id", "page_url", "template_id", "record_index", F.col("kind").alias("change_kind"))
