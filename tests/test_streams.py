"""The streaming forms give the rows of the batch forms."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import stateful
from pagewright.streaming import keyed

ROWS = [(f"k{i % 3}", i, i * 7 % 5 in (0, 1, 3)) for i in range(60)]


@pytest.fixture
def stream(spark, tmp_path):
    """Rows in three files, so that state lives over micro-batches."""
    schema = "k string, seq long, failed boolean"
    for part in range(3):
        spark.createDataFrame(ROWS[part * 20 : part * 20 + 20], schema).coalesce(1).write.json(str(tmp_path / f"in/{part}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))

    def run(query, mode="append"):
        q = query.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
        assert q.awaitTermination(240)
        return spark.table("out").collect()

    return source, run


def test_streaks(spark, stream):
    source, run = stream
    got = {(r.origin, r.seq): (r.streak, r.cooldown_ms) for r in run(keyed.streaks(source.withColumnRenamed("k", "origin")))}
    batch = stateful.failure_streaks(spark.createDataFrame(ROWS, "k string, seq long, failed boolean"), "k", "failed", ["seq"])
    order = {(r.k, r.seq): (r.streak, r.cooldown_ms) for r in batch.collect()}
    assert got.keys() == order.keys()
    assert got == order


def test_budget(spark, stream):
    source, run = stream
    got = {(r.run_id, r.seq): r.outcome for r in run(keyed.budget(source.withColumnRenamed("k", "run_id"), 5))}
    assert len(got) == 60 and sum(v == "attempt" for v in got.values()) == 15


def test_redesign_is_told_once(spark, stream):
    source, run = stream
    got = run(keyed.redesigns(source.select(F.col("k").alias("run_id"), "seq", F.col("failed").alias("failing"))))
    assert sorted(r.run_id for r in got) == ["k0", "k1", "k2"]


def test_first_seen(spark, stream):
    source, run = stream
    assert sorted(r.k for r in run(keyed.first_seen(source, "k"))) == ["k0", "k1", "k2"]


def test_seen_keys_are_let_go(spark, tmp_path):
    """With a time column a key counts anew once its entry is too old."""
    from datetime import datetime

    from pagewright.streaming.keyed import first_seen

    schema = "canonical_key string, at timestamp"
    source, out = str(tmp_path / "in"), []
    for day, keys in ((1, "aab"), (2, "a"), (9, "c"), (10, "ad")):
        spark.createDataFrame([(k, datetime(2025, 1, day)) for k in keys], schema).coalesce(1).write.mode("append").parquet(source)
        stream = first_seen(spark.readStream.schema(schema).parquet(source), time="at", late="2 days")
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
        query.awaitTermination(60)
        query.stop()
    got = sorted((r.canonical_key, r.at.day) for r in out)
    assert got == [("a", 1), ("a", 10), ("b", 1), ("c", 9), ("d", 10)]
