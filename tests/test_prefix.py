"""Running sums over hot keys are those of a window."""

import random

from pyspark.sql import functions as F

from pagewright.operators.prefix import running


def test_running_is_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, 1, 2, 5])) for i in rng.sample(range(4000), 3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r.i: (r.total, r.n, r.was) for r in running(df, ["k"], ["i"], {"total": F.col("v").cast("long"), "n": F.lit(1).cast("long")}, {"was": "v"}).collect()}
    state: dict = {}
    want = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        total, n, was = state.get(k, (0, 0, None))
        want[i] = (total + (v or 0), n + 1, was)
        state[k] = (total + (v or 0), n + 1, v)
    assert got == want


def test_running_of_nothing(spark):
    df = spark.createDataFrame([], "k string, i int, v int")
    assert running(df, ["k"], ["i"], {"s": F.col("v").cast("long")}, {"was": "v"}).count() == 0
