"""Running sums over ranges against a plain loop."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from studyloom.operators import analytics


def test_running_sums_equal_a_loop(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(60), rnd.choice([1, -1, 2])) for _ in range(500)]
    want, got = {}, {}
    for k in {r[0] for r in rows}:
        total = 0
        for t in sorted({r[1] for r in rows if r[0] == k}):
            total += sum(r[2] for r in rows if r[:2] == (k, t))
            want[k, t] = total
    df = spark.createDataFrame(rows, "k string, t long, d int").repartition(5)
    got = {(r["k"], r["t"]): r["total"] for r in analytics.prefix_sums(df, ["k"], "t", "d").collect()}
    assert got == want
    alone = analytics.prefix_sums(df.where("k = 'a'"), [], "t", "d").collect()
    assert {("a", r["t"]): r["total"] for r in alone} == {k: v for k, v in want.items() if k[0] == "a"}


def test_no_task_has_more_than_a_range(spark):
    n = 40000
    calls = spark.range(n).select((F.col("id") * 1.0).alias("started_seconds"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.0 + 2.5).alias("finished_seconds"))
    ends = sorted([(float(i), 1) for i in range(n)] + [(i + 2.5, -1) for i in range(n) if i % 5])
    assert analytics.concurrency(calls, []).first()[0] == max(accumulate(d for _, d in ends))
    plan = analytics.concurrency(calls, [])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and all("_range" in w for w in windows)


def test_odd_calls(spark):
    kind = "k string, started_seconds double, finished_seconds double"
    assert analytics.concurrency(spark.createDataFrame([], kind), ["k"]).count() == 0
    assert analytics.concurrency(spark.createDataFrame([], kind), []).first()[0] is None
    rows = [("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 2.0, None), ("a", None, 2.0), (None, 1.0, 1.0)]
    got = {r["k"]: r["max_concurrency"] for r in analytics.concurrency(spark.createDataFrame(rows, kind), ["k"]).collect()}
    assert got == {"a": 2, None: 0}
