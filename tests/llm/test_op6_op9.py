from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from studyloom.llm import op6_kdtree as K
from studyloom.llm import op9_raking as M


@pytest.fixture(scope="module")
def hot_docs(spark):
    """A third of the rows are copies of one text from one source."""
    n = spark.range(6000).withColumnRenamed("id", "doc_id")
    text = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("copy "), F.lit(30))).otherwise(F.repeat(F.concat(F.lit("w"), F.col("doc_id")), (F.col("doc_id") % 50 + 1).cast("int")))
    return n.select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 7)).alias("source"), F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit(None)), (F.col("doc_id") % 3 + 1).cast("int")).alias("lang"))


@pytest.mark.parametrize("n", [1, 5, 16])
def test_shards_have_equal_bytes_and_gapless_slots(hot_docs, n):
    rows = K.shard(hot_docs, n).collect()
    assert len(rows) == 6000 and len({r["id"] for r in rows}) == 6000
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(size) == list(range(n))
    assert max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_tree(points, n, first=0):
    """The same tree on one machine: exact weighted medians in key order."""
    if n == 1 or len(points) < 2:
        return dict.fromkeys((p["id"] for p in points), first)
    dims = brute_tree.dims
    width = [(max(p[d] for p in points) - min(p[d] for p in points)) / max(1, brute_tree.spread[d]) for d in dims]
    d = dims[max(range(len(dims)), key=lambda j: (width[j], -j))]
    points = sorted(points, key=lambda p: (p[d], p["h"]))
    total = sum(p["size"] for p in points)
    goal, done, cut = max(1, total * (n // 2) // n), 0, 0
    while done + points[cut]["size"] < goal:
        done += points[cut]["size"]
        cut += 1
    if done + points[cut]["size"] - goal <= goal - done:
        cut += 1
    return brute_tree(points[:cut], n // 2, first) | brute_tree(points[cut:], n - n // 2, first + n // 2)


def test_tree_against_brute_force(hot_docs):
    docs = hot_docs.where("doc_id < 400")
    pts = K.points(docs)
    rows = [r.asDict() for r in pts.collect()]
    brute_tree.dims = ["k0", "k1", "k2"]
    brute_tree.spread = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in brute_tree.dims}
    got = {r["id"]: r["shard"] for r in K.tree(pts, 8, tolerance=0.0).collect()}
    assert got == brute_tree(rows, 8)


def test_odd_rows(odd_docs, no_docs):
    rows = K.shard(odd_docs, 16).collect()
    assert len(rows) == odd_docs.count() and next(r for r in rows if r["id"] == 4)["size"] == 1
    assert K.shard(no_docs, 16).count() == 0
    assert K.shard(odd_docs, target_bytes=1 << 30).select("shard").distinct().count() == 1


def test_raked_marginals_meet_their_targets(hot_docs):
    mixed = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit(None)), (F.xxhash64("doc_id") % 3 + 3).cast("int") % 3 + 1)
    docs = hot_docs.withColumn("text", F.repeat(F.lit("a b "), (F.abs(F.xxhash64("doc_id", F.lit(1))) % 300).cast("int"))).withColumn("lang", mixed)
    cells = M.mixing(docs, share=0.5, power=0.5)
    rows = cells.collect()
    for d in M.DIMS:
        tokens, w = Counter(), Counter()
        for r in rows:
            tokens[r[d]] += r["tokens"]
            w[r[d]] += r["w"]
        whole = sum(t**0.5 for t in tokens.values())
        for k, t in tokens.items():
            assert abs(w[k] - t**0.5 / whole) <= 2e-3 * t**0.5 / whole
    expected = sum(r["p"] * r["tokens"] for r in rows)
    assert abs(expected / sum(r["tokens"] for r in rows) - 0.5) < 1e-3 and all(0 < r["p"] <= 1 for r in rows)


def test_raking_against_brute_force(spark):
    cells = [("a", "x", "t", 10), ("a", "y", "t", 30), ("b", "x", "u", 20), ("b", "y", "t", 5), ("c", "y", "u", 50)]
    target = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 0.6, "u": 0.4}}
    w = {c[:3]: float(c[3]) for c in cells}
    for _ in range(400):
        for i, d in enumerate(M.DIMS):
            sums = Counter()
            for k, v in w.items():
                sums[k[i]] += v
            w = {k: v * target[d][k[i]] / sums[k[i]] for k, v in w.items()}
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    goals = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in target.items()}
    got = {(r["source"], r["lang"], r["topic"]): r["w"] for r in M.rake(df, goals, tolerance=1e-9, stalled=0.9999).collect()}
    assert all(abs(got[k] - w[k]) < 1e-6 for k in w)


def test_cells_without_tokens(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, "one two", "b", "y"), (4, "three", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["row"]["doc_id"]: r for r in M.chosen(docs, M.mixing(docs)).collect()}
    assert len(got) == 4 and got[1]["p"] == 1.0 and got[1]["tokens"] == 0


def test_sample_is_calibrated_and_repeatable(hot_docs, odd_docs, no_docs):
    docs = hot_docs.withColumn("text", F.concat_ws(" ", "text", F.lit("one two three")))
    cells = M.mixing(docs, share=0.6)
    rows = M.chosen(docs, cells).collect()
    kept = sum(r["tokens"] for r in rows if r["selected"]) / sum(r["tokens"] for r in rows)
    assert abs(kept - 0.6) < 0.04
    assert {r["doc_id"] for r in M.sampled(docs, 0.6).collect()} == {r["row"]["doc_id"] for r in rows if r["selected"]}
    assert M.sampled(odd_docs).columns == odd_docs.columns and M.sampled(no_docs).count() == 0
    assert M.chosen(odd_docs, M.mixing(odd_docs)).count() == odd_docs.count()


def test_native_plans_have_no_python(hot_docs):
    for df in (K.shard(hot_docs, 4), M.sampled(hot_docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
