"""The pipeline as a whole against brute force, and odd rows through each of its stages."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from studyloom.llm import op2_simhash as S
from studyloom.llm import op5_repetition as Q
from studyloom.llm import op6_kdtree as K
from studyloom.llm import op8_latent as B

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key long, kept_key string, _mix_tokens long, _keep_id long, selected boolean, node int, h long"


def prose(rng, n):
    return [f"{''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    items = [" ".join(prose(rng, 24)) for _ in range(4)]
    texts = [" ".join(prose(rng, int(rng.integers(60, 300)))) for _ in range(40)]
    near = texts[3].split()
    near[20] = "changed"
    texts += [texts[3], " ".join(near), texts[5], "too short", "again and again " * 60]
    texts += [texts[7] + " " + items[1], items[2] + " " + " ".join(prose(rng, 70))]
    ids = rng.permutation(len(texts)).tolist()
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b"][i % 2]) for i, t in zip(ids, texts, strict=True)] + [(900, None, "en", "a"), (901, "", None, None)]
    path = tmp_path_factory.mktemp("stages")
    full = spark.createDataFrame([(*r, 1, 1, "x", 1, 1, True, 1, 1) for r in rows], COLUMNS)
    full.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {r[0]: r[1] or "" for r in rows}, items


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def least_of_groups(docs):
    """One id of each group of texts linked at a Jaccard similarity of 0.8, by all pairs."""
    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            for j in docs:
                close = sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
                if close and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {i for i in docs if root[i] == i}


def repetitive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    return len(words) < Q.LEAST_WORDS or 100 * len(hit) > Q.WINDOW_PERCENT * len(words)


def test_stages_against_brute_force(spark, folder):
    path, texts, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen, left = docs, dict(texts)
    for name, stage in P.STAGES[:3]:
        seen = P.written(stage(spark, seen, path), f"t-{name}")
        if name == "quality":
            left = {i: t for i, t in left.items() if not repetitive(t)}
        elif name == "near_dedup":
            left = {i: left[i] for i in least_of_groups(left)}
        else:
            left = {i: t for i, t in left.items() if not any(x in t for x in items)}
        assert seen.columns == docs.columns
        assert sorted(r["doc_id"] for r in seen.collect()) == sorted(left), name
    rows = P.run(spark, path).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(rows) and set(got) < set(left) and len(got) >= len(left) // 2
    assert all(r["size"] == len(left[i].encode()) + 1 for i, r in got.items())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))


def test_odd_rows_through_the_stages(spark, folder):
    path, _, _ = folder
    rng = np.random.default_rng(5)
    long = [" ".join(prose(rng, 80)) for _ in range(3)]
    rows = [(None, long[0], "en", "a"), (None, long[0], None, None), (None, long[1], "en", "a"), (None, None, "en", "a"), (1, "", "en", None), (2, long[2], "en", "a")] + [(2, long[2], "en", "a")] * 30
    odd = spark.createDataFrame([(*r, None, 1, None, None, 1, None, 1, None) for r in rows], COLUMNS).repartition(3)
    once = P.near_dedup(spark, odd, path)
    assert once.columns == odd.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in once.collect()) == sorted([(0, long[0]), (0, long[1]), (1, ""), (2, long[2])])
    assert P.decontaminate(spark, odd, path).count() == len(rows) and P.mix(spark, odd, path).columns == odd.columns
    assert P.quality(spark, odd, path).count() == 34 and P.shards(spark, odd, path).count() == len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, odd.limit(0), path).count() == 0


def test_repeated_rows_do_not_break_the_law_of_bytes(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("some text "), "id").alias("text")).unionByName(spark.range(500).select(F.lit(7).cast("long").alias("id"), F.lit("some text 7").alias("text")))
    docs = rows.select(F.col("id").alias("doc_id"), "text", F.lit("a").alias("lang"), F.lit("s").alias("source"))
    sizes = [r["b"] for r in K.shard(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8


def test_items_without_an_id_and_ids_of_text(spark, folder):
    _, _, items = folder
    docs = spark.createDataFrame([(1, items[0]), (2, items[1]), (None, items[0])], "doc_id long, text string")
    for kind, ids in (("long", [5, None]), ("string", ["x", None])):
        bench = spark.createDataFrame(list(zip(ids, items, strict=False)), f"item_id {kind}, text string")
        got = B.matches(docs, bench).collect()
        assert sorted((r["id"] or 0, str(r["item_id"])) for r in got) == [(0, str(ids[0])), (1, str(ids[0])), (2, "None")]


def test_near_dedup_drops_what_simhash_links(spark, folder):
    """Texts that say the same again and again between other words: SimHashes agree, 5-word shingle sets do not."""
    path, _, _ = folder
    rng = np.random.default_rng(9)
    said = " ".join(prose(rng, 11)) + " "
    texts = [said * 80 + " ".join(prose(rng, 50)) for _ in range(3)] + [" ".join(prose(rng, 120)) for _ in range(5)]
    docs = spark.createDataFrame([(10 + i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    groups = {r["id"]: r["component_id"] for r in S.near_duplicates(docs).collect()}
    assert len(set(groups.values())) == 6 and len(least_of_groups(dict(enumerate(texts)))) == 8
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, docs, path).collect()) == sorted(set(groups.values()))
