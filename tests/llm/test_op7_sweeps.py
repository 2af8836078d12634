"""The language model's sweeps: several against brute force, and as many as it takes to settle."""

import math
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from studyloom.llm import op7_pitmanyor as L

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


def held(key):
    return zlib.crc32(key.encode()) % 7 == 2


def one_by_one(customers, mass, discount, key, salt):
    n = t = 0
    for _ in range(customers):
        place = (key + n * 0xD1342543DE82EF95) % (1 << 64)
        if n == 0 or float(L.uniform(np.array([place], np.uint64), salt)[0]) * (mass + n - discount * t) < mass:
            t += 1
        n += 1
    return t


def brute(docs, sweeps, chains=2, strength=1.0, root_strength=10.0):
    """log10 probabilities after so many sweeps, every restaurant in one place."""
    name = {None: int(L.START)} | {w: L.textkit.hash_of(w.encode()) for d in docs.values() for w in d}
    key = lambda u, w: int(L.pair_key(np.array([name[u]], np.uint64), np.array([name[w]], np.uint64))[0])
    pairs, words = Counter(), Counter()
    for i, d in docs.items():
        if not held(str(i)):
            pairs.update(zip([None, *d[:-1]], d, strict=True))
            words.update(d)
    context = Counter(u for u, _ in pairs.elements())
    discount = L.discount_of(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    top_discount = L.discount_of(sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values()))
    base, cut = 1 / (len(words) + 1), 64 - min(64, 24 + sum(map(len, docs.values())).bit_length())
    models = []
    for k in range(chains):
        tables, top = dict.fromkeys(pairs, 1), dict.fromkeys(words, 1)
        for sweep in range(1, sweeps + 2):
            rooms, dishes = Counter(), Counter()
            for (u, w), t in tables.items():
                rooms[u] += t
                dishes[w] += t
            mass = (root_strength + top_discount * sum(top.values())) * base
            p = {w: (max(dishes[w] - top_discount * top.get(w, 0), 0) + mass) / (root_strength + sum(tables.values())) for w in name}
            room = {u: strength + discount * rooms[u] for u in name}
            if sweep <= sweeps:
                tables = {(u, w): one_by_one(c, room[u] * p[w], discount, key(u, w), 2 * (sweep * chains + k)) for (u, w), c in pairs.items()}
                dishes = Counter()
                for (_, w), t in tables.items():
                    dishes[w] += t
                top = {w: one_by_one(dishes[w], mass, top_discount, name[w] >> cut << cut, 2 * (sweep * chains + k) + 1) for w in words}
        models.append((tables, p, room))

    def predicted(u, w):
        return sum((max(pairs[u, w] - discount * t.get((u, w), 0), 0) + room[u] * p[w]) / (strength + context[u]) for t, p, room in models) / chains

    return {i: sum(math.log10(predicted(u, w)) for u, w in zip([None, *d[:-1]], d, strict=True)) for i, d in docs.items()}


@pytest.mark.parametrize("sweeps", [1, 3])
def test_sweeps_against_brute_force(spark, sweeps):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 25)))) for i in range(40)] + [(50, "w1 w2 " * 60), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute({i: [*t.split(), ""] for i, t in rows}, sweeps)
    got = {r["id"]: r["score"] for r in L.scored(docs.repartition(3), held, chunk_bytes=300, hot=3, sweeps=sweeps).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_the_query_sweeps_until_its_tables_settle(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.2, 400) if x < 9000)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, plain = [], L.totals
    monkeypatch.setattr(L, "totals", lambda back, kind: seen.append(plain(back, kind)) or seen[-1])
    assert L.op7_pitmanyor(spark, str(tmp_path)).count() == 200
    assert len(seen) >= 3  # one sweep is no sample of the seating
    for k in (1, 3):  # the tables of the contexts in each chain
        assert abs(seen[-2][k] - seen[-3][k]) <= L.SETTLE * seen[-2][k] + 4 * seen[-2][k] ** 0.5
    assert not L.Law(0.5, 1.0, 0.5, 1.0, 0.1, [[(10_000, 500)], [(12_000, 500)]]).settled(L.SETTLE)


def test_executors_give_memory_back_after_each_sweep(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} and some words") for i in range(30)], "doc_id long, text string")

    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())

    made, plain = [], L.executors_cleaned

    def counted(session):
        before = collections()
        plain(session)
        made.append(collections() - before)

    monkeypatch.setattr(L, "executors_cleaned", counted)
    assert L.scored(docs, held, sweeps=3).count() == 30
    assert len(made) == 3 and min(made) >= 1


def test_a_part_sends_each_word_once_a_sweep(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(60))) for i in range(40)]
    chunks, sent, table, plain = [], [], L.bucketed, L.written

    def kept(df, name, parts):
        out = table(df, name, parts)
        if name == "chunks":
            chunks.append(out[0].count())
        return out

    def seen(df, name):
        out = plain(df, name)
        if name == "lm-state":
            sent.append(sum(r["n"] for r in out.where(f"part >= 0 and kind = {L.WORDS}").collect()))
        return out

    monkeypatch.setattr(L, "bucketed", kept)
    monkeypatch.setattr(L, "written", seen)
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert L.scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), held, chunk_bytes=1, sweeps=2).count() == 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert chunks == [8]
    assert sent == [len({w for _, t in rows for w in t.split()}) + 2] * 3  # the start and two sweeps; with the start and the end of a text


def test_the_keys_sent_are_gone_before_counts_lie_beside_them(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} and some words") for i in range(30)], "doc_id long, text string")

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "/shuffle_" in f}

    before, left, plain, exchange = [], [], L.bucketed, L.exchanged

    def begun(*args, **more):
        before.append(shuffled())
        return exchange(*args, **more)

    def looked(df, name, parts):
        if name == "counted":
            assert "hashpartitioning(kind" not in df._jdf.queryExecution().executedPlan().toString()
            until = time.time() + 10
            while (found := shuffled() - before[0]) and time.time() < until:
                time.sleep(0.2)
            left.append(found)
        return plain(df, name, parts)

    monkeypatch.setattr(L, "exchanged", begun)
    monkeypatch.setattr(L, "bucketed", looked)
    assert L.scored(docs, held).count() == 30
    assert left == [set()]


def test_words_that_occur_once_do_not_travel_in_sweeps(spark, monkeypatch):
    rows = [(i, f"some words and word{i}") for i in range(40)]
    sent, plain = [], L.written

    def seen(df, name):
        out = plain(df, name)
        if name == "lm-state":
            sent.append({r["n"] for r in out.where(f"part >= 0 and kind = {L.WORDS}").groupBy("part").agg(L.F.sum("n").alias("n")).collect()})
        return out

    monkeypatch.setattr(L, "written", seen)
    want = brute({i: [*t.split(), ""] for i, t in rows}, 2)
    got = {r["id"]: r["score"] for r in L.scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(4), held, sweeps=2).collect()}
    assert sent == [{5}] * 3  # some, words, and; with the start and the end of a text
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_no_part_owns_most_of_the_pairs(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string").repartitionByRange(8, "doc_id")
    own, plain = [], L.bucketed

    def kept(df, name, parts):
        out = plain(df, name, parts)
        if name == "counted":
            own.extend(r["n_own"] for r in out[0].where(f"chunk = {L.WHOLE}").collect())
        return out

    monkeypatch.setattr(L, "bucketed", kept)
    assert L.scored(docs, lambda key: False).count() == 8
    assert sum(own) == 3001 and len(own) == 8 and max(own) < 1500


def test_chains_that_share_their_draws_are_seated_as_each_alone():
    rng = np.random.default_rng(2)
    for low, high in ((0, 5), (60, 70), (0, 6000)):
        n, mass, key = rng.integers(low, high, 200), rng.random(200) * 5 + 0.01, rng.integers(0, 1 << 63, 200).astype(np.uint64)
        both = L.seated_in(n, [mass, 2 * mass], 0.6, key, [3, 5])
        for got, m, salt in zip(both, (mass, 2 * mass), (3, 5), strict=True):
            assert got.tolist() == L.seated(n, m, 0.6, key, salt).tolist()
            few = np.flatnonzero(n <= 300)[:50]
            assert got[few].tolist() == [one_by_one(int(n[i]), float(m[i]), 0.6, int(key[i]), salt) for i in few]


def test_ranks_of_keys_that_agree_in_their_upper_bits():
    for x in ([7, 5, 7, 6, 5], [1 << 40, 3, 1 << 40, 2], [], [9]):
        keys, rank = L.ranked(np.array(x, np.uint64))
        assert keys.tolist() == sorted(set(x)) and [int(keys[i]) for i in rank] == x


def test_sweeps_tell_a_part_of_words_in_its_own_pairs_alone(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.permutation(600)[:200])) for i in range(30)]  # words occur often, pairs hardly ever twice
    sent, plain = [], L.written

    def seen(df, name):
        out = plain(df, name)
        if name == "lm-state":
            sent.append(out.where(f"part >= 0 and kind = {L.WORDS}").selectExpr("sum(n)", "sum(length(values)) AS size").first())
        return out

    monkeypatch.setattr(L, "written", seen)
    want = brute({i: [*t.split(), ""] for i, t in rows}, 3)
    got = {r["id"]: r["score"] for r in L.scored(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id"), held, sweeps=3).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
    assert len({r[0] for r in sent}) == 1 and len(sent) == 4
    assert all(2 * r["size"] < sent[-1]["size"] for r in sent[:-1])


def test_later_blocks_of_a_bucket_need_no_keys(spark):
    wire = L.Wire(64, (1, 1))
    words = {0: [5, 7, 11], 3: [7, 11, 13]}
    used = {0: [1, 0, 1], 3: [0, 1, 1]}
    first = [r for p, w in words.items() for r in wire.send(p, L.WHOLE, L.WORDS, np.array(w, np.uint64), [np.full(3, 2), np.full(3, 3), np.array(used[p])])]
    index = L.indexed(spark.createDataFrame(L.blocks(first).to_pandas(), L._BLOCK)).toArrow()
    more = {0: [[1, 0], [4, 1]], 3: [[2, 0], [0, 5]]}  # by context and by word, of the words used
    sent = L.blocks([(p, L.WHOLE, L.WORDS, 0, 3, None, L.packed(np.array(m).ravel())) for p, m in more.items()])
    back = L.swept(sent, index, 1, lambda keys, sums: [keys.astype(np.int64)], False)
    by = lambda part, n: L.unpacked(next(r["values"] for r in back.to_pylist() if r["part"] == part), 3 * n).reshape(3, n).tolist()
    assert by(0, 2) == [[2 + 1, 4 + 0 + 2], [3 + 4, 6 + 1 + 0], [5, 11]] and by(3, 2) == [[6, 2], [7, 3 + 5], [11, 13]]
    assert by(L.KEPT, 4) == [[3, 4, 6, 2], [7, 6, 7, 8], [5, 7, 11, 13]]


def test_counts_are_dealt_before_the_chunks_are_written_anew(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} and some words") for i in range(30)], "doc_id long, text string")
    plans, plain = [], L.bucketed

    def looked(df, name, parts):
        if name == "counted":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, parts)

    monkeypatch.setattr(L, "bucketed", looked)
    L.scored(docs, held)
    assert len(plans) == 1 and "Exchange" not in plans[0]
