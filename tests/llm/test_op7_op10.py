import math
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from studyloom.llm import op7_pitmanyor as L
from studyloom.llm import op10_language as Z


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [""]


def held(key):
    return zlib.crc32(key.encode()) % 7 == 2


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 200)) if x < 5000), 1) for i in range(300)]
    rows += [(900, None, 1), (901, "", 1), (902, "spam " * 3000, 1), (903, rows[5][1], 1), (903, rows[5][1], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, word int").repartition(4)


def test_base_figures_against_brute_force(corpus):
    rows = corpus.collect()
    got = L.scored(corpus, held, chunk_bytes=20_000).collect()
    assert len(got) == len(rows)
    seen = Counter(w for r in rows if not held(str(r["doc_id"])) for w in tokens(r["text"]))
    n, v = sum(seen.values()), len(seen)
    texts = {r["doc_id"]: tokens(r["text"]) for r in rows}
    for r in got:
        own = texts[r["id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(seen[w] > 0 for w in own)
        assert math.isclose(r["base_score"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0 and r["held_out"] == held(str(r["id"]))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    twice = [r["score"] for r in got if r["id"] == 903]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])


def test_no_training_rows_and_no_rows(corpus):
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in L.scored(corpus.where("doc_id = 901"), lambda k: True).collect())
    assert L.scored(corpus.limit(0), held).count() == 0


def brute_tables(customers, mass, discount, key, salt):
    """Customers sit down one after the other."""
    n = t = 0
    for _ in range(customers):
        place = (key + n * 0xD1342543DE82EF95) % (1 << 64)
        if n == 0 or float(L.uniform(np.array([place], np.uint64), salt)[0]) * (mass + n - discount * t) < mass:
            t += 1
        n += 1
    return t


def brute_scores(docs, chains=2, strength=1.0, root_strength=10.0):
    """The model from its definition: every restaurant in one place, one customer at a time."""
    name = {None: int(L.START)} | {w: L.textkit.hash_of(w.encode()) for d in docs.values() for w in d}
    pairs, words = Counter(), Counter()
    for i, d in docs.items():
        if not held(str(i)):
            pairs.update(zip([None, *d[:-1]], d, strict=True))
            words.update(d)
    context = Counter(u for u, _ in pairs.elements())
    discount = L.discount_of(sum(c == 1 for c in pairs.values()), sum(c == 2 for c in pairs.values()))
    root_discount = L.discount_of(sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values()))
    base = 1 / (len(words) + 1)
    cut = 64 - min(64, 24 + sum(map(len, docs.values())).bit_length())
    models = []
    for k in range(chains):
        tables = dict.fromkeys(pairs, 1)
        top = dict.fromkeys(words, 1)

        def parent(w):
            n = sum(t for (_, x), t in tables.items() if x == w)
            return (max(n - root_discount * top.get(w, 0), 0) + (root_strength + root_discount * sum(top.values())) * base) / (root_strength + sum(tables.values()))

        def room(u):
            return strength + discount * sum(t for (x, _), t in tables.items() if x == u)

        new = {}
        for (u, w), c in pairs.items():
            key = int(L.pair_key(np.array([name[u]], np.uint64), np.array([name[w]], np.uint64))[0])
            new[u, w] = brute_tables(c, room(u) * parent(w), discount, key, 2 * (chains + k))
        mass = (root_strength + root_discount * sum(top.values())) * base
        tables = new
        top = {w: brute_tables(sum(t for (_, x), t in tables.items() if x == w), mass, root_discount, name[w] >> cut << cut, 2 * (chains + k) + 1) for w in words}
        p = {w: parent(w) for w in name if w is not None}
        rooms = {u: room(u) for u in name}
        models.append((dict(tables), p, rooms))

    def predicted(u, w):
        return sum((max(pairs[u, w] - discount * t.get((u, w), 0), 0) + rooms[u] * p[w]) / (strength + context[u]) for t, p, rooms in models) / chains

    total = sum(predicted("w1", w) for w in words)
    assert 0.5 < total < 1  # the rest is for words never seen
    return {i: sum(math.log10(predicted(u, w)) for u, w in zip([None, *d[:-1]], d, strict=True)) for i, d in docs.items()}


def test_scores_against_brute_force_and_over_layouts(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 25)))) for i in range(50)] + [(50, "w1 w2 " * 60), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_scores({i: tokens(t) for i, t in rows})
    one = {r["id"]: r["score"] for r in L.scored(docs.repartition(1), held, chunk_bytes=300, hot=3).collect()}
    five = {r["id"]: r["score"] for r in L.scored(docs.repartition(5), held).collect()}
    assert one.keys() == five.keys() == want.keys()
    for i in want:
        assert one[i] == pytest.approx(five[i], rel=1e-9) and one[i] == pytest.approx(want[i], rel=1e-9)


def test_seating_one_by_one_and_by_thinning():
    """Few customers agree with the definition one by one, many have the known mean of a plain restaurant."""
    rng = np.random.default_rng(0)
    n, mass, key = rng.integers(0, 300, 200), rng.random(200) * 5 + 0.01, rng.integers(0, 1 << 63, 200).astype(np.uint64)
    got = L.seated(n, mass, 0.6, key, 9)
    assert got.tolist() == [brute_tables(int(c), float(m), 0.6, int(k), 9) for c, m, k in zip(n, mass, key, strict=True)]
    customers, strength = 50_000, 5.0
    many = L.seated(np.full(600, customers), np.full(600, strength), 0.0, rng.integers(0, 1 << 63, 600).astype(np.uint64), 3)
    p = strength / (strength + np.arange(customers))
    assert abs(many.mean() - p.sum()) < 4 * math.sqrt((p * (1 - p)).sum() / 600)
    assert L.seated(np.zeros(0, np.int64), np.zeros(0), 0.5, np.zeros(0, np.uint64), 1).tolist() == []


def test_packing_and_buckets():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.array([0, 0, 7], np.uint64), rng.integers(0, 1 << 63, 999).astype(np.uint64) * np.uint64(2)):
        assert L.unpacked(L.packed(x), len(x)).tolist() == x.tolist()
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    wire = L.Wire(40, (64, 7))
    rows = list(wire.send(3, 4, L.PAIRS, keys, [np.arange(len(keys))]))
    assert [r[3] for r in rows] == list(range(7)) and sum(r[4] for r in rows) == len(keys)
    assert np.concatenate([np.cumsum(L.unpacked(r[5], r[4]), dtype=np.uint64) for r in rows]).tolist() == (keys >> np.uint64(24)).tolist()


def test_languages_on_held_out_rows(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()
    docs = spark.createDataFrame(list(zip(t["doc_id"], t["text"], t["lang"], strict=True)), "doc_id long, text string, lang string")
    lang = dict(zip(t["doc_id"], t["lang"], strict=True))
    train = docs.filter("pmod(crc32(cast(doc_id as string)), 5) <> 0")
    found = [r for r in Z.classify(docs, Z.dictionaries(train)).collect() if zlib.crc32(str(r["id"]).encode()) % 5 == 0]
    assert len(found) > 100 and sum(r["lang_pred"] == lang[r["id"]] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_rows(odd_docs, no_docs):
    dicts = Z.dictionaries(odd_docs)
    assert list(dicts) and set(dicts) <= {"en", "de", "fr"} and all(len(d) <= 192 * 513 for d in dicts.values())
    rows = {r["id"]: r for r in Z.classify(odd_docs, dicts).collect()}
    assert [rows[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and rows[4]["score"] == 0 and rows[8]["lang_pred"] == "de"
    assert Z.dictionaries(no_docs) == {} and Z.classify(no_docs, {}).count() == 0
    assert {r["lang_pred"] for r in Z.classify(odd_docs, {}).collect()} == {"und"}
