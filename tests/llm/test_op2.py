import random
import re

import xxhash
from pyspark.sql import functions as F

from studyloom.llm import op2_simhash as S


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        for k in range(rng.randint(1, 4)):
            own = list(base)
            if k and own:
                own[rng.randrange(len(own))] = "Changed"
            texts[10 * i + k] = " ".join(own)
    texts[900], texts[901], texts[902] = None, "", " \t"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in S.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == brute_components(prints)


def test_chain_of_fingerprints_is_one_component(spark):
    """A long chain, each link two bits from the last: no shortcut, so components must walk it."""
    rng = random.Random(1)
    chain = [rng.getrandbits(64)]
    for i in range(200):
        chain.append(chain[-1] ^ (1 << (2 * i % 64)) ^ (1 << (2 * i + 1) % 64) if i < 32 else chain[-1] ^ rng.choice([3, 5, 9]) << rng.randrange(60))
    fps = spark.createDataFrame([(S._signed(x),) for x in set(chain)], "fp long")
    links = S.fingerprint_links(fps)
    found = {r["node"]: r["root"] for r in S.components(links).collect()}
    want = brute_components({S._signed(x): x for x in set(chain)})
    assert found == {k: v for k, v in want.items() if k in found} and set(found) >= {k for k, v in want.items() if k != v}


def test_large_blocks_use_neighbour_lookup_and_agree():
    import numpy as np

    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 14, 3000).astype(np.uint64)
    free = (1 << 14) - 1

    def groups(links):
        root = {int(v): int(v) for v in values}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return {v: find(v) for v in root}

    assert groups(S.linked(values, 2, free, small=10**9)) == groups(S.linked(values, 2, free, small=1))
    assert len(S.linked(values, 2, free)) < len(values)


def test_representatives_keep_one_row_of_each_group(spark, odd_docs, no_docs):
    kept = S.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert 1 in ids and 2 not in ids and ids.count(9) == 1 and 4 in ids and 5 not in ids and 6 not in ids
    assert S.representatives(no_docs).count() == 0
    assert S.near_duplicates(odd_docs).where(F.col("id") == 9).count() == 2
