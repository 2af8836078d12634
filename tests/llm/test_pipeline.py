"""The stages of the pipeline against brute force."""

import random

import pytest

import corpus_pipeline
from studyloom.llm import op2_simhash


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """The least id of each component of texts with 5-word Jaccard of 0.8 or more."""
    sets, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


@pytest.fixture(scope="module")
def near_copies():
    """Groups whose members have some words changed: 5-word Jaccard from about 0.7 to 1."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for k in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 40) if k else 0):
                own[rng.randrange(len(own))] = f"Changed{rng.randrange(10**6)}"
            texts[10 * i + k] = " ".join(own)
    return texts


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in texts.items()], "doc_id long, text string, lang string, source string").repartition(5)


def test_near_dedup_against_brute_force(spark, near_copies):
    docs = table(spark, near_copies)
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    want = brute_kept(near_copies)
    assert kept == want and len(want) < len(near_copies)


def test_near_dedup_chain_of_similar_texts_is_one_group(spark):
    """Neighbours are similar and share bands with different partners; the ends are not similar."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(260)]
    texts = {}
    for k in range(12):
        texts[k] = " ".join(words[4 * k : 4 * k + 200])
    texts[50] = " ".join(rng.sample(words, 100))
    kept = {r["doc_id"] for r in op2_simhash.representatives(table(spark, texts)).collect()}
    assert kept == brute_kept(texts) == {0, 50}


def test_near_dedup_does_not_pair_all_texts_that_share_a_passage(spark, monkeypatch):
    """A passage in 250 texts and a group of copies with a few to many words changed: pairs stay few, no link is lost."""
    rng = random.Random(7)
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(200)]
    texts = {k: " ".join([f"o{k}x{i}" for i in range(rng.randint(30, 60))] + passage) for k in range(250)}
    for k in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"changed{rng.randrange(10**6)}"
        texts[1000 + k] = " ".join(own)
    pairs, plain = [], op2_simhash.verified

    def counted(found, *rest):
        found = op2_simhash.written(found, "counted")
        pairs.append(found.count())
        return plain(found, *rest)

    monkeypatch.setattr(op2_simhash, "verified", counted)
    kept = {r["doc_id"] for r in op2_simhash.representatives(table(spark, texts)).collect()}
    assert kept == brute_kept(texts)
    # a node has a first partner in each band, and one in the middle; all pairs of the passage's texts alone are 31125
    assert sum(pairs[1:]) <= 20 * len(texts), pairs
