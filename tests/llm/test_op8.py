import math
import random

import numpy as np
import pytest

from studyloom.llm import op8_latent as D


def test_lcs_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 30))]
        b = [rng.randrange(5) for _ in range(rng.randint(0, 40))]
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert D.lcs(a, b) == row[-1]


def test_sums_against_a_loop():
    rng = np.random.default_rng(0)
    table = rng.random((20, 3)).astype(np.float32)
    group = np.sort(rng.integers(0, 30, 500))
    row = rng.integers(0, 20, 500)
    want = np.zeros((30, 3))
    np.add.at(want, group, table[row])
    for small in (0, 10, 1000):
        assert np.allclose(D._sums(table, row, group, 30, step=7, small=small), want, rtol=1e-4)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    common = [f"c{i}" for i in range(20)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]

    items = {k: prose(rng.randint(15, 90)) for k in range(40)}
    docs, want = {}, set()
    for i in range(400):
        own = prose(rng.randint(0, 600))
        if i % 8 == 0:
            k = rng.randrange(40)
            said = list(items[k])
            for j in range(len(said) // 10):
                said[rng.randrange(len(said))] = f"new{j}"
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() for w in said] if i % 16 else said
            want.add((i, k))
        docs[i] = " ".join(own) if i % 3 else ", ".join(own) + "!"
    d = spark.createDataFrame([(i, t, 1) for i, t in docs.items()] + [(1000, None, 1), (1001, "", 1)], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([*((k, " ".join(w)) for k, w in items.items()), (99, None), (98, " ")], "item_id long, text string")
    return d, b, want


@pytest.mark.parametrize("most_items", [4096, 15])
def test_planted_passages_are_found_and_nothing_else(planted, most_items):
    docs, items, want = planted
    rows = D.matches(docs, items, D.Settings(most_items=most_items)).collect()
    assert {(r["id"], r["item_id"]) for r in rows} == want and all(r["share"] >= 0.8 for r in rows)


def test_clean_drops_what_matches_and_keeps_the_rest(planted):
    docs, items, want = planted
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {i for i, _ in want}
    assert D.clean(docs.limit(0), items).count() == 0 and D.clean(docs, items.limit(0)).count() == docs.count()


def test_answer_decides_a_paraphrase():
    s = D.Settings()
    item = D.read_items([(1, "Which of the seven hills was settled first by the founders? The Palatine hill")])
    near = "which of the seven old hills was by people first settled in legend the palatine hill"
    far = near.replace("palatine", "other")
    for text, bad in ((near, True), (far, False)):
        share, hit = D.judged(item.words[0], item.answers[0], D.folded(D.pa.array([text])).hash, s)
        assert s.paraphrase <= share < s.same and hit == bad


def test_latent_space_spans_the_leading_eigenvectors():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 40)) * (0.5 ** np.arange(40))
    c = x.T @ x / 500
    omega = rng.standard_normal((40, 20))
    u = D.latent_space(c @ omega, omega, 6)
    value, vector = np.linalg.eigh(c)
    top = vector[:, ::-1][:, :6]
    assert np.linalg.norm(u.T @ top) > 0.99 * np.sqrt(6)


def test_thousands_of_items_against_brute_force(spark):
    """Items stand in other words, half of them with a fifth of their words changed; every one that the words decide on is found."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(12000)]
    common = [f"c{i}" for i in range(30)]

    def prose(n):
        return [rng.choice(common) if rng.random() < 0.5 else words[int(len(words) * rng.random() ** 2)] for _ in range(n)]

    items = {k: prose(rng.randint(12, 40)) for k in range(2000)}
    docs, want = [], set()
    for i in range(300):
        k = rng.randrange(2000)
        said, own = list(items[k]), prose(rng.randint(40, 200))
        if i % 2:
            for j in rng.sample(range(len(said)), len(said) // 5):
                said[j] = rng.choice(words)
        at = rng.randint(0, len(own))
        docs.append((i, " ".join(own[:at] + said + own[at:])))
        assert D.lcs(items[k], said) >= 0.8 * len(said)
        want.add((i, k))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in D.matches(d, b).collect()}
    assert want <= got


def test_an_item_of_common_words_is_found_in_a_large_corpus(spark):
    """All but two words of the item are in a quarter of the blocks, and those two are changed in the document."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(24)]
    item = [*common[:9], "rare1", *common[9:18], "rare2"]
    said = ["other1" if w == "rare1" else "other2" if w == "rare2" else w for w in item]
    docs = [(i, " ".join(w for b in range(5) for w in rng.sample(common, 6) + [f"w{rng.randrange(5000)}" for _ in range(26)])) for i in range(300)]
    docs.append((1000, " ".join(f"w{rng.randrange(5000)}" for _ in range(12)) + " " + " ".join(said)))
    items = [(1, " ".join(item))] + [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(20))) for k in range(2, 30)]
    found = D.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["id"], r["item_id"]) for r in found.collect()} == {(1000, 1)}


def test_windows_without_the_words_of_an_item_are_not_compared(monkeypatch):
    """Contamination and its share are those of all windows, and few windows are compared."""
    from studyloom.llm import op8_latent as T

    rng, s, calls, plain = np.random.default_rng(11), T.Settings(), [], T.lcs

    def all_windows(item, answer, text):
        own, size, shares, hit = item.tolist(), math.ceil(1.25 * len(item)) + 2, [], False
        step = max(1, len(own) // 4)
        for at in range(0, max(1, len(text) - size + step), step):
            window = text[at : at + size].tolist()
            shares.append(plain(own, window) / len(own))
            ends = answer.tolist() if answer is not None else None
            hit |= ends is not None and s.paraphrase <= shares[-1] < s.same and any(window[i : i + len(ends)] == ends for i in range(len(window) - len(ends) + 1))
        return max(shares), hit or max(shares) >= s.same

    monkeypatch.setattr(T, "lcs", lambda a, b: calls.append(1) or plain(a, b))
    found, windows = 0, 0
    for i in range(300):
        item, text = rng.integers(0, 60, rng.integers(1, 40)), rng.integers(0, 200, rng.integers(0, 150))
        answer = item[-2:] if i % 2 else None
        if i % 3 == 0 and len(text) > len(item):
            part = item.copy()
            part[rng.random(len(part)) < 0.25] = 999
            text[: len(part)] = part
        want, got = all_windows(item, answer, text), T.judged(item, answer, text, s)
        assert got[1] == want[1] and (got == want or not want[1])
        found += want[1]
        windows += len(range(0, max(1, len(text) - math.ceil(1.25 * len(item)) - 2 + max(1, len(item) // 4)), max(1, len(item) // 4)))
    assert found > 20 and len(calls) < windows / 2
