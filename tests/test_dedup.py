"""Fuzzy deduplication against the greedy fold."""

import random

from pyspark.sql import functions as F

from studyloom.functions.similarity import at_least
from studyloom.operators import dedup

SCHEMA = "request string, ordinal long, id string, stem_key string, concept_key string, node string"


def _greedy(rows, hashes):
    kept = {}
    for r in sorted(rows, key=lambda r: (r[1], hashes[r[3] or "", r[4] or ""])):
        own = kept.setdefault(r[0], [])
        stem, concept = r[3] or "", r[4] or ""
        if not any(at_least(stem, s, 0.75 if c == concept else 0.94) for s, c, _ in own):
            own.append((stem, concept, r[2]))
    return {(q, i) for q, own in kept.items() for _, _, i in own}


def _hashes(df):
    text = [F.coalesce(c, F.lit("")) for c in ("stem_key", "concept_key")]
    return {(a, b): h for a, b, h in df.select(*text, F.xxhash64(*text)).collect()}


def _changed(rnd, stem, n):
    out = list(stem)
    for _ in range(n):
        at = rnd.randrange(len(out) + 1)
        if rnd.random() < 0.5 and out:
            del out[min(at, len(out) - 1)]
        else:
            out.insert(at, rnd.choice("abcdefgh "))
    return "".join(out)


def _rows(seed, n):
    rnd = random.Random(seed)
    words = ["assess", "skin", "pain", "first", "nurse", "which", "is", "of", "the", "patient", "lesion", "care", "plan"]
    bases = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(25)] + ["", "a", "ab", "abc", "abcd", "w " * 110]
    out = []
    for i in range(n):
        stem = rnd.choice(bases)
        stem = _changed(rnd, stem, rnd.choice([0, 0, 1, 2, 3, 8, 20]))
        out.append((rnd.choice(["m1", "m2", None]), i if rnd.random() < 0.9 else 7, f"q{i}", rnd.choice([stem, stem, stem, None]) if i % 9 == 0 else stem, rnd.choice(["x", "y", "z", None])))
    return out


def test_equals_the_greedy_fold(spark):
    for seed in (1, 2):
        rows = _rows(seed, 220)
        rows += [(*r[:2], r[2] + "again", *r[3:]) for r in rows[:10]]
        df = spark.createDataFrame([(*r, "n") for r in rows], SCHEMA).repartition(3)
        got = dedup.fuzzy_dedup(df)
        assert got.columns == df.columns
        assert {(r["request"], r["stem_key"] or "", r["concept_key"] or "") for r in got.collect()} == {(q, r[3] or "", r[4] or "") for q, i in _greedy(rows, _hashes(df)) for r in rows if r[2] == i}


def test_many_near_copies_make_rows_in_proportion(spark):
    rnd = random.Random(5)
    base = "which finding of the patient with a new lesion does the nurse report first"
    rows = [("m", i, str(i), _changed(rnd, base, 1), f"c{i}", "n") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert dedup.fuzzy_dedup(df).count() == len(_greedy([r[:5] for r in rows], _hashes(df)))


def test_nothing(spark):
    assert dedup.fuzzy_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_grams_are_a_lower_bound():
    rnd = random.Random(9)
    for _ in range(3000):
        a = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 40)))
        b = _changed(rnd, a, rnd.choice([0, 1, 2, 5, 12]))
        for r, q in ((0.94, 3), (0.94, 1), (0.75, 1)):
            if at_least(b, a, r) and a and b:
                x, y = (dedup.numbered(s, q, b"") for s in (a, b))
                assert len(set(x.tolist()) & set(y.tolist())) >= dedup.least_shared(len(a), r, q)
                assert len(b) in dedup.partners(len(a), r)
