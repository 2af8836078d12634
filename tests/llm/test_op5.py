import random
import re

import pyarrow as pa

from studyloom.llm import op5_repetition as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or "")}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out["n_dup_lines"] = len(again)
    out["dup_line_chars"] = sum(len("".join(WORD.findall(x))) for x in again)
    for n in [3, *R.NGRAM_PERCENT]:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)}
        if n == 3:
            out["n_repeat_words"] = len(inside)
        else:
            out[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in inside)
    return out


def test_measures_against_brute_force():
    rng = random.Random(7)
    texts = [None, "", "\n \n"]
    for _ in range(120):
        texts.append("".join(rng.choice(["a", "b", "é", "c#", "dd"]) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 90))))
    found = R.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert {k: int(found[k][i]) for k in R._NAMES} == brute(t), t


def test_odd_rows_and_passing(odd_docs, no_docs):
    rows = R.measures(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r["kept"] for r in rows if r["n_words"] < 50)
    long = next(r for r in rows if r["id"] == 8)
    assert long["n_words"] == 20_000 and long["n_repeat_words"] == 20_000 and long["base_failed"] and not long["kept"]
    assert R.passing(odd_docs).count() == sum(r["kept"] for r in rows) and R.passing(odd_docs).columns == odd_docs.columns
    assert R.measures(no_docs).count() == 0


def test_a_line_repeated_once_does_not_fail_a_clean_text(spark):
    rng = random.Random(1)
    clean = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(1, f"one two three four five six\n{clean}\none two three four five six"), (2, "buy this now my friend and be glad\n" * 20)], "doc_id long, text string")
    assert {r["id"]: r["kept"] for r in R.measures(docs).collect()} == {1: True, 2: False}
