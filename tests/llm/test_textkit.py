import random
import re

import numpy as np
import pyarrow as pa

from studyloom.llm import textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    texts = [None, "", " ", "a", *("".join(rng.choice("aé \t\n\x0b\x1c ß") for _ in range(rng.randint(0, 30))) for _ in range(300))]
    w = textkit.words(pa.array(texts))
    for i, t in enumerate(texts):
        own = [w.word(k).decode() for k in range(w.first[i], w.first[i + 1])]
        assert own == WORD.findall(t or "")


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data = [f"w{i % 50}" for i in range(3000)]
    w = textkit.words(pa.array([" ".join(data)]))
    by = {}
    for i, x in enumerate(data):
        assert by.setdefault(x, w.hash[i]) == w.hash[i]
    assert len(set(by.values())) == 50
    assert int(w.hash[3]) == textkit.hash_of(b"w3")
    small = textkit.segment_hashes(w.buf, w.start, w.end, block=16)
    assert np.array_equal(small, w.hash)


def test_slices_keep_rows_and_bound_bytes():
    batch = pa.record_batch([pa.array(range(50)), pa.array(["x" * (i * 7) for i in range(50)])], names=["id", "text"])
    parts = list(textkit.sliced(iter([batch]), "text", 300))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(50))
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 300 for p in parts)
