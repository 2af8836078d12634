"""Audit, BPE and repair against brute force, the library and odd rows."""

import itertools
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studyloom.llm import op11_audit, op12_bpe, op13_repair

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, source string, bits string, good boolean"
LABELS = "doc_id long, quality int, toxic int"


def _fails(docs):
    out = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
        f = ""
        f += "A" if len(words) < 200 else ""
        f += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        f += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
        f += "D" if any(c in "#$%&*|" for c in text) else ""
        f += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else ""
        out.append(f)
    return out


def _audit(docs, labels):
    fails = _fails(docs)
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(f, any(i is not None and j == i and q == 1 for j, q, _ in labels), any(i is not None and j == i and t == 1 for j, _, t in labels)) for (i, _, p), f in zip(docs, fails) if (p or "") == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                alive = [x for x in own if not before & set(x[0])]
                gone = [x for x in alive if f in x[0]]
                bad = [x for x in own if f in x[0]]
                out[part, "".join(order), step] = [len(alive) - len(gone), len(gone), len(bad) - len(gone), sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(total)
    return out


def _docs():
    rnd = random.Random(3)
    texts = [None, "", " ", "one two", "A B C #", "x " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i}" for i in range(220)) + "\n$", "É" * 30]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice([None, "", "a", "b", "c"])) for _ in range(150)]
    return rows + [(1000 + i, "copy", "hot") for i in range(90)]


def test_audit_equals_a_count_of_every_order(spark):
    docs = _docs()
    labels = [(i, i % 2, i % 3 == 0) for i in range(1060)] + [(5, 0, 1), (5, 1, None), (None, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    df = spark.createDataFrame([(i, t, p, "x", True) for i, t, p in docs], DOCS).repartition(3)
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in op11_audit.audit(df, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == _audit(docs, labels)


def test_audit_sends_on_what_goes_beyond_its_parts(spark):
    rows = spark.range(300).select((F.col("id") % 50).cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("bits"), (F.col("id") % 2 == 0).alias("good"), (F.col("id") % 3 == 0).alias("toxic"))
    few, many = (sorted(map(tuple, op11_audit.prefix_sums(rows, n).collect())) for n in (3, 512))
    assert few == many and len(few) == 50 * 80


def test_audit_of_nothing(spark):
    assert op11_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


ODD = ["a'bs St's 'dlm  ", "ΑΣ ΑΣ. ΑΣΑ", "x<|endoftext|>y<|startoftext|> <|endoftext|>", "É́ß ﬁ İ日本　 \x85\x1c\x00​٣½😀", "donn''s it'S 'Re", "\U000105ca aᲉb", "a" * 500, "zqxjkv" * 300, " \n ", "՘x"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_texts_equal_the_library(name):
    path = public.path(name)
    library, bpe = tokenizers.Tokenizer.from_file(path), op12_bpe.Bpe(op12_bpe.vocabulary(path))
    rnd = random.Random(1)
    signs = "ab'sStdlm ÀÉ́ΣσςİKßﬁ日本　 \x85\x1c\x00​٣½😀<|endoftext|>\t\n'"
    texts = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.encode(t).tolist() for t in texts] == want
    assert bpe.decode(pa.array(want, pa.list_(pa.int32()))).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_pieces_and_every_letter_equal_the_library(monkeypatch):
    path = public.path("word_bpe_49k.json")
    library, bpe = tokenizers.Tokenizer.from_file(path), op12_bpe.Bpe(op12_bpe.vocabulary(path))
    monkeypatch.setattr(op12_bpe, "PIECE", 50)
    text = "Some words,\n\n and  more words's end. " * 40 + "x" * 300
    assert len(list(bpe.pieces(text))) > 20 and "".join(bpe.pieces(text)) == text
    assert bpe.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    signs = [f"a{chr(c)}b" for c in [*range(0x3000), *range(0xA640, 0xAC00), *range(0xF900, 0x11000, 3), *range(0x1E000, 0x1F000, 5)] if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library.encode_batch(signs, add_special_tokens=False)]
    assert [bpe.encode(s).tolist() for s in signs] == want


def test_cuts_lie_where_no_token_has_the_pair():
    path = public.path("word_bpe_49k.json")
    bpe = op12_bpe.Bpe(op12_bpe.vocabulary(path))
    tokens = [t for t in bpe.tokens.to_pylist() if t and not t.startswith("<|")]
    for word in ["qzjxq", "hello", "vqxk", "zz", "a"]:
        marked = [*word[:-1], word[-1] + "</w>"]
        pairs = {i + 1 for i, (a, b) in enumerate(zip(marked, marked[1:])) if not any(a + b in t and (b.endswith("</w>") or True) for t in tokens)}
        assert set(bpe.cuts(word.encode())) >= pairs
        whole = bpe.merged(word.encode(), True)
        assert bpe.word(word) == whole


def test_long_fragments_merge_as_short_ones(monkeypatch):
    bpe = op12_bpe.Bpe(op12_bpe.vocabulary(public.path("word_bpe_49k.json")))
    words = ["".join(random.Random(i).choice("thean") for _ in range(39)).encode() for i in range(200)]
    short = [bpe.merged(w, True) for w in words]
    monkeypatch.setattr(op12_bpe, "KEPT", 0)
    assert [bpe.merged(w, True) for w in words] == short


def test_bpe_of_odd_rows(spark):
    content = op12_bpe.vocabulary(public.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(1, None, "a", "b", True), (None, "", "a", "b", True), (2, "hi " * 50000, "a", "b", True), (2, "hi", None, None, None)], DOCS).withColumnRenamed("source", "ids")
    got = sorted(op12_bpe.decode(op12_bpe.encode(docs, content), content).collect(), key=lambda r: (len(r["ids"]), r["id"] or 0))
    assert [(r["id"], len(r["ids"]), len(r["text"])) for r in got] == [(None, 0, 0), (1, 0, 0), (2, 1, 6), (2, 50000, 349999)]
    assert op12_bpe.encode(docs.limit(0), content).count() == 0
    odd = spark.createDataFrame([(1, [-1, 518, 10**6, 518]), (2, None)], "id long, ids array<int>")
    assert [r["text"] for r in op12_bpe.decode(odd, content).orderBy("id").collect()] == ["the</w> the</w>", ""]


ROWS = "conv_id long, turn long, role string, text string, here string, state long"


def _damaged(rows):
    out = {}
    for c, t, role, text, *_ in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(name.encode()) % 20
        own = out.setdefault(c, [])
        text = "" if harm == 1 else text.translate({ord(x): None for x in ".!?"}) if harm == 2 else text
        own.extend([] if harm == 0 else [(t, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1))
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def _cheapest(rows):
    """All edit strings, with at most two inserts in a row."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def walk(i, said, cost, audit, out, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and (not said or said.lstrip("s") and said[-1] == "a"):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, "\n".join(out))
        want = "assistant" if said.endswith("u") else "user"
        if inserts < 2:
            walk(i, said + want[0], cost + 5, audit + "I", [*out, f"{want}:"], inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            walk(i + 1, said, cost + 2, audit + "D", out, 0)
            if faults[i] not in ("b", "d"):
                extra = 5 if faults[i] == "t" else 0
                if role[:1] == want[0] or role[:1] == "s" and not said:
                    walk(i + 1, said + role[:1], cost + extra, audit + "K", [*out, f"{role}:{text}"], 0)
                walk(i + 1, said + want[0], cost + 1 + extra, audit + "R", [*out, f"{want}:{text}"], 0)

    walk(0, "", 0, "", [], 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, *best]


def test_repair_equals_a_search_over_all_edits(spark):
    import hashlib

    rnd = random.Random(11)
    rows = []
    for c in [None, *range(120)]:
        for t in range(rnd.randint(0, 5)):
            rows.append((c, rnd.choice([t, t, t, t * 2, None]), rnd.choice(["user", "assistant", "system", "tool", "", None, "usr"]), rnd.choice(["Hi.", "Yes!", "cut", " ", None, "Well? \n", "é."]), "x", 1))
    rows += rows[:5]
    got = {r["id"]: list(r)[1:] for r in op13_repair.repaired(op13_repair.damaged(spark.createDataFrame(rows, ROWS).repartition(5))).collect()}
    want = {}
    for c, own in _damaged(rows).items():
        *head, text = _cheapest(own)
        want[c] = [*head, hashlib.sha256(text.encode()).hexdigest()]
    assert got == want


def test_long_conversation_streams(spark):
    n = 20000
    rows = spark.range(n).select(F.lit(7).alias("id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(True).alias("here"))
    got = op13_repair.repaired(rows).collect()
    assert len(got) == 1 and got[0]["audit"] == "K" * n and got[0]["cost"] == 0
    dull = op13_repair.repaired(rows.withColumn("text", F.lit(" "))).collect()
    assert dull[0]["audit"] == "D" * n and dull[0]["blank"] == n


def test_repair_of_nothing_and_of_dropped_rows(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "Hi.", "x", 1)], ROWS)
    row = op13_repair.repaired(op13_repair.damaged(df)).first()
    assert list(row) == [1, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"]
    assert op13_repair.repaired(op13_repair.damaged(df.limit(0))).count() == 0
