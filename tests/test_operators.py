"""Operators against small examples worked out by hand, and properties that must hold."""

import io
import zipfile

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studyloom.operators import chunking, dedup, grounding, planning, provider, structure, tables, validation
from studyloom.sources import files


def test_packing(spark):
    rows = spark.createDataFrame([("s", "n", "\n".join("x" * n for n in (900, 1000, 300, 1700, 50)))], "sourceId string, sourceName string, text string")
    got = chunking.raw_chunks(rows).orderBy("sectionId").collect()
    assert [(r["sectionId"], r["n_lines"]) for r in got] == [("s-raw-1", 1), ("s-raw-2", 2), ("s-raw-3", 2)]


def test_allocation_by_hand():
    assert planning.allocated([800, 200], 100) == [55, 45]  # the cap pass sends the excess back once
    assert planning.split(25, 10) == [9, 8, 8]
    assert planning.allocated([100], 7) == [7]
    assert planning.allocated([10, 10, 10], 2) == [1, 1, 0] and planning.evened([9, 0, 0], 4) == [4, 3, 2]
    assert planning.dealt([3, 1, 2], [4, 2]) == [[(0, 3), (1, 1)], [(2, 2)]] and planning.dealt([5, 1], [2, 2, 2]) == [[(0, 2)], [(1, 1), (0, 1)], [(0, 2)]]
    assert planning.planned([("a", 100), ("a", 100)], 4, 2, offset=7) == [(7, "a", 2), (8, "a", 2)] and planning.planned([], 3, 2) == []


def test_a_raw_chunk_counts_its_heading_and_its_lines_twice(spark):
    rows = spark.createDataFrame([("s", "n", "abc\ncde")], "sourceId string, sourceName string, text string")
    chunk = chunking.raw_chunks(rows).first()
    assert chunk["chars"] == len("\n".join([chunk["heading"], "abc", "cde", "abc", "cde"])) and chunk["text"] == "abc\ncde"
    plan = planning.coverage_plan(chunking.raw_chunks(rows).selectExpr("sourceId AS request", "1 AS ordinal", "sectionId", "chars"), 12).collect()
    assert sorted((r["batch"], r["quota"]) for r in plan) == [(0, 6), (1, 6)]  # its six characters alone would be too few


@given(st.lists(st.integers(45, 5000), min_size=1, max_size=12), st.integers(1, 100), st.integers(5, 20))
def test_plans_use_every_question(lengths, count, size):
    shares = planning.allocated(lengths, count)
    assert sum(shares) == count and min(shares) >= 0
    plans = planning.dealt(shares, planning.split(count, size))
    assert sum(n for b in plans for _, n in b) == count
    used = [0] * len(lengths)
    for b in plans:
        assert sum(n for _, n in b) <= size
        for i, n in b:
            used[i] += n
    assert used == shares


def test_fuzzy_dedup_is_greedy():
    a, near, far = "which finding is most important now", "which finding is most important here", "name the largest organ of the body"
    assert dedup.survivors([a, near, far, a], ["x", "x", "x", "y"]) == [True, False, True, False]
    assert dedup.survivors([a, near], ["x", "y"], same=0.99) == [True, True]
    stems = [a, near, far]
    kept = [s for s, k in zip(stems, dedup.survivors(stems, ["x"] * 3), strict=True) if k]
    assert all(dedup.survivors(kept, ["x"] * len(kept)))


def test_merge_adds_each_stem_once(spark):
    schema = "module_id string, normalized_stem string, ordinal int"
    bank = spark.createDataFrame([("m", "a", 0)], schema)
    new = spark.createDataFrame([("m", "a", 1), ("m", "b", 2), ("m", "b", 3), ("m", "", 4)], schema)
    inserted = tables.fresh(new, bank, [F.col("ordinal")])
    assert [(r["normalized_stem"], r["ordinal"]) for r in inserted.collect()] == [("b", 2)]
    counts = tables.merge_counts(new, inserted, bank).first()
    assert (counts["generated"], counts["inserted"], counts["duplicates"], counts["total"]) == (4, 1, 3, 2)
    assert tables.fresh(new, bank.unionByName(inserted), [F.col("ordinal")]).count() == 0


def test_grounding_in_one_or_many_automata(spark):
    sources = spark.createDataFrame([(1, "Some  alpha beta\ngamma delta text"), (2, "nothing here at all"), (3, None), (4, "alpha beta gamma delta")], "id long, text string")
    quoted = spark.createDataFrame([(10, "alpha beta gamma"), (11, "alpha beta gamma"), (12, "short"), (13, "nothing here at all")], "id long, quote string")
    want = {(1, 10), (1, 11), (4, 10), (4, 11), (2, 13)}
    for size in (1 << 20, 16):
        got = grounding.grounded(sources, quoted, most_bytes=size)
        assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in grounding.unique_source(got).collect()} == {(13, 2)}


def test_structure_events():
    text = "Heart failure\n[Heading 2] Causes\n- weak pump\nTreatment\nRest. Risk factors: age\n[Heading] Next\nFull sentence."
    got = structure.sections(text, 4)
    assert [s["header"] for s in got] == ["Heart failure", "Next"]
    assert [(s["header"], s["bullet_points"]) for s in got[0]["subsections"]] == [("Causes", ["weak pump"]), ("Treatment", ["Rest."]), ("Risk factors", ["age"])]
    assert got[1]["bullet_points"] == ["Full sentence."] and got[0]["page_number"] == 4
    assert structure.sections("A full sentence.", 2)[0]["header"] == "Page 2" and structure.sections(None, 1) == []


def test_answers():
    ids, texts = list("ABCD"), ["one", "two", "three", "four"]

    def index(v, **k):
        return provider.correct_index(v, ids, texts, k.pop("options", texts), **k)

    assert index(1, zero_based=True) == 1 and index(1) == 0 and index(0) == 0 and index(9) == -1
    assert index("Option B") == 1 and index("c) three") == 2 and index("FOUR") == 3 and index("2") == 1 and index("zzz") == -1
    assert index({"text": "two"}) == 1
    assert index(None, options=[{"correct": False}, {"isCorrect": True}]) == 1


def test_uniform_replies():
    got = provider.uniform('{"items": [{"question": "Which is first?", "options": [{"text": "a"}, "b", "c", "d"], "answer": "b", "evidence": [{"quote": "q"}, "q"], "rationales": ["r1", "r2", "r3", "r4"]}, 5]}')
    assert got == [{"category": "PRIORITY ASSESSMENT", "stem": "Which is first?", "options": ["a", "b", "c", "d"], "correctIndex": 1, "correctRationale": "r2", "evidenceQuotes": ["q"]}]
    assert provider.uniform("nonsense") == provider.uniform("[]") == provider.uniform(None) == []
    assert provider.Replay({("n", "p"): "{}"}).reply("n", "p") == "{}"


def test_validation_uses_up_quota(spark):
    rows = [("b", 1, "s", 1, "stem one", "c1", None), ("b", 2, "s", 1, "stem two", "c2", None), ("b", 3, None, None, "x", "c", None), ("b", 4, "t", 2, "stem one", "c3", None), ("b", 5, "t", 2, "other", "c4", "short")]
    q = spark.createDataFrame(rows, "batch string, ordinal long, section string, quota int, stem_key string, concept_key string, reason string")
    got = {r["ordinal"]: r["reason"] for r in validation.judged(q).collect()}
    assert got == {1: None, 2: "no section with quota left", 3: "no section with quota left", 4: "stem repeats", 5: "short"}


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Causes</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/media/i.png", b"x")
    (tmp_path / "d.docx").write_bytes(packed.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "t.TXT").write_text("plain ü")
    (tmp_path / "p.png").write_bytes(b"png")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.xls").write_bytes(b"x")
    got = {r["path"].rpartition("/")[2]: r for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert set(got) == {"d.docx", "bad.docx", "t.TXT", "p.png", "f.pdf"}
    assert got["d.docx"]["text_hint"] == "[Heading 2] Causes\n  • item\na | b" and got["d.docx"]["n_images"] == 1
    assert got["t.TXT"]["text_hint"] == "plain ü" and got["p.png"]["mime_type"] == "image/png"
    assert got["bad.docx"]["warning"].startswith("unreadable") and got["f.pdf"]["warning"] == "no reader for this format"


def test_stream_feeds_the_bank_once(spark, tmp_path):
    from studyloom.streaming import bank

    schema = "module_id string, stem string, created_at timestamp"
    source, out, check = (str(tmp_path / n) for n in ("in", "bank", "check"))

    def send(rows, name):
        spark.createDataFrame([(m, s) for m, s in rows], "module_id string, stem string").withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000))).write.json(f"{source}/{name}")

    send([("m", "First stem?"), ("m", "first STEM"), ("n", "First stem?")], "a")
    bank.feed(bank.arriving(spark, f"{source}/*", schema), out, check).awaitTermination()
    send([("m", "First stem!"), ("m", "Second stem")], "b")
    bank.feed(bank.arriving(spark, f"{source}/*", schema), out, check).awaitTermination()
    got = {(r["module_id"], r["normalized_stem"]) for r in spark.read.parquet(out).collect()}
    assert got == {("m", "first stem"), ("n", "first stem"), ("m", "second stem")} and spark.read.parquet(out).count() == 3
