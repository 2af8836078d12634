"""What keeps the work of a query in step with its tables."""

import os
import random

import pandas as pd

from studyloom.functions import keyterms
from studyloom.operators import chunking, dedup, grounding, structure
from studyloom.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_lines_of_a_text_are_made_once_for_all_its_questions(spark):
    plan = catalog._line_questions(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1


def test_sections_told_beside_the_text_are_those_of_places_and_spans(spark):
    rng = random.Random(5)
    texts = [(i, "\n".join(rng.choice(["one two three four", "aa  bb\taa bb aa bb", "x\x1cy three four one two", "naïve café five six"]) for _ in range(rng.randint(1, 40)))) for i in range(30)]
    sources = spark.createDataFrame(texts, "id long, text string")
    quotes = spark.createDataFrame([(f"{i}-{k}", i, t[a : a + rng.randint(5, 60)]) for i, t in texts for k in range(20) for a in [rng.randrange(len(t))]], "id string, source_id long, quote string")
    spans = spark.createDataFrame([(i, f"{i}.{k}", k * 30, k * 30 + 50) for i, t in texts for k in range(30)], "source_id long, section string, first int, last int")
    want = grounding.contained(grounding.located(sources, quotes), spans, ["source_id"]).select("quote_id", "section").distinct()
    got = grounding.held(sources, quotes, spans, most=7)
    assert got.count() == want.count() > 100
    assert got.exceptAll(want).isEmpty()


def test_search_and_automaton_find_the_same_places():
    quotes, text = ["aa", "ab", "", "aab", "aa", "none"], "aaabaab ab"
    assert sorted(grounding.places_in(quotes, text)) == sorted(grounding.Finder(quotes).places(text))


def test_small_requests_are_not_spread_over_grams(spark, monkeypatch):
    rng = random.Random(3)
    stem = "which finding of the patient with a new lesion does the nurse report first"
    rows = [(f"m{i % 5}", i, "".join(c for c in stem if rng.random() > 0.04), f"c{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "request string, ordinal long, stem_key string, concept_key string")
    spread = {tuple(r) for r in dedup.fuzzy_dedup(df, most=0).collect()}
    mixed = {tuple(r) for r in dedup.fuzzy_dedup(df.unionByName(df.selectExpr("concat(request, 'x') request", "ordinal + 300 * ordinal % 2 ordinal", "stem_key", "concept_key")), most=59).collect()}

    def none(*_):
        raise AssertionError("a small request goes over grams")

    monkeypatch.setattr(dedup, "independent", none)
    assert {tuple(r) for r in dedup.fuzzy_dedup(df).collect()} == spread
    assert {r for r in mixed if "x" not in r[0]} == spread
    assert 5 < len(spread) < 300


def test_a_word_is_described_once_and_only_windows_with_medical_words_are_made(monkeypatch):
    calls = []
    monkeypatch.setattr(keyterms, "lemma", lambda w, own=keyterms.lemma: calls.append(w) or own(w))
    text = " ".join(f"Zq{a}{b}word plainer" for a in "abcd" for b in "abcd") * 20 + ". Zqhypo Zqvolume found."
    assert keyterms.key_terms(text)[0] == "Zqhypo Zqvolume Found"
    assert len(calls) <= 60


def test_sections_go_back_in_pieces(monkeypatch):
    monkeypatch.setattr(structure, "PIECE", 1000)
    texts = pd.Series([f"Heading {i}\nA point of the page, told at length." for i in range(100)] + [None, ""])
    got = list(structure.in_pieces(iter([(texts, pd.Series([1] * 102))])))
    assert len(got) > 5
    assert [x for part in got for x in part] == [structure.sections(t, 1) for t in texts]


def test_known_levels_make_no_pass_to_count_them(spark, monkeypatch):
    measured = chunking.source_chunks(catalog._nested_sources(spark, FOLDER)).collect()

    def none(_):
        raise AssertionError("levels are counted")

    monkeypatch.setattr(chunking, "levels", none)
    assert sorted(map(str, catalog._nested_chunks(spark, FOLDER).collect())) == sorted(map(str, measured))
    assert catalog.page_structure(spark, FOLDER).count() > 0


def test_files_are_made_once_for_their_members(spark):
    plan = catalog.slide_pictures(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
