"""Scalar functions against values worked out by hand."""

import difflib

import pytest
from pyspark.sql import functions as F

from studyloom.functions import keyterms, quotes, similarity
from studyloom.functions import numbers as N
from studyloom.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or ("",)], list(values) or ["x"]).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (T.stem_key, "Straße  ABC!", "strasse abc"),
        (T.stem_key, "", ""),
        (T.collapsed, " a  b\n\tc ", "a b c"),
        (T.lemma, "assessments", "assessment"),
        (T.lemma, "studies", "study"),
        (T.lemma, "boxes", "boxes"),
        (T.lemma, "lesions", "lesion"),
        (T.lemma, "diagnosis", "diagnosis"),
        (T.lemma, "reported", "report"),
        (T.bullet_text, "-foo", "oo"),
        (T.bullet_text, "- foo", "foo"),
        (T.concept, "Psoriasis: dry, red skin", "Psoriasis"),
        (T.concept, " ", "Lecture concept"),
        (T.category, "Which finding is the priority?", "PRIORITY ASSESSMENT"),
        (T.category, "Which teaching helps?", "PATIENT EDUCATION & SAFETY"),
        (T.category, "Which sign?", "PHYSICAL ASSESSMENT & CUE MAPPING"),
        (T.safe_name, " my file(1).pdf ", "my-file-1-.pdf"),
        (T.safe_name, "***", "document"),
        (T.suffix, "A/B.Tar.PDF", ".pdf"),
        (T.heading_level, "[Heading 3] x", 3),
        (T.heading_level, "[heading] x", 1),
        (T.heading_level, "x", None),
        (T.heading_text, "[Heading 3]  x ", "x"),
        (T.answer_text, "Correct Answer: B", "b"),
        (T.word_count, " a b", 3),
        (T.html_escaped, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"),
        (T.paragraphs, " a \r\n\r\n b\n", "a\n\nb"),
    ],
)
def test_text(spark, function, given, want):
    assert one(spark, function(F.col("x")), x=given) == want


def test_labels_and_titles(spark):
    line = "Intro Causes: smoke Risk factors: age"
    assert one(spark, T.labels(F.col("x")), x=line) == ["Intro Causes:", "Risk factors:"]
    assert [p.strip() for p in one(spark, T.label_parts(F.col("x")), x=line)] == ["", "smoke", "age"]
    assert one(spark, T.term_title(F.split("x", " ")), x="signs of heart failure") == "Signs of Heart Failure"


def test_rounding_and_splits(spark):
    assert [one(spark, N.half_even(F.col("x")), x=v) for v in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert [one(spark, N.half_up(F.col("x")), x=v) for v in (0.5, 1.5, 2.5, -0.5)] == [1, 2, 3, 0]
    assert one(spark, N.even_split(F.col("n"), F.col("k")), n=25, k=3) == [9, 8, 8]
    assert one(spark, N.clamp(F.col("x"), 1, 100), x=500) == 100


def test_canonical_quotes(spark):
    source = "alpha  beta\n gamma delta"
    own = quotes.Source(source)
    assert own.canonical("beta gamma delta") == "beta\n gamma delta"
    assert own.canonical("bowel") is None and own.canonical("alpha gamma delta") is None and own.canonical(None) is None
    assert quotes.Source("x " * 50_000 + "the end of it").canonical("x the  end of it") == "x the end of it"
    got = one(spark, quotes.canonical_quotes(F.col("s"), F.col("q")), s=source, q=["beta gamma delta", "nope", "beta gamma  delta"])
    assert got == ["beta\n gamma delta"]


def test_similarity(spark):
    assert one(spark, similarity.ratio(F.col("a"), F.col("b")), a="tide", b="diet") == difflib.SequenceMatcher(None, "tide", "diet").ratio()
    for a, b in (("abcd", "abce"), ("", ""), ("", "a"), ("same", "same"), ("a" * 300, "a" * 280 + "b" * 20)):
        r = difflib.SequenceMatcher(None, a, b).ratio()
        assert similarity.at_least(a, b, r) and (r == 1.0 or not similarity.at_least(a, b, r + 1e-9))


def test_key_terms():
    got = keyterms.key_terms("Fluid Volume Deficit\nThe kidney absorbs water. Hypertension is common.")
    assert got[0] == "Fluid Volume Deficit" and "Hypertension Is Common" in got and not any("Water" in t for t in got)
    assert keyterms.key_terms(" ") == [] and len(keyterms.key_terms("Alphabet Betamax Gammaray " * 9, limit=3)) <= 3
    for term in got:
        assert sum(term.lower() in other.lower() for other in got) == 1


def test_a_source_is_split_only_for_quotes_that_differ_from_it_in_white_space(monkeypatch):
    text = " One  two\x1cthree four.　\nFive\tsix seven "
    own = quotes.Source(text)
    assert own.canonical("two three  four. Five") == "two\x1cthree four.　\nFive" and own.canonical("One two three") == "One  two\x1cthree"
    assert own.canonical("Five six seven") == "Five\tsix seven" and own.canonical("seven Five six") is None

    class Never:
        def finditer(self, text):
            raise AssertionError("the places of all pieces are not needed")

    monkeypatch.setattr(quotes, "_PIECE", Never())
    assert quotes.Source(text).canonical("Five\tsix seven") == "Five\tsix seven"
    assert quotes.Source(text).canonical("nowhere in the text") is None
