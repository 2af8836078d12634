"""Cases that once went wrong: markup, archive records, long items and targets that cannot be met."""

import time
import warnings

import pytest
from pyspark.sql import functions as F

from studyloom.llm import op1_styletree as H
from studyloom.llm import op4_archive as A
from studyloom.llm import op8_latent as D
from studyloom.llm import op9_raking as M
from studyloom.llm.shared import fresh_path, written


def text(html):
    return H.extract(H.parse(html), {})


def test_an_article_keeps_what_its_ids_and_classes_seem_to_announce():
    page = '<article><h2 id="search-and-navigation">Heads</h2><p class="alert-text">Take care.</p><div class="post-content reply-to-critics"><p>A long answer to what was said of it.</p></div><div class="share-bar">Share</div></article>'
    assert text(page) == "Heads\nTake care.\nA long answer to what was said of it."


def test_all_articles_of_a_page_and_their_formulas():
    page = "<article><p>" + "Much is said here. " * 20 + "</p></article><article>Little here: E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>mc^2</annotation></math> it is.</article>"
    assert text(page).split("\n")[1:] == ["Little here: E = mc2 it is."]


@pytest.mark.parametrize("page", ["<div>" * 50000 + "<td>x</td>" * 50000, "<span>" * 50000 + "<div></div>" * 50000, "<li><ul>" + "<div>" * 50000 + "<li></li>" * 25000, "<p>" * 100000, "<b>" * 50000 + "</i>" * 50000])
def test_a_hundred_thousand_tags(page):
    began = time.process_time()
    H.parse(page)
    assert time.process_time() - began < 4


def test_tags_close_as_in_a_browser():
    def blocks(html):
        return text(html).split("\n")

    assert blocks("<article><p>a<div>b</div>c<p>d<span>e<p>f</article>") == ["a", "b", "c", "de", "f"]
    assert blocks("<article><ul><li>a<ul><li>b</ul>c<li>d</ul></article>") == ["a", "b", "c", "d"]
    assert blocks("<article><table><tr><td>a<td>b<tr><td>c<tbody><tr><td>d</table></article>") == ["a", "b", "c", "d"]
    assert blocks("<article><b>a<p>b</b>c</article>") == ["a", "bc"]


@pytest.mark.parametrize(
    ("stamp", "date"),
    [("20080102030405", "2008-01-02T03:04:05Z"), ("200801", "2008-01-01T00:00:00Z"), ("2008", "2008-01-01T00:00:00Z"), ("", "0001-01-01T00:00:00Z"), ("20081399", "2008-01-01T00:00:00Z"), ("-", "0001-01-01T00:00:00Z"), ("0000", "0001-01-01T00:00:00Z")],
)
def test_arc_dates(stamp, date):
    assert A.warc_date(stamp) == date


def test_records_without_http_are_resources(spark):
    row = [(1, "dns:example.org", "1.1.1.1", "200801", "text/dns", None, bytearray(b"20080101\nexample.org"), "a"), (1, "dns:example.org", "1.1.1.1", "200801", "text/dns", None, bytearray(b"20080101\nexample.org"), "b"), (1, "http://x/", "1.1.1.1", "2008", "text/html", None, bytearray(b"HTTP/1.1 200 OK\r\nX-Key: %3D1\r\n\r\n20080101\nexample.org"), "c")]
    path = fresh_path(spark, "t-dns")
    A.write_warc(written(A.converted(spark.createDataFrame(row, A.ARC_SCHEMA)), "t-parts"), path)
    got = sorted((r["headers"]["warc-type"], r["headers"]["content-type"], r["headers"]["warc-date"], bytes(r["payload"])) for r in A.read_warc(spark, path).collect())
    assert got == [("resource", "text/dns", "2008-01-01T00:00:00Z", b"20080101\nexample.org")] * 2 + [("response", "application/http; msgtype=response", "2008-01-01T00:00:00Z", b"20080101\nexample.org")]


def test_control_characters_keep_urls_apart(spark):
    urls = [f"http://x/{chr(c)}" for c in (*range(1, 33), 127)] + ["http://x/%20", "http://x/a"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(A.percent_encoded(F.col("u"))).collect()]
    assert got == [f"http://x/%{c:02X}" for c in (*range(1, 33), 127)] + ["http://x/%20", "http://x/a"]


def test_items_outside_ascii_are_measured_by_their_words(spark):
    words = [chr(0x430 + i % 32) + chr(0x430 + i // 32 % 32) + chr(0x430 + i % 7) for i in range(640)]
    items = [(i, " ".join(words[i:] + words[:i])) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(0, items[0][1])], "doc_id long, text string")
    s = D.Settings(most_items=64)
    found = list(D.searches(docs, bench, s))
    assert len(found) > 5
    assert sum(len(x.items.ids) for x in found) == 60


def test_targets_that_cannot_be_met_are_told(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2], "xy"[i % 2], "t") for i in range(40)], "doc_id long, text string, source string, lang string, topic string")
    goals = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, target double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, target double")}
    cells = M.mixing(docs, targets=goals, topic_col="topic")
    with pytest.warns(UserWarning, match="meet all targets"):
        assert not M.met(cells)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert M.met(M.mixing(docs))


def test_rows_without_ids_are_drawn_one_by_one(spark):
    docs = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    n = M.sampled(docs, share=0.5).count()
    assert 220 < n < 380
