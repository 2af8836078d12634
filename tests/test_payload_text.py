"""Base64 of payloads, and labels in whole texts."""

import base64

from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.sources import office, requests


def test_base64_is_one_line(spark):
    rows = [(b"",), (b"a" * 200,), (bytes(range(256)) * 40,), (None,)]
    for legacy in ("true", "false"):
        spark.conf.set("spark.sql.legacy.chunkBase64String.enabled", legacy)
        got = spark.createDataFrame(rows, "c binary").select("c", office.encoded(F.col("c")).alias("b"), office.payload_bytes(F.col("c")).alias("n")).collect()
        for r in got:
            want = None if r["c"] is None else base64.b64encode(bytes(r["c"])).decode()
            assert r["b"] == want and r["n"] == len(want or "") * 3 // 4
    spark.conf.unset("spark.sql.legacy.chunkBase64String.enabled")


def test_labels_in_whole_texts(spark):
    text = "Causes: one\ntwo Risk factors: age\nxCauses: no, A: short, Labs (CBC/BMP): low"
    row = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(T.labels(F.col("t")).alias("l"), T.label_parts(F.col("t")).alias("p")).collect()
    assert row[0]["l"] == ["Causes:", "Risk factors:", "Labs (CBC/BMP):"] and row[0]["p"] == ["", "one\ntwo ", "age\nxCauses: no, A: short, ", "low"]
    assert row[1]["l"] == [] and row[2]["l"] is None


def test_base64_of_uploads_ends_where_it_ends(spark):
    rows = [("a.txt", "YWJj"), ("a.txt", "YWI="), ("a.txt", "YWJ\n"), ("a.txt", "YWI=\r\n=="), ("a.xls", "YWJj"), ("a.txt", None), (None, "YWJj")]
    found = requests.uploads(spark.createDataFrame(rows, "filename string, content_base64 string")).collect()
    assert [(r["status"], r["content"] and bytes(r["content"])) for r in found] == [(200, b"abc"), (200, b"ab"), (422, None), (422, None), (415, None), (400, None), (415, None)]
