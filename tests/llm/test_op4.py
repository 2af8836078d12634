import pytest

from studyloom.llm import op4_archive as A
from studyloom.llm.shared import fresh_path, written

PAGES = "page_id long, url string, html string, payload string, rank int"


@pytest.fixture(scope="module")
def pages(spark):
    same = "<p>same\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(3, "http://a/ b", same), (1, "http://a/", same), (2, None, None), (4, "", ""), (5, "http://c/", "é" * 3000), (6, "http://c/", "x\n\n\nfiledesc://"), (6, "http://c/", "x\n\n\nfiledesc://"), (7, "http://d/", same)]
    return spark.createDataFrame([(*r, "p", 1) for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("file_bytes", [400, 1 << 20])
def test_round_trip(spark, pages, version, file_bytes):
    arc, warc = fresh_path(spark, "t-arc"), fresh_path(spark, "t-warc")
    A.write_arc(pages, arc, version=version, file_bytes=file_bytes)
    assert {r["version"] for r in A.read_arc(spark, arc).collect()} == {version}
    A.write_warc(written(A.converted(A.read_arc(spark, arc)), "t-parts"), warc, file_bytes=file_bytes)
    back = A.read_warc(spark, warc).collect()
    assert len(back) == pages.count()
    assert len({r["headers"]["warc-record-id"] for r in back}) == len(back)
    assert sum(r["headers"]["warc-type"] == "response" for r in back) == len({r["html"] or "" for r in pages.collect()})
    by_id = {r["headers"]["warc-record-id"]: r for r in back}
    first = {}
    for r in sorted(pages.collect(), key=lambda r: r["page_id"]):
        first.setdefault(r["html"] or "", r["page_id"])
    for r in back:
        h, key = r["headers"], int(r["http"].split(b"X-Key: %3D")[1].split(b"\r\n")[0])
        source = next(x for x in pages.collect() if x["page_id"] == key)["html"] or ""
        assert h["warc-payload-digest"] == "sha1:" + A.digest(source.encode())
        assert h["warc-date"] == "2008-01-01T00:00:00Z"
        if first[source] == key and h["warc-type"] == "response":
            assert h["warc-type"] == "response" and r["payload"] == source.encode()
        else:
            assert h["warc-type"] == "revisit" and r["payload"] == b""
            assert by_id[h["warc-refers-to"]]["payload"] == source.encode()


def test_least_bytes_leaves_small_payloads_alone(spark, pages):
    arc, warc = fresh_path(spark, "t-arc"), fresh_path(spark, "t-warc")
    A.write_arc(pages, arc)
    A.write_warc(written(A.converted(A.read_arc(spark, arc)), "t-parts"), warc, least_bytes=10_000)
    assert {r["headers"]["warc-type"] for r in A.read_warc(spark, warc).collect()} == {"response"}


def test_broken_archives_are_errors():
    good = A.arc_version_block(1) + b"http://a 1.1.1.1 20010203040506 text/html 5\nhello\n"
    assert [r[6] for r in A.parse_arc(good)] == [b"hello"] and next(A.parse_arc(good))[3] == "20010203040506"
    for bad in (good[:-4], good.replace(b"text/html ", b""), b"http://a 1.1.1.1 2001 t 0\n"):
        with pytest.raises(ValueError):
            list(A.parse_arc(bad))
    with pytest.raises(ValueError):
        list(A.parse_warc(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def test_query_on_a_folder(spark, pages, tmp_path):
    pages.unionByName(spark.createDataFrame([(None, "http://n", "<i>no key</i>", "p", 1)], PAGES)).write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r["page_id"]: r for r in A.op4_archive(spark, str(tmp_path)).collect()}
    assert (rows[1]["record_type"], rows[3]["record_type"], rows[7]["refers_to"]) == ("response", "revisit", 1)
    assert rows[4]["refers_to"] == 2 and rows[2]["payload_bytes"] == 0 and rows[3]["payload_bytes"] == rows[1]["payload_bytes"] > 0
    assert rows[None]["record_type"] == "response" and rows[None]["payload_bytes"] == 13
    pages.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert A.op4_archive(spark, f"{tmp_path}/none").count() == 0


def test_keys_of_text_and_repeated_rows(spark, tmp_path):
    rows = [("b/ 1", "u", "same"), ("a:\u00e9", "u", "same"), ("a:\u00e9", "u", "same"), ("", "u", "other"), (None, "u", "other")]
    spark.createDataFrame(rows, "page_id string, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = A.op4_archive(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"] or "", r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 4) == [("a:\u00e9", "response", None), ("a:\u00e9", "revisit", "a:\u00e9"), ("b/ 1", "revisit", "a:\u00e9")]
    assert [(r["page_id"], r["record_type"]) for r in got if r["payload_bytes"] == 5 and r["record_type"] == "response"] == [(None, "response")]
    assert [(r["page_id"], r["refers_to"]) for r in got if r["payload_bytes"] == 5 and r["record_type"] == "revisit"] == [("", None)]
