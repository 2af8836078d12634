"""Members of office files, page limits and page batches."""

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from studyloom.operators import pages
from studyloom.plans import views
from studyloom.sources import files, office

REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def shape(text, place="", ph=""):
    body = "".join(f"<a:p>{p}</a:p>" for p in text.split("\n"))
    return f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{place}</p:spPr><p:txBody>{body}</p:txBody></p:sp>"


def at(x, y):
    return f'<a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="5" cy="6"/></a:xfrm>'


def run(t):
    return f"<a:r><a:t>{t}</a:t></a:r>"


def deck():
    table = f'<p:graphicFrame><p:xfrm><a:off x="1" y="30"/><a:ext cx="5" cy="6"/></p:xfrm><a:tbl><a:tr><a:tc><a:p>{run("k")}</a:p></a:tc><a:tc><a:p/></a:tc><a:tc><a:p>{run("v")}</a:p></a:tc></a:tr></a:tbl></p:graphicFrame>'
    picture = f'<p:pic><p:blipFill><a:blip r:embed="rId2"/></p:blipFill><p:spPr>{at(0, 0)}</p:spPr></p:pic>'
    first = shape(run("low"), at(0, 90)) + shape(run("right"), at(9, 20)) + shape(run("left") + "<a:br/>" + run("more") + "\n" + run("end"), at(1, 20)) + table + shape(run("title"), "", '<p:ph idx="0" type="title"/>') + shape(run("  "), at(0, 1)) + picture
    tree = "<p:sld {}><p:cSld><p:spTree>{}</p:spTree></p:cSld></p:sld>".format
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide2.xml", tree(views._NAMES, first))
        z.writestr("ppt/slides/slide10.xml", tree(views._NAMES, shape(run("second"), at(0, 0))))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", f'<Relationships xmlns="{REL}"><Relationship Id="rId1" Target="../slideLayouts/slideLayout1.xml"/><Relationship Id="rId2" Target="/ppt/media/a.jpeg"/><Relationship Id="rId3" Target="http://x" TargetMode="External"/></Relationships>')
        z.writestr("ppt/slideLayouts/slideLayout1.xml", tree(views._NAMES, shape("", at(7, 8), '<p:ph type="title"/>')))
        z.writestr("ppt/media/a.jpeg", b"\xff\xd8pic")
    return out.getvalue()


def test_slides_in_order_with_inherited_places():
    got = list(office.slide_members(deck()))
    assert got[0][4].split("\n") == [
        "[x=7, y=8, w=5, h=6] title", "[x=1, y=20, w=5, h=6] left\vmore / end", "[x=9, y=20, w=5, h=6] right", "[x=1, y=30, w=5, h=6] k |  | v", "[x=0, y=90, w=5, h=6] low",
    ]
    assert got[1] == (1, "picture", "Embedded image in slide 1", "image/jpeg", None, b"\xff\xd8pic", None, None)
    assert got[2][:2] == (2, "page") and got[2][4].endswith("second") and len(got) == 3


def test_slides_follow_the_presentation():
    got = [m for m in office.slide_members(views.slides_file([["a & b", "c"], ["d"]]))]
    assert [(m[0], m[1]) for m in got] == [(1, "page"), (1, "picture"), (2, "page"), (2, "picture")]
    assert got[0][4] == "[x=0, y=0, w=900, h=80] a & b\n[x=0, y=100, w=900, h=80] c" and got[3][5] == b"d"


def test_members_of_files(spark):
    rows = [("a.pptx", deck()), ("b.PPTX", b"no zip"), ("c.docx", None), ("d.png", b"1234"), ("e.txt", b""), ("f.pdf", b"%PDF"), ("g.xls", b"x"), ("h.pptx", b"x" * 5000)]
    made = spark.createDataFrame(rows, "path string, content binary").withColumn("length", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")).withColumn("label", F.lit("own")).withColumn("_FILE", F.lit(1))
    found = files.members(made, most_bytes=4000).collect()
    by = {}
    for r in found:
        by.setdefault(r["path"], []).append(r)
    assert set(by) == {"a.pptx", "b.PPTX", "c.docx", "d.png", "e.txt", "f.pdf", "h.pptx"}
    assert sorted((r["page_number"], r["kind"], r["n_images"]) for r in by["a.pptx"]) == [(1, "page", 1), (1, "picture", None), (2, "page", 0)]
    assert by["b.PPTX"][0]["warning"] == "unreadable: BadZipFile" and by["c.docx"][0]["warning"] == "no content"
    assert bytes(by["d.png"][0]["content"]) == b"1234" and by["e.txt"][0]["text_hint"] == "" and by["f.pdf"][0]["warning"] == "no reader for this format"
    assert by["h.pptx"][0]["warning"] == "file is too large"
    sizes = {(r["doc"], r["page_number"]): r["n_bytes"] for r in files.page_sizes(files.members(made)).collect()}
    assert sizes["d.png", 1] == len(base64.b64encode(b"1234")) * 3 // 4 and sizes["a.pptx", 1] == 6 and sizes["a.pptx", 2] == 0
    assert {r["image_base64"] for r in files.pictures(files.members(made)).collect()} == {base64.b64encode(b"\xff\xd8pic").decode()}
    assert files.members(made.limit(0)).count() == 0
    given = files.members(made, pdf_pages=lambda data: [("one", b"png"), ("two", None)]).where("path = 'f.pdf'").collect()
    assert [(r["page_number"], r["text_hint"], r["n_images"]) for r in given] == [(1, "one", 1), (2, "two", 0)]


def fold(rows, most, cap):
    """Page batches by a plain loop."""
    out, held = [], 0
    for n, b in sorted(rows, key=lambda r: (r[0] is not None, r)):
        if not out or len(out[-1]) >= most or held + (b or 0) > cap:
            out, held = [*out, []], 0
        out[-1].append(n)
        held += b or 0
    return out


@pytest.mark.parametrize(("most", "cap"), [(5, 10**9), (5, 100), (2, 30), (1, 1)])
def test_batches_as_a_loop(spark, most, cap):
    import random

    rng = random.Random(most * 31 + cap % 7)
    rows = [(None if d == 3 else f"d{d}", p, rng.choice([0, 1, 20, 40, 99, 150])) for d in range(9) for p in range(rng.randint(1, 24))]
    rows += [("nulls", None, None), ("nulls", 1, None), ("nulls", 1, None), *[("hot", p, 1) for p in range(400)]]
    frame = spark.createDataFrame(rows, "doc string, page_number int, n_bytes long")
    want = {}
    for d in {r[0] for r in rows}:
        own = [(p, b) for doc, p, b in rows if doc == d]
        if len(own) <= 20 and max((b or 0) for _, b in own) <= 120:
            want |= {(d, i): x for i, x in enumerate(fold(own, most, cap))}
    assert {(r["doc"], r["batch"]): r["page_numbers"] for r in pages.batches(frame, 20, 120, most, cap).collect()} == want
    refused = {r["doc"]: r["refusal"] for r in pages.guarded(frame, 20, 120).collect()}
    assert refused["hot"] == "too many pages" and refused["nulls"] is None and {d for d, why in refused.items() if not why} == {d for d, _ in want}
    assert pages.batches(frame.limit(0)).count() == 0 and pages.guarded(frame.limit(0)).count() == 0
