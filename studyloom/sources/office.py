"""Office files to members: a row for each page and for each picture on it.

A table function is called laterally on each file's bytes.  A task holds one
file's members at a time; `files.members` leaves out files beyond a size.
Payloads stay bytes; base64, sizes and limits are column expressions over the
members.

A slide's shapes are read from top to bottom and from left to right.  A
placeholder without a place of its own has its layout's, else its master's,
else zeros.  Slides come in the order of the presentation, not of their files'
names.  Shapes inside groups are not read.  A null or broken file gives one
page with a warning.
"""

from __future__ import annotations

import io
import mimetypes
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Node = ElementTree.Element
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Labels of pictures, and the mime type of a Word page.
SLIDE_LABEL = "Embedded image in slide {}"
FIGURE_LABEL = "Embedded figure: {}"
WORD_MIME = "application/xml"

MEMBER = "page_number int, kind string, label string, mime_type string, text_hint string, content binary, n_images int, warning string"


def _mime(name: str) -> str:
    return mimetypes.guess_type(name)[0] or "application/octet-stream"


class Package:
    """The parts of an office file and what they refer to."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = self.zip.namelist()
        self.known = set(self.names)

    def tree(self, part: str) -> Node:
        return ElementTree.fromstring(self.zip.read(part))

    def targets(self, part: str) -> dict[str, str]:
        """The parts that a part refers to, by the ids of its relations."""
        folder, name = posixpath.split(part)
        relations = f"{folder}/_rels/{name}.rels"
        if relations not in self.known:
            return {}
        inner = (r for r in self.tree(relations) if r.get("TargetMode") != "External")
        return {r.get("Id") or "": posixpath.normpath(posixpath.join("/", folder, r.get("Target") or ""))[1:] for r in inner}


def _cells(values: Iterator[str]) -> str:
    return " | ".join(v for v in (v.strip() for v in values) if v)


def _paragraph(p: Node) -> str:
    text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in {f"{_W}t", f"{_W}tab", f"{_W}br"}).strip()
    if not text:
        return ""
    style = p.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(f"{_W}val") or "") if style is not None else ""
    if m := re.match(r"heading\s*(\d+)", name, re.I):
        return f"[Heading {max(1, int(m[1]))}] {text}"
    if name.lower().startswith("title"):
        return f"[Heading 1] {text}"
    level = p.find(f"{_W}pPr/{_W}numPr")
    if level is not None:
        depth = level.find(f"{_W}ilvl")
        return "  " * min(int(depth.get(f"{_W}val") or 0) if depth is not None else 0, 8) + f"• {text}"
    return text


def word_members(data: bytes) -> Iterator[tuple]:
    """A Word file's single page, paragraphs and table rows in document order, then its pictures."""
    package = Package(data)
    body = package.tree("word/document.xml").find(f"{_W}body")
    lines: list[str] = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            lines.append(_paragraph(block))
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                lines.append(_cells(" ".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")))
    pictures = [n for n in package.names if n.startswith("word/media/") and _mime(n).startswith("image/")]
    yield 1, "page", None, WORD_MIME, "\n".join(x for x in lines if x), None, len(pictures), None
    for name in pictures:
        yield 1, "picture", FIGURE_LABEL.format(posixpath.basename(name)), _mime(name), None, package.zip.read(name), None, None


def _said(shape: Node) -> str:
    """The text of a shape or cell: a line for each paragraph, a vertical tab for a break inside one."""
    def paragraph(p: Node) -> str:
        return "".join("\v" if r.tag == f"{_A}br" else "".join(t.text or "" for t in r.iter(f"{_A}t")) for r in p)

    return "\n".join(paragraph(p) for p in shape.iter(f"{_A}p"))


def _slot(shape: Node) -> tuple[str, str] | None:
    """The index and type by which a placeholder is found in its layout and master."""
    ph = shape.find(f".//{_P}nvPr/{_P}ph")
    return None if ph is None else (ph.get("idx") or "0", ph.get("type") or "obj")


def _own_place(shape: Node) -> tuple[int, ...] | None:
    off, ext = shape.find(f".//{_A}off"), shape.find(f".//{_A}ext[@cx]")
    if off is None:
        return None
    return (*(int(off.get(k) or 0) for k in "xy"), *(int(ext.get(k) or 0) if ext is not None else 0 for k in ("cx", "cy")))


def _places(package: Package, part: str, by: int) -> dict[str, tuple[int, ...]]:
    """Where a layout's or master's placeholders lie, by their index (0) or type (1)."""
    out: dict[str, tuple[int, ...]] = {}
    for shape in package.tree(part).iter(f"{_P}sp"):
        slot, place = _slot(shape), _own_place(shape)
        if slot and place:
            out.setdefault(slot[by], place)
    return out


def _inherited(package: Package, slide: str) -> tuple[dict, dict]:
    layout = next((t for t in package.targets(slide).values() if "/slideLayouts/" in t and t in package.known), None)
    if layout is None:
        return {}, {}
    master = next((t for t in package.targets(layout).values() if "/slideMasters/" in t and t in package.known), None)
    return _places(package, layout, 0), _places(package, master, 1) if master else {}


def _slides(package: Package) -> list[str]:
    """The slides' parts in the presentation's order; by number where the presentation names none."""
    listed: list[str] = []
    if "ppt/presentation.xml" in package.known:
        targets = package.targets("ppt/presentation.xml")
        ids = (s.get(f"{_R}id") or "" for s in package.tree("ppt/presentation.xml").iter(f"{_P}sldId"))
        listed = [targets[i] for i in ids if targets.get(i) in package.known]
    numbered = ((re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n), n) for n in package.names)
    return listed or [n for _, n in sorted((int(m[1]), n) for m, n in numbered if m)]


def slide_members(data: bytes) -> Iterator[tuple]:
    """A page for each slide, every line after its shape's place, and then the slide's pictures in the same order."""
    package = Package(data)
    for number, part in enumerate(_slides(package), 1):
        by_index, by_type = _inherited(package, part)
        targets, tree = package.targets(part), package.tree(part).find(f"{_P}cSld/{_P}spTree")
        shapes = []
        for shape in tree if tree is not None else ():
            if shape.tag in {f"{_P}sp", f"{_P}graphicFrame", f"{_P}pic"}:
                index, kind = _slot(shape) or (None, None)
                shapes.append((_own_place(shape) or by_index.get(index) or by_type.get(kind) or (0, 0, 0, 0), shape))
        lines, pictures = [], []
        for (x, y, w, h), shape in sorted(shapes, key=lambda s: (s[0][1], s[0][0])):
            place = f"[x={x}, y={y}, w={w}, h={h}] "
            rows = list(shape.iter(f"{_A}tr"))
            if rows:
                lines += [place + " | ".join(_said(c).strip() for c in r.findall(f"{_A}tc")) for r in rows]
            elif shape.tag == f"{_P}sp" and (text := _said(shape).strip()):
                lines.append(place + text.replace("\n", " / "))
            blip = shape.find(f".//{_A}blip") if shape.tag == f"{_P}pic" else None
            image = targets.get(blip.get(f"{_R}embed") or "") if blip is not None else None
            if image in package.known:
                pictures.append(image)
        yield number, "page", None, "text/plain", "\n".join(lines), None, len(pictures), None
        for name in pictures:
            yield number, "picture", SLIDE_LABEL.format(number), _mime(name), None, package.zip.read(name), None, None


READERS = {".docx": word_members, ".pptx": slide_members}


class _Members:
    """Table function: the members of one file."""

    def eval(self, suffix: str, content: bytes) -> Iterator[tuple]:
        reader, last = READERS.get(suffix or ""), 0
        if reader is None or content is None:
            yield 1, "page", None, "text/plain", None, None, 0, "no reader for this format" if content is not None else "no content"
            return
        try:
            for member in reader(bytes(content)):
                last = member[0]
                yield member
        except Exception as e:  # a broken file must not fail the others; what was read of it stays
            yield last + 1, "page", None, "text/plain", None, None, 0, f"unreadable: {type(e).__name__}"


def members(files: DataFrame) -> DataFrame:
    """files (with suffix and content, and any other columns) with a row for each page and picture, in place of content."""
    read = F.udtf(_Members, returnType=MEMBER)
    own = files.withColumnRenamed("content", "_file")
    return own.lateralJoin(read(F.col("suffix").outer(), F.col("_file").outer())).drop("_file")


def payload_bytes(content: Column) -> Column:
    """The size that limits on payloads go by: three bytes for each four letters of base64, begun ones included."""
    return (F.ceil(F.coalesce(F.octet_length(content), F.lit(0)) / 3) * 3).cast("long")


def encoded(content: Column) -> Column:
    """Base64 in one line, whatever line length the session's base64 breaks at; null where there is no payload."""
    return F.regexp_replace(F.base64(content), r"[\r\n]+", "")
