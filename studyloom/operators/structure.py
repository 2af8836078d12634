"""Lines of a page into sections and subsections, without a layout model.

Every line becomes events (open a section, open a subsection, add a point);
a fold over the events builds the sections.  A page is one row and pages are
independent, so this is a row-wise Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyterms import key_terms

SUBSECTION = "struct<header:string,bullet_points:array<string>,key_terms:array<string>,summary_notes:string,page_number:int>"
SECTION = f"struct<header:string,bullet_points:array<string>,key_terms:array<string>,summary_notes:string,page_number:int,subsections:array<{SUBSECTION}>>"
#: Lines that open a subsection wherever they stand.
SUBHEADINGS = frozenset(
    [
        "assessment",
        "causes",
        "clinical manifestations",
        "clinical significance",
        "complications",
        "definition",
        "diagnosis",
        "etiology",
        "meaning",
        "nursing considerations",
        "nursing interventions",
        "pathophysiology",
        "patient education",
        "prevention",
        "risk factors",
        "signs and symptoms",
        "treatment",
    ]
)
#: So many characters of pages are built and sent back at once.
PIECE = 1 << 20
#: Fixed value: the confidence of this parser, below the least that raises no warning.
CONFIDENCE = 0.54
#: The patterns of heading lines and of labels within a line, and the most characters of a header.
_HEADING = re.compile(r"\[Heading(?:\s+(\d+))?\]\s*(.*)", re.I)
_LABEL = re.compile(r"(?<!\w)([A-Z][A-Za-z0-9 /&()'-]{2,55}:)\s*")
_HEADER_CHARS = 120


def _short(line: str) -> bool:
    return len(line) <= 100 and not line.endswith((".", "!", "?"))


def events(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """("section" | "sub" | "point", text) for the lines of a page."""
    opened = False
    for line in lines:
        if m := _HEADING.fullmatch(line):
            found = [("sub" if int(m[1] or 1) > 1 else "section", m[2].strip())]
        elif len(parts := _LABEL.split(line)) > 1:
            lead = parts[0].strip()
            found = [("section" if not opened and _short(lead) else "point", lead)] if lead else []
            for label, text in zip(parts[1::2], parts[2::2], strict=True):
                found += [("sub", label[:-1].strip()), ("point", text.strip())]
        else:
            bare = line.rstrip(":").strip()
            kind = "section" if not opened and _short(line) else "sub" if opened and bare.casefold() in SUBHEADINGS else "point"
            found = [(kind, line if kind == "point" else bare)]
        for kind, text in found:
            if kind != "point" or text:
                opened = True
                yield kind, text


def sections(text: str | None, page: int) -> list[dict]:
    """The sections of a page's text with their points, subsections and key terms."""
    def block(header: str) -> dict:
        return {"header": header, "bullet_points": [], "key_terms": [], "summary_notes": "", "page_number": page}

    lines = (x.strip() for x in (text or "").split("\n"))
    out: list[dict] = []
    target: dict | None = None
    for kind, value in events(x for x in lines if x):
        if kind == "section" or not out:
            target = block((value[:_HEADER_CHARS] if kind == "section" else "") or f"Page {page}") | {"subsections": []}
            out.append(target)
        if kind == "sub":
            target = block(value[:_HEADER_CHARS])
            out[-1]["subsections"].append(target)
        elif kind == "point":
            target["bullet_points"].append(value[2:].strip() if value[0] in "-*•" else value)
    for s in out:
        for b in (s, *s["subsections"]):
            b["key_terms"] = key_terms(" ".join([b["header"], *b["bullet_points"]]))
    return out


def in_pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """sections of (texts, pages) in pieces of PIECE characters: what is made of a batch takes many times the texts' memory."""
    for texts, pages in batches:
        out, size = [], 0
        for t, p in zip(texts, pages, strict=True):
            out.append(sections(t, int(p)))
            size += len(t or "") + 64
            if size >= PIECE:
                yield pd.Series(out)
                out, size = [], 0
        if out:
            yield pd.Series(out)


def sections_of(text: Column, page: Column) -> Column:
    """sections as a column, by Arrow batches."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from in_pieces(batches)

    return F.pandas_udf(run, f"array<{SECTION}>")(text, page)


def structured(pages: DataFrame) -> DataFrame:
    """(doc, page_number, text) with sections and the parser's confidence; pages without text give none."""
    found = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return found.withColumn("sections", sections_of(F.col("text"), F.col("page_number"))).withColumn("confidence", F.when(F.size("sections") > 0, CONFIDENCE).otherwise(0.0))


def combined(results: DataFrame) -> DataFrame:
    """Page batches of (doc, batch, sections, warnings, confidence, mode) as one result for each document."""
    rows = F.array_sort(F.collect_list(F.struct("batch", "sections", "warnings")))
    return results.groupBy("doc").agg(F.min("confidence").alias("confidence"), F.min_by("mode", "batch").alias("mode"), rows.alias("r")).select("doc", "confidence", "mode", F.flatten("r.sections").alias("sections"), F.flatten("r.warnings").alias("warnings"))


def checked(results: DataFrame) -> DataFrame:
    """(doc, pages, sections, confidence) with the errors and warnings that its rules raise, in their order."""
    s = F.col("sections")

    def blank(c):
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    def empty(x, sub: bool):
        own = (F.size(x["bullet_points"]) == 0) & blank(x["summary_notes"])
        return own if sub else own & (F.size(x["subsections"]) == 0)

    subs = F.flatten(F.transform(s, lambda x: x["subsections"]))
    missing = F.array_sort(F.array_except("pages", F.transform(s, lambda x: x["page_number"])))
    errors = F.array(
        F.when(F.size(s) == 0, "no sections"),
        F.when(~F.col("confidence").between(0, 1), "confidence out of range"),
        F.when(F.exists(s, lambda x: blank(x["header"])), "blank section header"),
        F.when(F.exists(subs, lambda x: blank(x["header"])), "blank subsection header"),
    )
    warnings = F.array(
        F.when(F.col("confidence") < 0.55, "low confidence"),
        F.when(F.size(missing) > 0, F.concat(F.lit("pages without a section: "), F.array_join(F.transform(missing, lambda p: p.cast("string")), ", "))),
        F.when(F.exists(s, lambda x: empty(x, False)), "empty section"),
        F.when(F.exists(subs, lambda x: empty(x, True)), "empty subsection"),
    )
    return results.withColumns({"errors": F.array_compact(errors), "warnings": F.array_compact(warnings)})
