"""Sections and raw text into chunks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.quotes import with_evidence

RAW_CHARS = 1800


def _joined(*arrays: Column) -> Column:
    return F.filter(F.transform(F.concat(*arrays), T.trimmed), lambda x: x != "")


def packed(lines: Column, most: int = RAW_CHARS) -> Column:
    """Lines in order as an array of arrays: a new one starts where the next line would pass `most` characters.

    Separators do not count and a single line may be longer.  One fold over
    the row's own lines; rows are independent.
    """
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("size"))

    def add(acc: Column, line: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (acc["size"] + F.length(line) > most)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(line)).otherwise(F.concat(acc["now"], F.array(line))).alias("now"),
            F.when(full, F.length(line)).otherwise(acc["size"] + F.length(line)).alias("size"),
        )

    return F.aggregate(lines, zero, add, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))


def raw_chunks(sources: DataFrame, most: int = RAW_CHARS) -> DataFrame:
    """(sourceId, sourceName, text) as raw chunks, numbered from 1.

    A raw chunk's paragraphs are its evidence as well, so chars, the length of its whole chunk text, counts them twice.
    """
    lines = F.filter(F.transform(F.split("text", r"\n"), T.trimmed), lambda x: x != "")
    cut = sources.select("sourceId", "sourceName", F.posexplode(packed(lines, most)).alias("i", "evidence"))
    number = F.col("i") + 1
    heading = F.concat(F.lit("Original lecture text · part "), number)
    return cut.select(
        "sourceId",
        "sourceName",
        F.concat("sourceId", F.lit("-raw-"), number).alias("sectionId"),
        heading.alias("heading"),
        F.array_join("evidence", "\n").alias("text"),
        F.size("evidence").alias("n_lines"),
        F.col("evidence").alias("paragraphs"),
        "evidence",
        F.length(chunk_text(heading, F.col("evidence"), F.col("evidence"))).alias("chars"),
    )


def raw_spans(sources: DataFrame, most: int = RAW_CHARS) -> DataFrame:
    """(sourceId, sectionId, place, first, last) of raw chunks in the collapsed text of (sourceId, text)."""
    lines = F.filter(F.transform(F.split("text", r"\n"), T.trimmed), lambda x: x != "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def add(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(T.collapsed(F.array_join(part, " ")))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("first"), end.alias("last")))).alias("spans"))

    spans = F.aggregate(packed(lines, most), zero, add, lambda acc: acc["spans"])
    out = sources.select("sourceId", F.posexplode(spans).alias("place", "s"))
    return out.select("sourceId", F.concat("sourceId", F.lit("-raw-"), (F.col("place") + 1).cast("string")).alias("sectionId"), "place", "s.first", "s.last")


def compact(paragraphs: Column, bullets: Column, evidence: Column) -> Column:
    """Distinct non-blank contents in order of first appearance."""
    return F.array_distinct(_joined(paragraphs, bullets, evidence))


def chunk_text(heading: Column, *arrays: Column) -> Column:
    """All parts that are not blank, a line each, as they stand."""
    return F.array_join(F.filter(F.concat(F.array(F.coalesce(heading, F.lit(""))), *arrays), lambda x: T.trimmed(x) != ""), "\n")


def usable(chunks: DataFrame, least: int = 45) -> DataFrame:
    """Chunks whose whole text, see chunk_text, has at least so many characters (column chars)."""
    return chunks.where(F.col("chars") >= least)


def flattened(header: Column, bullets: Column, indent: str = "") -> Column:
    """A section as text: its header and a dashed line for each bullet."""
    return F.array_join(F.concat(F.array(F.concat(F.lit(indent), header)), F.transform(bullets, lambda b: F.concat(F.lit(f"{indent}- "), b))), "\n")


def levels(sections: Column) -> Column:
    """How many levels of sections a JSON text can hold at most: half of how deep its brackets go.

    Escapes go first, then strings, then all but brackets; what is left is folded.
    """
    brackets = F.regexp_replace(F.regexp_replace(F.regexp_replace(sections, r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]+", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, sign: Column) -> Column:
        now = acc["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.ceil(F.aggregate(F.split(brackets, ""), zero, step, lambda acc: acc["most"]) / 2).cast("int")


def _string(node: Column, *names: str) -> Column:
    """The first field that is there and not empty, as text without white space at its ends; else empty."""
    found = [F.nullif(F.try_variant_get(node, f"$.{n}", "string"), F.lit("")) for n in names]
    return T.trimmed(F.coalesce(*found, F.lit("")))


def _strings(node: Column, *names: str) -> Column:
    """The first field that is a list, its items as text without blanks; else an empty list."""
    found = [F.try_variant_get(node, f"$.{n}", "array<variant>") for n in names]
    items = F.transform(F.coalesce(*found, F.array().cast("array<variant>")), lambda v: T.trimmed(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))
    return F.filter(items, lambda x: x != "")


_NODE = "array<struct<path:array<int>,parent:string,node:variant>>"
_CHUNK = "struct<sectionId:string,pageNumber:int,heading:string,paragraphs:array<string>,bulletPoints:array<string>,keyTerms:array<string>,evidence:array<string>>"


def _children(nodes: Column, path: Column, parent: Column) -> Column:
    """A list of sections as nodes below a path, numbered from 1."""
    listed = F.coalesce(nodes, F.array().cast("array<variant>"))
    return F.transform(listed, lambda n, i: F.struct(F.concat(path, F.array((i + 1).cast("int"))).alias("path"), parent.alias("parent"), n.alias("node")))


def _section_id(source: Column, f: Column) -> Column:
    """A section's own id, else one made of its source, its parent and its number below that."""
    own = F.nullif(F.try_variant_get(f["node"], "$.sectionId", "string"), F.lit(""))
    return F.coalesce(own, F.concat_ws("-", source, f["parent"], F.element_at(f["path"], -1).cast("string")))


def sections_walked(sources: DataFrame, known_levels: int | None = None) -> DataFrame:
    """(sourceId, sections JSON, ...) with `walked`: the sections of every level as one array, parents before children.

    The tree stays in its row.  One expression for each level takes the nodes
    of the level above and lists theirs, so there is no shuffle and no join
    back to the text; how many levels the table needs is one aggregate over
    its sections (a driver action, as the plan depends on it, which makes the
    sections once more); known_levels says it where whoever makes the sections
    knows that none is deeper.  A malformed
    text, or one that is no list, has no sections; list members that are no
    objects come out without any field and count in the numbering.
    """
    depth = known_levels or sources.agg(F.max(levels(F.col("sections"))).alias("n")).first()["n"] or 0
    top = F.try_variant_get(F.try_parse_json("sections"), "$", "array<variant>")
    out = sources.withColumn("_0", _children(top, F.array().cast("array<int>"), F.lit("section")).cast(_NODE))
    for k in range(1, depth):
        below = F.transform(f"_{k - 1}", lambda f: _children(F.try_variant_get(f["node"], "$.subsections", "array<variant>"), f["path"], _section_id(F.col("sourceId"), f)))
        out = out.withColumn(f"_{k}", F.flatten(below).cast(_NODE))

    def section(f: Column) -> Column:
        n = f["node"]
        page = F.coalesce(F.try_variant_get(n, "$.page_number", "int"), F.try_variant_get(n, "$.pageNumber", "int"))
        return F.struct(
            f["path"].alias("path"),
            _section_id(F.col("sourceId"), f).alias("sectionId"),
            page.alias("pageNumber"),
            _string(n, "header", "heading").alias("heading"),
            _strings(n, "paragraphs").alias("paragraphs"),
            _strings(n, "bullet_points", "bulletPoints").alias("bulletPoints"),
            _strings(n, "key_terms", "keyTerms").alias("keyTerms"),
            _string(n, "summary_notes", "summaryNotes").alias("summary"),
        )

    names = [f"_{k}" for k in range(max(1, depth))]
    return out.withColumn("walked", F.array_sort(F.concat(*(F.transform(c, section) for c in names)))).drop(*names)


def structured_chunks(sources: DataFrame, known_levels: int | None = None) -> DataFrame:
    """(sourceId, rawText, sections) with `chunks`, an array of what can be asked about.

    Evidence are the paragraphs, bullets and the summary that the raw text
    has, else the heading; a section without evidence gives no chunk.
    """
    walked = sections_walked(sources, known_levels).drop("sections")
    points = F.transform("walked", lambda s: F.concat(s["paragraphs"], s["bulletPoints"], F.filter(F.array(s["summary"]), lambda x: x != "")))
    found = with_evidence(walked.withColumns({"points": points, "heads": F.transform("walked", lambda s: s["heading"])}), "rawText", "points", "heads", "found")

    def chunk(s: Column, evidence: Column) -> Column:
        heading = F.coalesce(F.nullif(s["heading"], F.lit("")), F.lit("Study material"))
        fields = [s["sectionId"], s["pageNumber"], heading, s["paragraphs"], s["bulletPoints"], s["keyTerms"], evidence]
        return F.struct(*fields).cast(_CHUNK)

    return found.withColumn("chunks", F.filter(F.zip_with("walked", "found", chunk), lambda c: F.size(c["evidence"]) > 0)).drop("walked", "points", "heads", "found")


def source_chunks(sources: DataFrame, most: int = RAW_CHARS, least: float = 0.75, known_levels: int | None = None) -> DataFrame:
    """All chunks of (id, name, text, sections): structured ones at any depth, then raw ones where those hold too little.

    sections is a JSON text of nested sections under either spelling of their
    fields.  Sources without text give no chunks.  Where the distinct
    paragraphs, bullets and evidence of the structured chunks come to less
    than `least` of the text's length, raw chunks follow.  ordinal numbers a
    source's chunks from 0, and chars is the length of the whole chunk text,
    as `usable` and `coverage_plan` take it.  Everything about a source
    happens in its row.  For known_levels see sections_walked.
    """
    given = sources.select(
        F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.lit("source")).alias("sourceId"),
        F.coalesce(F.nullif("name", F.lit("")), F.lit("Study material")).alias("sourceName"),
        T.trimmed(F.coalesce("text", F.lit(""))).alias("rawText"),
        "sections",
    ).where("rawText <> ''")

    def size(c: Column) -> Column:
        return F.length(F.array_join(F.array_distinct(F.concat(c["paragraphs"], c["bulletPoints"], c["evidence"])), "\n"))

    have = F.aggregate("chunks", F.lit(0), lambda acc, c: acc + size(c))
    lines = F.filter(F.transform(F.split("rawText", r"\n"), T.trimmed), lambda x: x != "")
    none = F.array().cast("array<string>")

    def raw(part: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        fields = [F.concat("sourceId", F.lit("-raw-"), number), F.lit(None).cast("int"), F.concat(F.lit("Original lecture text · part "), number), part, none, none, part]
        return F.struct(*fields).cast(_CHUNK)

    made = structured_chunks(given, known_levels)
    made = made.withColumn("packed", F.when(have < least * F.length("rawText"), packed(lines, most)).otherwise(F.array().cast("array<array<string>>")))
    every = made.select("sourceId", "sourceName", F.posexplode(F.concat("chunks", F.transform("packed", raw))).alias("ordinal", "c")).select("sourceId", "sourceName", "ordinal", "c.*")
    return every.withColumn("chars", F.length(chunk_text(F.col("heading"), F.col("paragraphs"), F.col("bulletPoints"), F.col("keyTerms"), F.col("evidence"))))


def lacking(structured: DataFrame, sources: DataFrame, least: float = 0.75) -> DataFrame:
    """Sources whose structured chunks (sourceId, parts) hold less than `least` of the raw text's length.

    parts are a chunk's paragraphs, bullets and evidence; equal ones count once.
    """
    have = structured.groupBy("sourceId").agg(F.sum(F.length(F.array_join(F.array_distinct("parts"), "\n"))).alias("have"))
    return sources.join(have, "sourceId", "left").where(F.coalesce("have", F.lit(0)) < least * F.length("text")).drop("have")
