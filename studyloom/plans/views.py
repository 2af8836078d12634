"""The study tables as views over the tables of the test data, in Spark and in SQL alike."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import table


def modules(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id") * 7919, F.lit(1000003)))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.concat_ws("", "source", F.lit("-"), "doc_id", F.lit(".txt")).alias("original_filename"), F.col("text").alias("source_text"), "lang", stamp.cast("timestamp_ntz").alias("updated_at"))


MODULES = "(SELECT doc_id::VARCHAR AS id, source AS name, source || '-' || doc_id || '.txt' AS original_filename, text AS source_text, lang, make_timestamp((1704067200 + (doc_id * 7919) % 1000003) * 1000000) AS updated_at FROM documents)"


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations as questions of modules, every 20 conversations one module."""
    c = table(spark, folder, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.floor(F.col("conv_id") / 20).cast("string").alias("module_id"),
        F.col("text").alias("stem"),
        T.stem_key(F.col("text")).alias("normalized_stem"),
        F.pmod(F.col("turn") + F.col("conv_id"), F.lit(4)).cast("int").alias("correct_index"),
        "conv_id",
        "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
    )


FOLD = "lower(" + "".join("replace(" for _ in T.FOLDS) + "{0}" + "".join(f", '{a}', '{b}')" for a, b in T.FOLDS) + ")"


def stem_key_sql(c: str) -> str:
    return f"trim(regexp_replace({FOLD.format(c)}, '[^a-z0-9]+', ' ', 'g'))"


QUESTIONS = f"(SELECT conv_id || '-' || turn AS id, (conv_id // 20)::VARCHAR AS module_id, text AS stem, {stem_key_sql('text')} AS normalized_stem, ((turn + conv_id) % 4)::INTEGER AS correct_index, conv_id, turn, conv_id * 1000 + turn AS ordinal FROM conversations)"


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as practice attempts: 1 to 5 answers, some of them correct."""
    e = table(spark, folder, "events")
    n = F.pmod(F.col("event_id"), F.lit(5)) + 1
    return e.select(F.col("event_id").alias("attempt"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.pmod(F.col("user_id"), F.lit(40)).cast("string").alias("module_id"), n.alias("answers"), F.pmod(F.col("event_id") * 7, n + 1).alias("correct"), "event_type", "props")


ATTEMPTS = "(SELECT event_id AS attempt, ts::TIMESTAMP AS ts, (user_id % 40)::VARCHAR AS module_id, event_id % 5 + 1 AS answers, (event_id * 7) % (event_id % 5 + 2) AS correct, event_type, props FROM events)"


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Events as provider calls: batches by user, times from the event's number and value."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("request_number"),
        F.pmod("user_id", F.lit(50)).alias("batch_index"),
        F.pmod(i, F.lit(3)).cast("int").alias("generation_attempt"),
        (F.pmod(i, F.lit(2)) + 1).cast("int").alias("schema_attempt"),
        (F.pmod(i, F.lit(10)) + 1).cast("int").alias("requested_questions"),
        (F.pmod(i, F.lit(7)) == 0).alias("replacement"),
        (i * 0.5).alias("started_seconds"),
        (i * 0.5 + F.abs("value")).alias("finished_seconds"),
        F.when(F.pmod(i, F.lit(11)) == 0, "incomplete_json").when(F.pmod(i, F.lit(13)) == 0, "schema_validation_error").otherwise("ok").alias("status"),
        F.when(F.pmod("user_id", F.lit(3)) > 0, F.pmod(i, F.lit(500))).alias("input_tokens"),
        F.when(F.pmod("user_id", F.lit(3)) == 1, F.pmod(i, F.lit(90))).alias("output_tokens"),
        F.when(F.pmod("user_id", F.lit(3)) == 1, F.pmod(i, F.lit(500)) + F.pmod(i, F.lit(90))).alias("total_tokens"),
    )


CALLS = """(SELECT event_id AS request_number, user_id % 50 AS batch_index, (event_id % 3)::INTEGER AS generation_attempt, (event_id % 2 + 1)::INTEGER AS schema_attempt,
(event_id % 10 + 1)::INTEGER AS requested_questions, event_id % 7 = 0 AS replacement, event_id * 0.5::DOUBLE AS started_seconds, event_id * 0.5::DOUBLE + abs(value) AS finished_seconds,
CASE WHEN event_id % 11 = 0 THEN 'incomplete_json' WHEN event_id % 13 = 0 THEN 'schema_validation_error' ELSE 'ok' END AS status,
CASE WHEN user_id % 3 > 0 THEN event_id % 500 END AS input_tokens, CASE WHEN user_id % 3 = 1 THEN event_id % 90 END AS output_tokens, CASE WHEN user_id % 3 = 1 THEN event_id % 500 + event_id % 90 END AS total_tokens FROM events)"""


def raw_sources(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").cast("string").alias("sourceId"), F.col("source").alias("sourceName"), "text", "lang")


def lines(c) -> object:
    """A text's lines, trimmed, without blanks."""
    return F.filter(F.transform(F.split(c, "\n"), T.trimmed), lambda x: x != "")


def lines_sql(c: str) -> str:
    return rf"list_filter(list_transform(string_split({c}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


#: So many files of slides go to Spark at once.
FILES = 64
#: White space and characters that XML cannot hold, as both engines write them.
SPACES = r"[\x{0}-\x{9}\x{b}-\x{20}\x{7f}-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{fffe}\x{ffff}]+"
_NAMES = " ".join(f'xmlns:{k}="http://schemas.openxmlformats.org/{v}"' for k, v in {"a": "drawingml/2006/main", "p": "presentationml/2006/main", "r": "officeDocument/2006/relationships"}.items())
_PLACE = '<{0}:xfrm><a:off x="0" y="{1}"/><a:ext cx="900" cy="80"/></{0}:xfrm>'
_PICTURE = f'<p:pic><p:blipFill><a:blip r:embed="rId1"/></p:blipFill><p:spPr>{_PLACE.format("a", 700)}</p:spPr></p:pic>'


def _relations(targets: list[str]) -> str:
    own = "".join(f'<Relationship Id="rId{i}" Target="{t}"/>' for i, t in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{own}</Relationships>'


def slides_file(slides: list[list[str]]) -> bytes:
    """A file of slides: parts named against their order, shapes stored from the bottom up, and a picture of a slide's first line."""
    out, n = io.BytesIO(), len(slides)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i}"/>' for i in range(1, n + 1))
        z.writestr("ppt/presentation.xml", f"<p:presentation {_NAMES}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", _relations([f"slides/slide{n - i}.xml" for i in range(n)]))
        for i, lines in enumerate(slides):
            shapes = "".join(f"<p:sp><p:spPr>{_PLACE.format('a', k * 100)}</p:spPr><p:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody></p:sp>" for k, x in reversed(list(enumerate(lines))))
            z.writestr(f"ppt/slides/slide{n - i}.xml", f"<p:sld {_NAMES}><p:cSld><p:spTree>{_PICTURE}{shapes}</p:spTree></p:cSld></p:sld>")
            z.writestr(f"ppt/slides/_rels/slide{n - i}.xml.rels", _relations([f"../media/image{i}.png"]))
            z.writestr(f"ppt/media/image{i}.png", lines[0].encode())
    return out.getvalue()


def slide_files(docs: DataFrame) -> DataFrame:
    """(path, content, length): each text as a file of slides of six lines; texts without a line give none."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), FILES):
                some = frame.iloc[at : at + FILES]
                made = [slides_file([list(said[i : i + 6]) for i in range(0, len(said), 6)]) for said in some["said"]]
                yield pd.DataFrame({"path": some["path"].to_numpy(), "content": made, "length": [len(x) for x in made]})

    return docs.select("path", lines.alias("said")).where(F.size("said") > 0).mapInPandas(run, "path string, content binary, length long")
