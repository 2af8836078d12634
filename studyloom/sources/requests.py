"""What a request carries itself: an uploaded file and a list of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The names a source without one gets.
NO_ID, NO_NAME = "source", "Study material"
_SOURCE = "struct<id:string,name:string,text:string,structuredSections:string,structured_sections:string>"


def uploads(bodies: DataFrame) -> DataFrame:
    """bodies (filename, content_base64) with status and content.

    400 where there is no content, 415 where the suffix is none that can be read, 422 where the content is no base64;
    else 200, and content has the bytes.  It is null in all other cases.
    """
    encoded, name = F.col("content_base64"), F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.lit("document.bin"))
    valid = (F.length(encoded) % 4 == 0) & encoded.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")
    status = F.when(F.coalesce(encoded, F.lit("")) == "", 400).when(~T.suffix(name).isin(*T.SUFFIXES), 415).when(~valid, 422).otherwise(200)
    return bodies.withColumn("status", status).withColumn("content", F.when(F.col("status") == 200, F.unbase64(encoded)))


def sources_of(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The sources of a JSON body, a row each: ordinal, sourceId, sourceName, rawText and sections as JSON.

    Sections go by two names.  Blank texts are left out; a body that is no JSON or has no sources gives no row.
    """
    listed = F.from_json(F.col(body), f"sources array<{_SOURCE}>")["sources"]
    rows = bodies.select("*", F.posexplode(listed).alias("ordinal", "_source"))

    def given(field: str, default: str):
        return F.coalesce(F.nullif(F.col(f"_source.{field}"), F.lit("")), F.lit(default))

    out = rows.withColumns(
        {
            "sourceId": given("id", NO_ID),
            "sourceName": given("name", NO_NAME),
            "rawText": T.blank_to_null(F.col("_source.text")),
            "sections": F.coalesce("_source.structuredSections", "_source.structured_sections", F.lit("[]")),
        }
    )
    return out.where("rawText IS NOT NULL").drop("_source")
