"""Study documents from files: a row for each page, and one for each picture on it.

binaryFile lists and reads whatever store Spark reaches; the suffix decides
the reader.  Plain text and images stay column expressions; Office formats go
through the table function of `office`.  PDF needs a renderer that is not part
of this package: its files give a page whose `warning` says so, unless
`pdf_pages` is passed in, which gives each page's text and picture.

A file beyond `most_bytes` gives one page with a warning, as a broken one
does.  An empty text file is a page with empty text; a folder without
supported files gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import office

#: Mime types by suffix.
MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".txt": "text/plain", ".md": "text/markdown"}
MEMBER = ["path", "page_number", "kind", "label", "mime_type", "text_hint", "content", "n_images", "warning"]
PdfReader = Callable[[bytes], list[tuple[str, bytes | None]]]


def supported(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("suffix", T.suffix(F.col(path))).where(F.col("suffix").isin(*T.SUFFIXES))


def _pdf(files: DataFrame, pdf_pages: PdfReader) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                try:
                    out = [(r.path, i, "page", None, "image/png" if png else "text/plain", text, png, int(png is not None), None) for i, (text, png) in enumerate(pdf_pages(bytes(r.content)), 1)]
                except Exception as e:  # a broken file must not fail the others
                    out = [(r.path, 1, "page", None, "text/plain", None, None, 0, f"unreadable: {type(e).__name__}")]
                yield pd.DataFrame(out, columns=MEMBER)

    return files.select("path", "content").mapInPandas(run, f"path string, {office.MEMBER}")


def members(files: DataFrame, most_bytes: int = 32 << 20, pdf_pages: PdfReader | None = None) -> DataFrame:
    """(path, page_number, kind, label, mime_type, text_hint, content, n_images, warning) of files (path, content, length).

    kind is page or picture; content is a picture's bytes, or a page's where the page is an image.
    """
    own = supported(files)
    fits, image = F.col("length") <= most_bytes, F.col("suffix").isin(".png", ".jpg", ".jpeg", ".webp")
    parsed = F.col("suffix").isin(*office.READERS, *([".pdf"] if pdf_pages else []))
    mime = F.coalesce(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[F.col("suffix")], F.lit("text/plain"))
    warning = F.when(~fits, "file is too large").when(F.col("suffix") == ".pdf", "no reader for this format")
    reads = F.col("suffix").isin(*office.READERS) & fits
    # one pass over the files, however dear they are to make or list: those without a reader take a row of the table function too, with nothing to read
    plain = {
        "mime_type": mime, "text_hint": F.when(fits & F.col("suffix").isin(".txt", ".md"), F.col("content").cast("string")),
        "content": F.when(fits & image, F.col("content")), "n_images": image.cast("int"), "warning": warning,
    }
    given = own.where(~(parsed & fits) | reads).select(
        "path", reads.alias("_reads"), F.when(reads, F.col("suffix")).alias("suffix"), F.when(reads, F.col("content")).alias("content"),
        *[F.when(~reads, c).alias(f"_{name}") for name, c in plain.items()],
    )
    found = office.members(given)
    out = found.select(*[F.when(F.col("_reads"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in plain else F.col(c) for c in MEMBER])
    return out.unionByName(_pdf(own.where(fits & (F.col("suffix") == ".pdf")), pdf_pages)) if pdf_pages else out


def read_members(spark: SparkSession, path: str, most_bytes: int = 32 << 20, pdf_pages: PdfReader | None = None) -> DataFrame:
    """The members of all supported files below a path."""
    return members(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), most_bytes, pdf_pages)


def read_pages(spark: SparkSession, path: str, most_bytes: int = 32 << 20, pdf_pages: PdfReader | None = None) -> DataFrame:
    """The pages of all supported files below a path, those that are images in base64."""
    pages = read_members(spark, path, most_bytes, pdf_pages).where("kind = 'page'")
    return pages.select("path", "page_number", "mime_type", "text_hint", office.encoded(F.col("content")).alias("image_base64"), "n_images", "warning")


def pictures(found: DataFrame) -> DataFrame:
    """(path, page_number, label, mime_type, image_base64) for each picture inside a page of members()."""
    return found.where("kind = 'picture'").select("path", "page_number", "label", "mime_type", office.encoded(F.col("content")).alias("image_base64"))


def page_sizes(found: DataFrame) -> DataFrame:
    """(doc, page_number, n_bytes): the payload of each page of members(), its pictures included, as `operators.pages` takes it."""
    return found.groupBy(F.col("path").alias("doc"), "page_number").agg(F.sum(office.payload_bytes(F.col("content"))).alias("n_bytes"))
