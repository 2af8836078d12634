"""Page batches for an extractor: which documents may be sent, and in what batches.

A document is refused for too many pages or for a page that is too large; of
the others, pages go in order into batches that close at a number of pages or
before a number of bytes.  Documents are counted first, by partial
aggregation, so the pages of a document of any length never meet in one row:
only those of allowed documents are gathered, at most `most_pages` of them,
and packed by a fold in their row.

A null document is one of its own.  Null sizes count as no bytes, null page
numbers come first.  Repeated pages stay repeated.  An empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The limits of an upload and the pages of a call.
MOST_PAGES, MOST_PAGE_BYTES, BATCH_PAGES = 20, 8 << 20, 5


def guarded(pages: DataFrame, most_pages: int = MOST_PAGES, most_page_bytes: int = MOST_PAGE_BYTES) -> DataFrame:
    """(doc, n_pages, n_over, refusal): over pages (doc, page_number, n_bytes), refusal null where the document may be sent."""
    size = F.coalesce("n_bytes", F.lit(0))
    sums = pages.groupBy("doc").agg(F.count("*").alias("n_pages"), F.count_if(size > most_page_bytes).alias("n_over"))
    refusal = F.when(F.col("n_pages") > most_pages, "too many pages").when(F.col("n_over") > 0, "page too large")
    return sums.withColumn("refusal", refusal)


def packed(pages: Column, batch_pages: int, batch_bytes: int) -> Column:
    """An array of batches, each an array of page numbers, from an ordered array of (page_number, n_bytes)."""
    numbers = F.array().cast("array<bigint>")
    start = F.struct(F.array().cast("array<array<bigint>>").alias("done"), numbers.alias("open"), F.lit(0).cast("long").alias("held"))

    def step(acc: Column, p: Column) -> Column:
        closes = (F.size(acc["open"]) >= batch_pages) | ((F.size(acc["open"]) > 0) & (acc["held"] + p["n_bytes"] > batch_bytes))
        one = F.array(p["page_number"])
        return F.struct(
            F.when(closes, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(closes, one).otherwise(F.concat(acc["open"], one)).alias("open"),
            (F.when(closes, 0).otherwise(acc["held"]) + p["n_bytes"]).alias("held"),
        )

    return F.aggregate(pages, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def batches(pages: DataFrame, most_pages: int = MOST_PAGES, most_page_bytes: int = MOST_PAGE_BYTES, batch_pages: int = BATCH_PAGES, batch_bytes: int = MOST_PAGE_BYTES) -> DataFrame:
    """(doc, batch, page_numbers) of the documents that may be sent, batches from 0 in page order.

    A batch closes at batch_pages pages, or before the page that would take it over batch_bytes; a page over that
    alone is a batch of its own.
    """
    own = pages.select("doc", F.col("page_number").cast("long").alias("page_number"), F.coalesce(F.col("n_bytes").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    allowed = guarded(own, most_pages, most_page_bytes).where("refusal IS NULL").select(F.col("doc").alias("_doc"))
    kept = own.join(allowed, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
    rows = kept.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page_number", "n_bytes"))).alias("p"))
    return rows.select("doc", F.posexplode(packed(F.col("p"), batch_pages, batch_bytes)).alias("batch", "page_numbers"))
