"""Language identification by compression.

Each language has a zstandard raw-content dictionary of training text.  A
text is cut into blocks, each block is compressed against every dictionary,
and the language with the smallest total is chosen: a dictionary helps most
where its phrases recur.  Blocks keep the dictionary's share of the window
alike over a long text, so whole texts count.  Where the best two totals
differ by less than `least_margin`, the answer is marked as rejected.  Texts are compared by their letters alone,
lower-cased.

Training reads a bounded sample of labelled rows: at most `pieces` pieces of
`piece_bytes` bytes for each language, chosen by a hash of the id, so a
dictionary has at most pieces * piece_bytes bytes however large the corpus.
Prediction is a map over rows: no shuffle, no hot key.

A null text, or one without a letter, is `und` with score 0.  Ties go to the
language with more training rows, with score 0, and are rejected.  With
no labelled training row every answer is `und`.  In the query a row without an
id has no remainder: it is not held out.  Repeated rows get equal
answers; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SIGNS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """The text lower-cased, with single spaces for runs of ASCII other than letters; empty without a letter."""
    if not _LETTER.search(text):
        return b""
    return b" ".join(text.lower().encode().translate(_SIGNS).split())


def dictionaries(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: int = 192, piece_bytes: int = 512) -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows, that with most rows first.

    Rows are thinned by a hash of the id to some four times the pieces wanted
    before anything is collected, so the driver gets a bounded number.
    """
    rows = train.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not count:
        return {}
    share = F.lit(1.0)
    for lang, n in sorted(count.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 4 * pieces / n))).otherwise(share)
    order = F.pmod(F.xxhash64("id", F.lit("piece")), F.lit(1 << 30))
    found = rows.withColumn("order", order).where(F.col("order") < share * (1 << 30)).select("lang", "order", "id", F.substring("text", 1, piece_bytes).alias("piece")).collect()
    out = {}
    for lang in sorted(count, key=lambda x: (-count[x], x)):
        own = dict.fromkeys(r["piece"] for r in sorted((r for r in found if r["lang"] == lang), key=lambda r: (r["order"], r["id"] is None, r["id"], r["piece"])))
        out[lang] = b" ".join(folded(p)[:piece_bytes] for p in list(own)[:pieces])
    return out


def sizes(data: bytes, packers: list[zstandard.ZstdCompressor], block: int) -> list[int]:
    """The bytes that each compressor makes of the blocks of the data."""
    parts = [data[i : i + block] for i in range(0, len(data), block)]
    return [sum(len(p.compress(x)) for x in parts) for p in packers]


def packers_of(dicts: dict[str, bytes], level: int, block: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in dicts.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(level, source_size=block, dict_size=len(content), write_content_size=0, write_dict_id=0)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    return out


def classify(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", block: int = 2048, level: int = 6, least_margin: float = 0.01) -> DataFrame:
    """(id, lang_pred, score, rejected) for each row.

    score is the margin between the best two totals as a share of the second,
    ten times over and at most 1; with one language it is 1.
    """
    given = docs.sparkSession.sparkContext.broadcast(dicts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, packers = list(given.value), packers_of(given.value, level, block)
        for batch in textkit.sliced(batches, "text", 8 << 20):
            pred, score, rejected = [], [], []
            for text in batch.column(1).to_pylist():
                data = folded(text or "")
                if not names or not data:
                    answer = (UNKNOWN, 0.0, True)
                else:
                    total = sizes(data, packers, block)
                    best = min(range(len(names)), key=total.__getitem__)
                    rest = min((t for i, t in enumerate(total) if i != best), default=None)
                    margin = 1.0 if rest is None else (rest - total[best]) / rest
                    answer = (names[best], min(1.0, 10 * margin), margin < least_margin)
                pred.append(answer[0])
                score.append(answer[1])
                rejected.append(answer[2])
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    def held(key: str) -> Column:
        return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))

    found = classify(docs, dictionaries(docs.where(~held("doc_id"))))
    return found.select(F.col("id").alias("doc_id"), held("id").alias("held_out"), "lang_pred", "score", "rejected")
