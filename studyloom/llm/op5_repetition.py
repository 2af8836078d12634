"""Quality rules on repetition, measured with rolling hashes.

For several n-gram lengths the characters of words inside an n-gram that
occurs twice or more in the same text are counted, the first occurrence
included, and so are the characters of lines that equal an earlier line.
Hashes of all windows of a length come from those of the length before with
one multiply-add in numpy; a window can only repeat if its shorter prefix
does, so each length looks only at what the one before left.  Work is by
slices of bounded bytes and never compares documents with each other: no
shuffle, and a hot source or a group of copies is no hot spot.

A null text has no words and fails.  Very long texts are measured whole.
Repeated rows get equal answers.  Extra columns are ignored by `measures` and
kept by `passing`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

#: The most that a kept text may have of its word characters inside repeated n-grams, in per cent by n.  The first
#: occurrence counts too, so one line found twice in a short text is well below.
NGRAM_PERCENT = {5: 30, 6: 28, 7: 26, 8: 24, 9: 22, 10: 20}
#: The most that a kept text may have of its word characters in lines that equal an earlier one, in per cent.
LINE_PERCENT = 20
#: Least words; the most words in repeated 3-word windows, in per cent.
LEAST_WORDS, WINDOW_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_B = np.uint64(0xD1342543DE82EF95)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def coverage(w: textkit.Words, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each n-gram length (ascending), which words lie in a window found twice or more in their text."""
    n_words = len(w.hash)
    text = w.text_of_word()
    last = w.first[1:][text] if n_words else np.zeros(0, np.int64)
    salt = textkit.mix(text.astype(np.uint64) + np.uint64(1))
    rolling, power, size = w.hash.copy(), _B, 1
    starts = np.arange(n_words)
    out = {}
    for n in lengths:
        while size < n:
            rolling[: n_words - size] += w.hash[size:] * power if n_words > size else np.uint64(0)
            power, size = power * _B, size + 1
        starts = starts[starts + n <= last[starts]]
        starts = starts[_repeated(textkit.mix(rolling[starts]) + salt[starts])]
        edge = np.zeros(n_words + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + n, -1)
        out[n] = np.cumsum(edge)[:n_words] > 0
    return out


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of a column."""
    with np.errstate(over="ignore"):
        w = textkit.words(column)
        _, borders = textkit.raw(column)
        inside = ~textkit.IS_SPACE[w.buf]
        point = (w.buf & 0xC0) != 0x80
        chars = np.zeros(len(w.buf) + 1, np.int64)
        np.cumsum(inside & point, out=chars[1:])
        found = {
            "n_words": np.diff(w.first),
            "word_chars": textkit.per_text(inside & point, borders),
            "n_symbols": textkit.per_text(_SYMBOL[w.buf], borders),
        }
        start, end = textkit.runs(w.buf != 10, borders)
        size = chars[end] - chars[start]
        start, end, size = start[size > 0], end[size > 0], size[size > 0]
        owner = np.searchsorted(borders, start, "right") - 1
        line = textkit.segment_hashes(w.buf, start, end) + textkit.mix(owner.astype(np.uint64) + np.uint64(1))
        again = np.ones(len(line), bool)
        again[np.unique(line, return_index=True)[1]] = False
        found["n_dup_lines"] = np.bincount(owner[again], minlength=len(borders) - 1)
        found["dup_line_chars"] = np.bincount(owner[again], size[again], minlength=len(borders) - 1).astype(np.int64)
        width = chars[w.end] - chars[w.start]
        for n, hit in coverage(w, [3, *sorted(NGRAM_PERCENT)]).items():
            if n == 3:
                found["n_repeat_words"] = textkit.per_text(hit, w.first)
            else:
                found[f"dup_{n}gram_chars"] = textkit.per_text(np.where(hit, width, 0), w.first)
    return found


def failing(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text fails the base rules, and whether it fails any."""
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > WINDOW_PERCENT * m["n_words"])
    bad = base | (100 * m["dup_line_chars"] > LINE_PERCENT * m["word_chars"])
    for n, most in NGRAM_PERCENT.items():
        bad = bad | (100 * m[f"dup_{n}gram_chars"] > most * m["word_chars"])
    return base, bad


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_PERCENT)]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, every measure, base_failed and kept for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, "text"):
            found = measure(batch.column(1))
            base, bad = failing(found)
            yield pa.record_batch([batch.column(0), *(pa.array(found[k].astype(np.int64)) for k in _NAMES), pa.array(base), pa.array(~bad)], names=["id", *_NAMES, "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in _NAMES) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is kept, with all their columns; text_col must be a string column."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, text_col):
            yield batch.filter(pa.array(~failing(measure(batch.column(at)))[1]))

    return docs.mapInArrow(run, schema)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    lengths = [3, *NGRAM_PERCENT]
    dup = ", ".join(f"i + {n} - 1 <= n AND count(*) OVER (PARTITION BY doc_id, i + {n} - 1 <= n, list_slice(ws, i, i + {n} - 1)) > 1 AS d{n}" for n in lengths)
    cover = ", ".join(f"bool_or(d{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    sums = ", ".join(f"coalesce(sum(length(w)) FILTER (c{n}), 0)::BIGINT AS dup_{n}gram_chars" for n in NGRAM_PERCENT)
    fails = " OR ".join(f"100 * dup_{n}gram_chars > {p} * word_chars" for n, p in NGRAM_PERCENT.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, ws[i] AS w, {dup} FROM w),
c AS (SELECT doc_id, w, {cover} FROM g),
a AS (SELECT doc_id, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {sums} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
dl AS (SELECT doc_id, sum(k - 1)::BIGINT AS n_dup_lines, sum((k - 1) * length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')))::BIGINT AS dup_line_chars FROM l GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
      {", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in NGRAM_PERCENT)}
      FROM d LEFT JOIN a USING (doc_id) LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {WINDOW_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR 100 * dup_line_chars > {LINE_PERCENT} * word_chars OR {fails}) AS kept FROM b
"""


SQL = _sql()
