"""Filter interaction audit over a packed bitmap index.

What a filter removes depends on the filters before it.  Every partition of
documents keeps one NumPy bitset for each filter's failures, for the labels
and for the documents that are there; rows are laid out part by part, each
part from a word border on, so a part's bitset is a range of words.  For each
of the 32 prefix subsets the survivors are the documents AND NOT the subset's
failures, and popcounts of survivors with a filter's failures say what it
removes after that subset, in whatever order the subset ran.  Partitions send
80 sums for each part they hold; Spark adds these, and the 120 orders are
read off them.

Filters (failure conditions), over whole texts with case-sensitive words
[^\\x20\\x09-\\x0D]+:  A under 200 words;  B distinct words under half of the
words;  C more than 2 % of the code points in [A-Z];  D any of [#$%&*|];
E the text equals that of a row with a smaller id, whether or not that row is
removed.  Distinct words and equal texts are told by 64-bit hashes within a
text and 128-bit digests over the table.

Copies: a digest's least id comes from a min-aggregation.  Digests that hold
over a thousandth of all rows, of which there are at most a thousand, are
looked up by broadcast; all others by a shuffle in which no key is hot.
Labels join by id.  Memory of a task: an Arrow batch and the sums of at most
`most_parts` parts; what goes beyond is sent on and added by Spark.

A null text is empty and a null part is the empty string.  An empty text
fails A alone (and E beside a smaller id's).  A row without an id is never
a copy of a smaller one, makes no other row a copy, and has no labels.
Rows that repeat an id count each; they are no copies of each other.  An id
with several label rows has a label that any of them gives.  An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .shared import written

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#$%&*|")] = True
#: Every (prefix subset as bits, filter outside it).
PAIRS = [(s, f) for s in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not s >> f & 1]
_SUMS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def fails(column: pa.Array) -> np.ndarray:
    """For each text the bits of the filters A to D that it fails."""
    with np.errstate(over="ignore"):
        w = textkit.words(column)
        _, borders = textkit.raw(column)
        n = np.diff(w.first)
        text = w.text_of_word()
        _, first = np.unique(textkit.mix(w.hash) + textkit.mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)
        distinct = np.bincount(text[first], minlength=len(n))
        points = textkit.per_text((w.buf & 0xC0) != 0x80, borders)
        upper = textkit.per_text((w.buf >= 65) & (w.buf <= 90), borders)
        bad = [n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * upper > UPPER_PERCENT * points, textkit.per_text(_SIGN[w.buf], borders) > 0]
    return sum(b.astype(np.int32) << i for i, b in enumerate(bad))


def flagged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, bits, digest): the filters A to D that each row fails, and what tells its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, "text"):
            buf, borders = textkit.raw(batch.column(2))
            view = memoryview(np.ascontiguousarray(buf))
            digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fails(batch.column(2)), pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "bits", "digest"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, part string, bits int, digest binary")


def copies(rows: DataFrame) -> DataFrame:
    """The rows without their digests, with bit E set where a smaller id has the text."""
    groups = written(rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL"), "audit-groups")
    hot = groups.where(F.col("n") > rows.count() // 1000).select("digest", "least")
    cold = groups.join(F.broadcast(hot), "digest", "left_anti").select("digest", "least")
    met = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest", "left"))
    again = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return met.select("id", "part", F.col("bits").bitwiseOR(F.when(again, 1 << FILTERS.index("E")).otherwise(0)).alias("bits"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The rows with good and toxic; rows without an id do not meet in the join's shuffle."""
    known = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(to) for c, to in [("quality", "good"), ("toxic", "toxic")])).where("good OR toxic")
    met = rows.where("id IS NOT NULL").join(known, "id", "left")
    lone = rows.where("id IS NULL").withColumns({"good": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean")})
    return met.unionByName(lone).select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


class Index:
    """The bitsets of one batch, with the words of each part in a row."""

    def __init__(self, parts: np.ndarray, flags: list[np.ndarray]):
        """parts: each row's part as a code from 0; flags: one boolean array for each bitset."""
        size = np.bincount(parts)
        width = -(-size // 64)
        self.first = np.concatenate([[0], np.cumsum(width)[:-1]])
        order = np.argsort(parts, kind="stable")
        rank = np.arange(len(parts)) - np.repeat(np.cumsum(size) - size, size)
        self.place = self.first[parts[order]] * 64 + rank
        self.order, self.bits = order, int(width.sum()) * 64
        self.present = self.packed(np.ones(len(parts), bool))
        self.sets = [self.packed(f) for f in flags]

    def packed(self, flag: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.bits, bool)
        bits[self.place] = flag[self.order]
        return np.packbits(bits).view(np.uint64)

    def count(self, words: np.ndarray) -> np.ndarray:
        """Set bits of each part."""
        return np.add.reduceat(np.bitwise_count(words).astype(np.int64), self.first)


def counted(index: Index) -> np.ndarray:
    """For each part and each of PAIRS the sums of _SUMS; the index holds the five filters, good and toxic."""
    *failing, good, toxic = index.sets
    alive = [index.present]
    for s in range(1, 1 << len(FILTERS)):
        low = (s & -s).bit_length() - 1
        alive.append(alive[s & (s - 1)] & ~failing[low])
    left = [index.count(a) for a in alive]
    total = [index.count(f) for f in failing]
    whole = len(alive) - 1
    alone = [index.count(alive[whole & ~(1 << f)] & failing[f]) for f in range(len(FILTERS))]
    out = np.zeros((len(index.first), len(PAIRS), len(_SUMS)), np.int64)
    for i, (s, f) in enumerate(PAIRS):
        lost = alive[s] & failing[f]
        gone = index.count(lost)
        out[:, i] = np.stack([left[s | 1 << f], gone, total[f] - gone, alone[f], index.count(lost & good), index.count(lost & toxic)], axis=1)
    return out


def prefix_sums(rows: DataFrame, most_parts: int = 512) -> DataFrame:
    """(part, prefix, filter, sums): one row for each part and each of PAIRS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            sums = np.concatenate(list(held.values())) if held else np.zeros((0, len(_SUMS)), np.int64)
            n = len(held)
            names = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(n), len(PAIRS))))
            held.clear()
            pairs = np.array(PAIRS, np.int32)
            return pa.record_batch([names, pa.array(np.tile(pairs[:, 0], n)), pa.array(np.tile(pairs[:, 1], n)), *(pa.array(sums[:, i]) for i in range(len(_SUMS)))], names=["part", "prefix", "filter", *_SUMS])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            bits = batch.column(1).to_numpy()
            flags = [bits >> f & 1 == 1 for f in range(len(FILTERS))] + [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
            found = counted(Index(coded.indices.to_numpy(), flags))
            for name, sums in zip(coded.dictionary.to_pylist(), found):
                if name in held:
                    held[name] += sums
                else:
                    held[name] = sums.copy()
                    if len(held) >= most_parts:
                        yield sent()
        yield sent()

    found = rows.select("part", "bits", "good", "toxic").mapInArrow(run, "part string, prefix int, filter int, " + ", ".join(f"{c} long" for c in _SUMS))
    return found.groupBy("part", "prefix", "filter").agg(*(F.sum(c).alias(c) for c in _SUMS))


def orders(spark: SparkSession) -> DataFrame:
    """The steps of all orders: filter_order, step, the filters before it as bits, its filter."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            rows.append(("".join(FILTERS[x] for x in order), i + 1, sum(1 << x for x in order[:i]), f))
    return spark.createDataFrame(rows, "filter_order string, step int, prefix int, filter int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step; shapley is over all orders."""
    rows = written(flagged(docs, id_col, text_col, part_col), "audit-rows")
    sums = prefix_sums(labelled(copies(rows), labels, id_col))
    n = len(FILTERS)
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("prefix") + 1)
    sums = sums.withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter")))
    return sums.join(F.broadcast(orders(docs.sparkSession)), ["prefix", "filter"]).select("part", "filter_order", "step", *_SUMS, "shapley")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, CASE WHEN step = 1 THEN '0' ELSE filter_order[1:step - 1] END AS earlier FROM o, range(1, 6) t(step)),
g AS (SELECT part, filter_order, step, f, good, toxic, n, contains(fails, f) AS bad, regexp_matches(fails, '[' || earlier || ']') AS gone, fails = f AS only_this FROM m, s),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_this), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (bad AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (bad AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
      FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
