"""Fuzzy deduplication of a bank's questions, in order: an item stays unless one that stays before it is too similar.

Too similar is a sequence ratio of `same`, or of `same_concept` where the
concept is the same.  A dropped item does not suppress later ones, so the
answer is the greedy one over the order, and no transitive grouping gives it.
Requests of `most` nodes and `most_chars` characters at most, as the bank's are,
come as one row each to the greedy order itself, which moves their texts once.
No larger request is gathered in one task:

1. Items of one request, stem and concept are one node, its first; the others
   are duplicates of it or of what drops it.
2. A ratio r of two stems means at least r/2 of their characters in matching
   blocks, and so many common q-grams.  Each node gets the rarest of its grams,
   so many that any two similar stems share one of them (prefix filter): grams
   of three characters for `same`, single characters within the concept for
   `same_concept`, each numbered by how often it came before in the stem.  Rare
   is told by counts in 2^16 buckets, which is what is broadcast.
3. Leader rounds: a node that is the first undecided one under all of its
   grams stays, as whatever could drop it is decided.  It is compared with the
   undecided nodes under its grams, and drops what is too similar.  A gram has
   one leader, so a round makes at most a row for each node and gram, however
   many near copies there are.
4. What is undecided after that is compared under its grams in pairs, each
   pair once, and decided by rounds over the pairs that are similar: a node
   without an undecided earlier neighbour stays and drops its later ones.

The comparison itself is the library function of `similarity`, in Arrow
batches, for pairs that have enough bytes in common.  Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.similarity import at_least
from ..session import written

GRAM, BUCKETS, LEADER_ROUNDS, CHARS = 3, 1 << 16, 4, 256


def survivors(stems: list[str], concepts: list[str], same: float = 0.94, same_concept: float = 0.75) -> list[bool]:
    """Which items of a short list stay: the greedy order itself, for a list in memory."""
    if len(stems) < 2:
        return [True] * len(stems)
    chars = sorted({c for s in stems for c in s})
    place = {c: i for i, c in enumerate(chars)}
    width = min(len(place), CHARS)  # of more characters some share a count, which bounds what is common from above
    counts = np.array([np.bincount([place[c] % width for c in s], minlength=width) for s in stems], np.int32) if width else np.zeros((len(stems), 1), np.int32)
    sizes = np.array([len(s) for s in stems], np.int64)
    given = np.array(concepts, object)
    kept: list[int] = []
    out: list[bool] = []
    for i, stem in enumerate(stems):
        at = np.array(kept, np.int64)
        need = np.where(given[at] == concepts[i], min(same, same_concept), same)
        likely = at[2 * np.minimum(sizes[at], sizes[i]) + 1e-9 >= need * (sizes[at] + sizes[i])]
        common = np.minimum(counts[likely], counts[i]).sum(axis=1)
        need = np.where(given[likely] == concepts[i], min(same, same_concept), same)
        likely = likely[2 * common + 1e-9 >= need * (sizes[likely] + sizes[i])].tolist()
        out.append(not any(at_least(stem, stems[k], same_concept if concepts[k] == concepts[i] else same) for k in likely))
        if out[-1]:
            kept.append(i)
    return out


def partners(length: int, ratio: float) -> range:
    """The lengths of stems that can reach the ratio with one of this length."""
    return range(ceil(length * ratio / (2 - ratio) - 1e-9), int(length * (2 - ratio) / ratio + 1e-9) + 1)


@cache
def least_shared(length: int, ratio: float, q: int) -> int:
    """The fewest q-grams that a stem of this length shares with any that reaches the ratio.

    Of lengths that add up to s, at least r * s / 2 characters match.  They lie
    in at most one block more than there are characters without a match, and
    each block loses q - 1 grams.
    """
    def shared(s: int) -> int:
        match = ceil(ratio * s / 2 - 1e-9)
        return match - (q - 1) * (s - 2 * match + 1)

    return min((shared(length + other) for other in partners(length, ratio)), default=length)


@cache
def spelled(length: int, ratio: float) -> bool:
    """Whether grams may miss a pair with a stem of this length, as it or a partner is too short for them."""
    return any(least_shared(n, ratio, GRAM) < 1 for n in (length, *partners(length, ratio)))


def numbered(stem: str, q: int, salt: bytes) -> np.ndarray:
    """A hash of each gram of a stem, with its number among equal ones."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(stem) - q + 1):
        gram = stem[i : i + q]
        seen[gram] = n = seen.get(gram, 0) + 1
        out.append(xxhash.xxh64_intdigest(b"%b\0%d\0%b" % (salt, n, gram.encode())))
    return np.array(out, np.uint64)


def families(stem: str, request: str, concept: str, same: float, same_concept: float) -> Iterator[tuple[np.ndarray, int]]:
    """The kinds of grams of a stem, with how many of each are shared at least."""
    name = request.encode()
    if not stem:
        yield np.array([xxhash.xxh64_intdigest(name + b"\0empty")], np.uint64), 1
        return
    if (n := least_shared(len(stem), same, GRAM)) >= 1:
        yield numbered(stem, GRAM, b"g\0" + name), n
    if spelled(len(stem), same):
        yield numbered(stem, 1, b"s\0" + name), least_shared(len(stem), same, 1)
    yield numbered(stem, 1, b"c\0%b\0%b" % (name, concept.encode())), least_shared(len(stem), same_concept, 1)


def _counted(nodes: DataFrame, same: float, same_concept: float) -> np.ndarray:
    """How many grams fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for request, stem, concept in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for grams, _ in families(stem, request, concept, same, same_concept):
                    np.add.at(total, (grams % BUCKETS).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = nodes.select("request", "stem", "concept").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def prefixes(nodes: DataFrame, same: float, same_concept: float) -> DataFrame:
    """(node, at, length, concept_hash, grams) of nodes: the rarest grams of each kind, in an order that all nodes share."""
    given = nodes.sparkSession.sparkContext.broadcast(_counted(nodes, same, same_concept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = given.value
        for batch in batches:
            out = []
            for request, stem, concept in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6))):
                mine = []
                for grams, shared in families(stem, request, concept, same, same_concept):
                    order = np.lexsort((grams, counts[(grams % BUCKETS).astype(np.int64)]))
                    mine.append(grams[order[: len(grams) - shared + 1]])
                out.append(np.unique(np.concatenate(mine)).view(np.int64).tolist())
            yield pa.record_batch([*batch.columns[:4], pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[:4], "grams"])

    light = nodes.select("node", "at", F.length("stem").alias("length"), F.xxhash64("concept").alias("concept_hash"), "request", "stem", "concept")
    return light.mapInArrow(run, StructType([*light.schema.fields[:4], StructField("grams", ArrayType(LongType()))]))


def _possible(pairs: pa.RecordBatch, same: float, same_concept: float) -> np.ndarray:
    """Whether the bytes that two stems have in common are enough for their ratio, for (_, _, stem, concept, stem, concept)."""
    sides = []
    for i in (2, 4):
        coded = pairs.column(i).dictionary_encode()
        stems = coded.dictionary.to_pylist()
        counts = np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) for t in stems], np.int32).reshape(-1, 256)
        at = coded.indices.to_numpy()
        sides.append((counts[at], np.array([len(t) for t in stems], np.int64)[at]))
    common = np.minimum(sides[0][0], sides[1][0]).sum(axis=1)
    alike = pc.equal(pairs.column(3), pairs.column(5)).to_numpy(zero_copy_only=False)
    return 2 * common + 1e-9 >= np.where(alike, min(same, same_concept), same) * (sides[0][1] + sides[1][1])


def _met(nodes: DataFrame, left: DataFrame, earlier: DataFrame, same: float, same_concept: float) -> DataFrame:
    """(earlier, later) for nodes of `left` that are too similar to one of `earlier` before them.

    Candidates meet as numbers under a gram and become pairs once; stems come to the pairs that are left.
    """
    light = ["node", "at", "length", "concept_hash"]
    a = earlier.select(*[F.col(c).alias(f"{c}0") for c in light], F.explode("grams").alias("gram"))
    b = left.select(*light, F.explode("grams").alias("gram"))
    need = F.when(F.col("concept_hash0") == F.col("concept_hash"), min(same, same_concept)).otherwise(same)
    fits = 2 * F.least("length0", "length") + F.lit(1e-9) >= need * (F.col("length0") + F.col("length"))
    pairs = a.join(b, "gram").where((F.col("at0") < F.col("at")) & fits).select(F.col("node0").alias("earlier"), F.col("node").alias("later")).distinct()
    for end in ("earlier", "later"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("stem").alias(f"{end}_stem"), F.col("concept").alias(f"{end}_concept")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                batch = batch.take(pa.array(np.flatnonzero(_possible(batch, same, same_concept))))
                stem, concept, later, other = (batch.column(i).to_pylist() for i in range(2, 6))
                hit = [at_least(b, a, same_concept if c == d else same) for a, c, b, d in zip(stem, concept, later, other)]
                yield batch.select(["earlier", "later"]).filter(pa.array(hit, pa.bool_()))

    return pairs.select("earlier", "later", "earlier_stem", "earlier_concept", "later_stem", "later_concept").mapInArrow(run, "earlier long, later long")


def independent(nodes: DataFrame, same: float = 0.94, same_concept: float = 0.75) -> DataFrame:
    """(node) that stays, of nodes (node, request, stem, concept, at), at telling the order within a request."""
    left = written(prefixes(nodes, same, same_concept), "dedup-grams")
    kept = None

    def keep(some: DataFrame) -> None:
        nonlocal kept
        kept = some if kept is None else kept.unionByName(some)

    for _ in range(LEADER_ROUNDS):
        grams = left.select("node", "at", F.explode("grams").alias("gram"))
        first = grams.groupBy("gram").agg(F.min("at").alias("first"))
        lead = grams.join(first, "gram").groupBy("node").agg(F.bool_and(F.col("at") == F.col("first")).alias("leads")).where("leads").select("node")
        lead = written(lead, "dedup-leaders")
        keep(lead)
        leaders, rest = left.join(lead, "node", "left_semi"), left.join(lead, "node", "left_anti")
        dropped = _met(nodes, rest, leaders, same, same_concept).select(F.col("later").alias("node")).distinct()
        left = written(rest.join(dropped, "node", "left_anti"), "dedup-left")
        if left.isEmpty():
            return kept
    links = written(_met(nodes, left, left, same, same_concept), "dedup-links")
    nodes_left = left.select("node")
    while True:
        waits = links.select(F.col("later").alias("node")).distinct()
        now = written(nodes_left.join(waits, "node", "left_anti"), "dedup-kept")
        keep(now)
        gone = links.join(now.select(F.col("node").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("node")).distinct()
        over = written(now.unionByName(gone), "dedup-decided")
        nodes_left = written(nodes_left.join(over, "node", "left_anti"), "dedup-open")
        if nodes_left.isEmpty():
            return kept
        for end in ("earlier", "later"):
            links = links.join(over.select(F.col("node").alias(end)), end, "left_anti")
        links = written(links, "dedup-links")


def _small(nodes: DataFrame, same: float, same_concept: float) -> DataFrame:
    """(node) that stays, of nodes whose requests are bounded."""
    rows = nodes.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("at", "node", "stem", "concept"))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                node, stem, concept = (batch.column(k)[i].as_py() for k in range(3))
                stays = survivors(stem, concept, same, same_concept)
                yield pa.record_batch([pa.array([n for n, s in zip(node, stays, strict=True) if s], pa.int64())], names=["node"])

    return rows.select("items.node", "items.stem", "items.concept").mapInArrow(run, "node long")


def fuzzy_dedup(items: DataFrame, same: float = 0.94, same_concept: float = 0.75, most: int = 512, most_chars: int = 1 << 20) -> DataFrame:
    """Items (request, ordinal, stem_key, concept_key) that stay, with all their columns.

    Requests are independent of each other.  A null key is empty, a null
    request one of its own.  Equal ordinals are ordered by a hash of stem and
    concept; of rows that are equal in all of these one stays.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    request = F.coalesce(F.concat(F.lit("="), F.col("request").cast("string")), F.lit(""))
    row = F.struct(*items.columns)
    first = items.groupBy(request.alias("request"), text("stem_key").alias("stem"), text("concept_key").alias("concept")).agg(F.min("ordinal").alias("ordinal"), F.min_by(row, "ordinal").alias("row"))
    nodes = written(first.select(F.monotonically_increasing_id().alias("node"), "request", "stem", "concept", F.struct("ordinal", F.xxhash64("stem", "concept").alias("hash")).alias("at"), "row"), "dedup-nodes")
    size = nodes.groupBy("request").agg(F.count("*").alias("n"), F.sum(F.length("stem") + F.length("concept")).alias("chars"))
    large = written(size.where((F.col("n") > most) | (F.col("chars") > most_chars)).select("request"), "dedup-large")
    if large.isEmpty():
        kept = _small(nodes, same, same_concept)
    else:
        kept = _small(nodes.join(large, "request", "left_anti"), same, same_concept)
        kept = kept.unionByName(independent(nodes.join(large, "request", "left_semi"), same, same_concept))
    return nodes.join(kept, "node", "left_semi").select("row.*")
