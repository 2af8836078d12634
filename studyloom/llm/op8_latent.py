"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of `block` words; a passage is two neighbouring
blocks.  Passages and benchmark items are TF-IDF vectors over the words of
the benchmark, with document frequencies counted over every block of the
corpus.  Their latent space comes from a distributed randomised SVD: each
task sketches its part of C = X'X with a random matrix, sketches add up
across tasks, and a Nystrom step on the driver turns the sum into the leading
singular vectors.  The items enter C with the weight of the corpus, so that
the space keeps what tells them apart.

A passage whose cosine to an item in that space is at least `cosine` is a
candidate; the part of the passage outside the space does not count.  It is
decided on words: the longest common subsequence of the item with a window of
the text about the item's length.  A document is contaminated where that
covers `same` of the item, or `paraphrase` of it and the item's answer stands
in the window word for word.  An item's answer is what follows its last
question mark or "answer:"; items without one are held to `same`.

What a task holds is a slice of text and tables over the benchmark's words.
The benchmark is taken in blocks of about `most_items` passages, no more than
the space has dimensions: with more it would lose what tells items apart.  A
larger benchmark means more passes and no larger broadcast.  No documents are
shuffled or compared with each other: a hot source, passage or group of
copies costs what its bytes cost.

Null and empty texts match nothing; null and wordless items are left out, an
item without an id keeps its null, and repeated items each match.  Repeated rows get equal answers.  Very long texts
are searched whole.  An empty table gives no rows.  Extra columns are ignored
by `matches` and kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit


@dataclass
class Settings:
    block: int = 32
    rank: int = 256
    oversample: int = 24
    cosine: float = 0.35
    same: float = 0.8
    paraphrase: float = 0.6
    most_items: int = 256
    seed: int = 7


@dataclass
class Items:
    """A block of benchmark items: word hashes, their vocabulary, and answers."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray | None]
    vocabulary: np.ndarray = field(init=False)
    known: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are in the vocabulary, and their term numbers."""
        at = np.flatnonzero(self.known[(hashes >> np.uint64(44)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        real = self.vocabulary[term] == hashes[at]
        return at[real], term[real]


def folded(column: pa.Array) -> textkit.Words:
    """The words of texts without case and ASCII signs."""
    return textkit.words(pc.utf8_lower(column), textkit.FOLDED)


_ANSWER = re.compile(r".*(?:\?|\banswer\s*:)\s*(.+)\Z", re.I | re.S)


def read_items(rows: list[tuple]) -> Items:
    ids, found, answers = [], [], []
    for key, text in rows:
        own = folded(pa.array([text])).hash
        if len(own):
            m = _ANSWER.match(text)
            end = folded(pa.array([m[1]])).hash if m else ()
            ids.append(key)
            found.append(own)
            answers.append(end if len(end) else None)
    return Items(ids, found, answers)


def blocked(w: textkit.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the number of its block, for each block its text, and the first block of each text."""
    count = np.diff(w.first)
    blocks = -(-count // size)
    first = np.concatenate([[0], np.cumsum(blocks)])
    text = w.text_of_word()
    return first[text] + (np.arange(len(w.hash)) - w.first[text]) // size, np.repeat(np.arange(len(count)), blocks), first


def _sums(table: np.ndarray, row: np.ndarray, group: np.ndarray, n: int, step: int = 1024, small: int = 48) -> np.ndarray:
    """Sums of table[row] by ascending group number, for groups 0 to n - 1.

    Groups of few rows are added up side by side, their first rows, their
    second rows and so on, in steps that stay in the cache; large ones singly.
    """
    out = np.zeros((n, table.shape[1]), np.float32)
    if not len(row):
        return out
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(start, len(row)))
    for i in np.flatnonzero(count > small):
        out[group[start[i]]] = table[row[start[i] : start[i] + count[i]]].sum(0)
    few = np.flatnonzero(count <= small)
    few = few[np.argsort(-count[few], kind="stable")]
    for at in range(0, len(few), step):
        own = few[at : at + step]
        sums = table[row[start[own]]]
        for k in range(1, int(count[own[0]])):
            m = int(np.searchsorted(-count[own], -k, "left"))
            sums[:m] += table[row[start[own[:m]] + k]]
        out[group[start[own]]] = sums
    return out


def frequencies(docs: DataFrame, items: Items, s: Settings) -> tuple[np.ndarray, int]:
    """In how many blocks of the corpus each term occurs, and the number of blocks."""
    given = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = given.value
        df, n = np.zeros(len(it.vocabulary), np.int64), 0
        for batch in textkit.sliced(batches, "text"):
            w = folded(batch.column(0))
            block, _, first = blocked(w, s.block)
            at, term = it.terms(w.hash)
            df += np.bincount(np.unique(block[at] * len(df) + term) % len(df), minlength=len(df))
            n += int(first[-1])
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["term", "df"])

    rows = docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in rows:
        if r["term"] >= 0:
            df[r["term"]] = r["df"]
    return df, sum(r["df"] for r in rows if r["term"] < 0)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, by one law at every size; no term has none."""
    return (np.log((n + 1) / (df + 1)) + 1e-3).astype(np.float32)


def item_vectors(items: Items, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the items' passages (an item longer than a passage has several), and the item of each."""
    vectors, owner = [], []
    for i, own in enumerate(items.words):
        for at in range(0, len(own), size):
            if at and len(own) - at < size // 2:
                break
            part = own[at:] if len(own) - at - size < size // 2 else own[at : at + size]
            v = np.bincount(np.searchsorted(items.vocabulary, part), minlength=len(idf)) * idf
            vectors.append(v / (np.linalg.norm(v) or 1))
            owner.append(i)
    return np.array(vectors, np.float32).reshape(len(vectors), len(idf)), np.array(owner, np.int64)


def passages(it: Items, idf: np.ndarray, column: pa.Array, s: Settings) -> tuple[textkit.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; block, term of each word of the vocabulary; norm of each passage (block and the next); whether the next is of the same text; first blocks."""
    w = folded(column)
    block, owner, first = blocked(w, s.block)
    at, term = it.terms(w.hash)
    b = block[at]
    n = len(owner)
    same = np.append(owner[1:] == owner[:-1], False) if n else np.zeros(0, bool)
    # squared norms over (passage, term) counts: a word of block j is in passages j and, if of the same text, j - 1
    before = b > 0
    before[before] = same[b[before] - 1]
    pair = np.concatenate([b, b[before] - 1]) * len(idf) + np.concatenate([term, term[before]])
    key, count = np.unique(pair, return_counts=True)
    norm = np.sqrt(np.bincount(key // max(1, len(idf)), (count * idf[key % max(1, len(idf))]) ** 2, minlength=n)) if n else np.zeros(0)
    return w, b, term, norm.astype(np.float32), same, first


def sketch(docs: DataFrame, items: Items, idf: np.ndarray, omega: np.ndarray, s: Settings) -> tuple[np.ndarray, int]:
    """C @ omega for the second-moment matrix C of the corpus' unit passages, and the number of passages.

    A task adds up its slices and returns its sum in bands of terms; bands
    are added by term, streaming, so nothing holds more than a band and a task.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((items, idf, omega))
    band, wide = 64, omega.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, weight, om = given.value
        om = om * weight[:, None]
        total, n = np.zeros((len(weight), wide), np.float64), 0
        for batch in textkit.sliced(batches, "text", 1 << 20):
            _, b, term, norm, same, _ = passages(it, weight, batch.column(0), s)
            if not len(b):
                n += len(norm)
                continue
            one = _sums(om, term, b, len(norm))
            two = one.copy()
            two[:-1] += np.where(same[:-1, None], one[1:], 0)
            scale = 1 / np.maximum(norm, 1e-9) ** 2
            two *= scale[:, None]  # each passage's x @ omega over its squared norm
            back = two.copy()
            back[1:] += np.where(same[:-1, None], two[:-1], 0)  # a block lies in its own passage and in the one before
            order = np.argsort(term, kind="stable")
            total += _sums(back, b[order], term[order], len(weight)) * weight[:, None]
            n += len(norm)
        some = [i for i in range(0, len(total), band) if total[i : i + band].any()]
        yield pa.record_batch([pa.array([-1, *some], pa.int64()), pa.array([n, *[0] * len(some)], pa.int64()), pa.array([b"", *(total[i : i + band].tobytes() for i in some)], pa.binary())], names=["at", "n", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            for at, more, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += more
                if at >= 0:
                    sums[at] = sums.get(at, 0) + np.frombuffer(part)
        yield pa.record_batch([pa.array([-1, *sums], pa.int64()), pa.array([n, *[0] * len(sums)], pa.int64()), pa.array([b"", *(x.astype(np.float32).tobytes() for x in sums.values())], pa.binary())], names=["at", "n", "part"])

    # few tasks, as each returns a whole sketch, but none of more than 64 splits, so that a lost one is soon made up for
    splits = docs.rdd.getNumPartitions()
    most = max(4 * spark.sparkContext.defaultParallelism, -(-splits // 64))
    schema = "at long, n long, part binary"
    parts = docs.select("text").coalesce(most).mapInArrow(run, schema)
    out, n = np.zeros(omega.shape), 0
    for r in parts.repartition("at").mapInArrow(add, schema).collect():
        n += r["n"]
        if r["at"] >= 0:
            x = np.frombuffer(r["part"], np.float32).reshape(-1, wide)
            out[r["at"] : r["at"] + len(x)] = x
    return out, n


def latent_space(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of a positive matrix C from y = C @ omega (Nystrom with a stabilising shift)."""
    shift = 1e-6 * (np.linalg.norm(y) or 1.0)
    y = y + shift * omega
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value.max() * 1e-9
    half = y @ (vector[:, good] / np.sqrt(value[good]))
    u, strength, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, : min(rank, int((strength > 0).sum()))]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, in bits of one integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def judged(item: np.ndarray, answer: np.ndarray | None, text: np.ndarray, s: Settings) -> tuple[float, bool]:
    """The best share of the item in windows of the text about its length, and whether that is contamination.

    A window with too few of the item's words to be contamination is not
    compared, so a share below that is not exact.  Words that the item does
    not have are no part of a common subsequence.
    """
    own, size = item.tolist(), ceil(1.25 * len(item)) + 2
    best, hit = 0.0, False
    least = s.same if answer is None else min(s.same, s.paraphrase)
    inside = np.fromiter(map(set(own).__contains__, text.tolist()), bool, len(text))
    sums = np.concatenate([[0], np.cumsum(inside)])
    starts = np.arange(0, max(1, len(text) - size + max(1, len(own) // 4)), max(1, len(own) // 4))
    most = sums[np.minimum(starts + size, len(text))] - sums[np.minimum(starts, len(text))]
    for at in starts[most / len(own) >= least].tolist():
        window = text[at : at + size].tolist()
        share = lcs(own, text[at : at + size][inside[at : at + size]].tolist()) / len(own)
        if share > best:
            best = share
        if not hit and s.paraphrase <= share < s.same and answer is not None:
            ends = answer.tolist()
            hit = any(window[i : i + len(ends)] == ends for i in range(len(window) - len(ends) + 1))
    return best, hit or best >= s.same


@dataclass
class Search:
    """What a task needs to find the items of a block in texts."""

    items: Items
    idf: np.ndarray
    table: np.ndarray  # for each term its weighted latent vector
    targets: np.ndarray  # the items' latent vectors
    owner: np.ndarray
    settings: Settings

    def find(self, column: pa.Array) -> list[tuple[int, int, float, float]]:
        """(text, item, cosine, share) of each contaminated text of a column."""
        s = self.settings
        w, b, term, norm, same, first = passages(self.items, self.idf, column, s)
        if not len(b):
            return []
        one = _sums(self.table, term, b, len(norm))
        one[:-1] += np.where(same[:-1, None], one[1:], 0)
        length = np.linalg.norm(one, axis=1)
        one[length < 1e-4 * norm] = 0
        one = one @ self.targets.T / np.maximum(length, 1e-9)[:, None]
        block, which = np.nonzero(one >= s.cosine)
        out: dict[tuple[int, int], tuple[float, float]] = {}
        seen: dict[tuple[int, int, int], tuple[float, bool]] = {}
        text = np.searchsorted(first, block, "right") - 1
        for j, k, t in zip(block.tolist(), which.tolist(), text.tolist(), strict=True):
            i = int(self.owner[k])
            lo = w.first[t] + (j - first[t]) * s.block
            reach = max(s.block, len(self.items.words[i]))
            a, z = max(w.first[t], lo - reach), min(w.first[t + 1], lo + 2 * s.block + reach)
            if (t, i, j) not in seen:
                seen[t, i, j] = judged(self.items.words[i], self.items.answers[i], w.hash[a:z], s)
            share, bad = seen[t, i, j]
            if bad:
                c, best = out.get((t, i), (0.0, 0.0))
                out[t, i] = (max(c, float(one[j, k])), max(best, share))
        return [(t, i, c, share) for (t, i), (c, share) in sorted(out.items())]


def searches(docs: DataFrame, benchmark: DataFrame, s: Settings, id_col: str = "item_id", text_col: str = "text", docs_text: str = "text") -> Iterator[Search]:
    """A Search for each block of the benchmark, fitted on all texts of docs."""
    items = benchmark.where(F.length(F.trim(text_col)) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.greatest(F.lit(1), F.ceil(F.regexp_count("text", F.lit(r"[A-Za-z0-9[^\x00-\x7F]]+")) / (2 * s.block)))  # words as `folded` makes them
    blocks = max(1, ceil((items.agg(F.sum(size)).first()[0] or 0) / s.most_items))
    texts = docs.select(F.col(docs_text).alias("text"))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        it = read_items(sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])))
        if not it.ids:
            continue
        df, n = frequencies(texts, it, s)
        idf = weights(df, n)
        vectors, owner = item_vectors(it, idf, 2 * s.block)
        wide = min(len(it.vocabulary), s.rank + s.oversample)
        omega = np.random.default_rng(s.seed).standard_normal((len(it.vocabulary), wide)).astype(np.float32)
        y, count = sketch(texts, it, idf, omega, s)
        y = y / max(1, count) + vectors.T @ (vectors @ omega) / len(vectors)
        space = latent_space(y, omega.astype(np.float64), s.rank).astype(np.float32)
        own = vectors @ space
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        yield Search(it, idf, idf[:, None] * space, own, owner, s)


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc id, item_id, cosine, share) for each contaminated document and item."""
    key = benchmark.schema[item_col].dataType
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item_id {key.simpleString()}, cosine double, share double"
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for search in searches(docs, benchmark, settings or Settings(), id_col=item_col, docs_text=text_col):
        given = docs.sparkSession.sparkContext.broadcast(search)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for batch in textkit.sliced(batches, "text", 1 << 20):
                found = given.value.find(batch.column(1))
                ids = batch.column(0).take(pa.array([t for t, *_ in found], pa.int64()))
                keys = pa.array([given.value.items.ids[i] for _, i, *_ in found], to_arrow_type(key))
                yield pa.record_batch([ids, keys, pa.array([c for _, _, c, _ in found], pa.float64()), pa.array([x for *_, x in found], pa.float64())], names=["id", "item_id", "cosine", "share"])

        one = own.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else own.limit(0).selectExpr("id", f"CAST(NULL AS {key.simpleString()}) AS item_id", "0D AS cosine", "0D AS share")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    at, out = docs.columns.index(text_col), docs
    for search in searches(docs, benchmark, settings or Settings(), docs_text=text_col):
        given = docs.sparkSession.sparkContext.broadcast(search)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for batch in textkit.sliced(batches, text_col, 1 << 20):
                bad = np.zeros(batch.num_rows, bool)
                bad[[t for t, *_ in given.value.find(batch.column(at))]] = True
                yield batch.filter(pa.array(~bad))

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")
