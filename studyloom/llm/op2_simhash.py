"""SimHash near-duplicates by pigeonhole blocks.

`fingerprints` gives each text a 64-bit SimHash of its word shingles.  Two
fingerprints that differ in at most `distance` bits agree on all but
`distance` of `blocks` blocks, so every choice of blocks - distance blocks is
a join key and each close pair meets under at least one.  With 6 blocks and 2
bits a key fixes 42 bits or more: distinct texts rarely share one by chance,
and a key can hold at most 2 ** 22 different fingerprints, whatever the
number of documents.  Documents are first reduced to distinct fingerprints,
so a group of equal texts, however large, is one row.

Under a key Hamming distance is verified on arrays (XOR and popcount, or for
large keys a lookup of all neighbours), and only a spanning set of links is
kept: one link less than members for each cluster, never all pairs.
Connected components then run over fingerprints that have a link.

The pipeline asks for more than close fingerprints: `similar_texts` links
those by the blocks above, and beside them takes MinHash bands as candidates
and verifies the Jaccard similarity of whole shingle sets.

Null texts count as empty.  Empty texts have fingerprint zero and are linked
like any other.  A row without an id gets its component's least id, null if
no row of it has one.  Repeated rows get the same answer each.  Extra columns of the
input are ignored by `near_duplicates` and kept by `representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .shared import cleaned, components, fresh_names, removed, written

BITS = 64
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    if hasattr(np, "bitwise_count"):
        return np.bitwise_count(x)
    return sum(_POPCOUNT[(x >> np.uint64(s)) & np.uint64(0xFFFF)] for s in (0, 16, 32, 48))


def simhash(data: bytes, shingle: int) -> int:
    """The SimHash of lower-cased text bytes: XXH64 with seed 42 of each shingle, strict majority for each bit."""
    found = data.split()  # splits at exactly 0x20 and 0x09-0x0D
    if not found:
        return 0
    n = len(found) - shingle + 1
    text = b" ".join(found)
    if n <= 1:
        return xxhash.xxh64_intdigest(text, 42)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    end = np.cumsum(size) - 1
    starts, ends = (end - size + 1)[:n].tolist(), end[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, "text", 8 << 20):
            texts = batch.column(1).cast(pa.binary())
            out = np.fromiter((simhash((t.as_py() or b"").translate(_TO_LOWER), shingle) for t in texts), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The bits that each choice of blocks - distance blocks fixes."""
    width = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    low = [sum(width[:i]) for i in range(blocks)]
    bits = [((1 << w) - 1) << s for w, s in zip(width, low, strict=True)]
    return [sum(c) for c in combinations(bits, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def linked(values: np.ndarray, distance: int, free: int, small: int = 1024) -> list[tuple[int, int]]:
    """Spanning links of the graph on distinct values that joins those at most `distance` bits apart.

    free: a mask of the bits in which the values can differ.
    """
    values = np.unique(values)
    n = len(values)
    label = np.arange(n)
    links: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            p, q = root(i), root(j)
            if p != q:
                label[max(p, q)] = min(p, q)
                links.append((int(values[i]), int(values[j])))

    if n <= small:
        for i in range(n - 1):
            near = np.flatnonzero(popcount(values[i + 1 :] ^ values[i]) <= distance)
            join(np.full(len(near), i), near + i + 1)
    else:
        bits = [np.uint64(1 << i) for i in range(BITS) if free >> i & 1]
        for k in range(1, distance + 1):
            for flip in combinations(bits, k):
                other = values ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
                at = np.minimum(np.searchsorted(values, other), n - 1)
                hit = np.flatnonzero((values[at] == other) & (values < other))
                join(hit, at[hit])
    return links


def fingerprint_links(fps: DataFrame, blocks: int = 6, distance: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp that span every cluster of links."""
    masks = block_masks(blocks, distance)
    signed = [_signed(m) for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("which", "key"))
    shared = keyed.groupBy("which", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for which, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = found.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for x, y in linked(own, distance, ~masks[which] & (1 << 64) - 1):
                    a.append(_signed(x))
                    b.append(_signed(y))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return shared.select("which", "fps").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, blocks: int = 6, distance: int = 2) -> DataFrame:
    """(id, fp, component_id): component_id is the least id that links of near fingerprints reach."""
    marked = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = components(fingerprint_links(fps.select("fp"), blocks, distance))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("id", "fp", "component_id")


#: The pipeline's parameters: words in a shingle, least Jaccard similarity of the shingle sets, and for the candidates
#: bands of MinHash values.  A pair at 0.8 shares no band in 0.01 per cent of cases, a pair at 0.9 never in practice.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
#: Words in a shingle of the SimHash, as in `near_duplicates`.
SIM_SHINGLE = 3
#: Sizes of sets in one class differ by less than this factor.
STEP = 1.06
_MINHASH = np.random.default_rng(20240517).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's different word shingles, ascending, and where each text's begin; a shorter text is one shingle, an empty one none."""
    w = textkit.words(column, textkit.LOWER)
    n_words, text = np.diff(w.first), w.text_of_word()
    with np.errstate(over="ignore"):
        rolling, power = w.hash.copy(), 1
        for k in range(1, shingle):
            power = power * 0xD1342543DE82EF95 % (1 << 64)
            inside = np.flatnonzero(np.arange(len(text)) + k < w.first[1:][text]) if len(text) else np.zeros(0, np.int64)
            rolling[inside] += w.hash[inside + k] * np.uint64(power)
    place = np.arange(len(text)) - w.first[text]
    at = np.flatnonzero((place + shingle <= n_words[text]) | (place == 0))
    h, owner = textkit.mix(rolling[at]), text[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(n_words) + 1))


def set_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set of shingle_sets, whatever their order; zero for an empty one."""
    fp, full = np.zeros(len(first) - 1, np.uint64), np.flatnonzero(np.diff(first))
    with np.errstate(over="ignore"):
        if len(full):
            fp[full] = np.add.reduceat(textkit.mix(h ^ np.uint64(42)), first[full])
    return fp


def set_marks(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, fp, sim, n, bands) of docs (id, text): a hash of the shingle set, the SimHash, the set's size and its bands' MinHash keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, "text"):
            h, first = shingle_sets(batch.column(1), shingle)
            n, full = batch.num_rows, np.flatnonzero(np.diff(first))
            fp, keys = set_hashes(h, first), np.zeros((n, BANDS), np.uint64)
            sim = np.fromiter((simhash((t.as_py() or b"").translate(_TO_LOWER), SIM_SHINGLE) for t in batch.column(1).cast(pa.binary())), np.uint64, n)
            with np.errstate(over="ignore"):
                if len(full):
                    for k in range(BANDS * ROWS):
                        least = np.minimum.reduceat((h ^ _MINHASH[0, k]) * _MINHASH[1, k], first[full])
                        keys[full, k // ROWS] = textkit.mix(keys[full, k // ROWS] + least)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64)), pa.array(sim.view(np.int64)), pa.array(np.diff(first).astype(np.int32)), lists], names=["id", "fp", "sim", "n", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long, sim long, n int, bands array<long>")


def text_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(fp, grams) of docs (text): the shingle set itself beside its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, "text"):
            h, first = shingle_sets(batch.column(0), shingle)
            grams = pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())
            yield pa.record_batch([pa.array(set_hashes(h, first).view(np.int64)), grams], names=["fp", "grams"])

    return docs.select("text").mapInArrow(run, "fp long, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of pairs whose sets in sets (fp, grams) have that Jaccard similarity or more.

    sizes (fp, n) come first: sets whose sizes differ too much cannot have it and are not moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                good[i] = both >= similarity * (len(one) + len(two) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(good))

    sized = pairs.join(sizes.withColumnsRenamed({"fp": "a", "n": "m"}), "a").join(sizes.withColumnRenamed("fp", "b"), "b")
    pairs = sized.where(F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9).select("a", "b")
    one = pairs.join(sets.withColumnsRenamed({"fp": "a", "grams": "x"}), "a")
    both = one.join(sets.withColumnsRenamed({"fp": "b", "grams": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def node_grams(sets: DataFrame) -> DataFrame:
    """(fp, n, gram): a row for each shingle of sets (fp, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(x.as_buffer(), np.int64)
                for at in range(0, len(h), 1 << 16):
                    own = h[at : at + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(own), fp)), pa.array(np.full(len(own), len(h), np.int32)), pa.array(own)], names=["fp", "n", "gram"])

    return sets.select("fp", "grams").mapInArrow(run, "fp long, n int, gram long")


def prefixes(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(gram, own, other, fp, n, left, share): the keys under which the sets of nodes (fp) meet all others of them that can be similar.

    Two sets of m and n shingles are similar if they have similarity / (1 +
    similarity) of m + n or more in common.  Shingles are put in one order,
    those of the fewest nodes first.  The first one that two sets share, and
    all others that they share, are then among the last of each: so many
    at least must be left in both from it on.  So a set is met under the
    shingles before that point alone, and a passage that many
    texts have, however many, comes last and brings none of them together
    unless it is nearly all they have.  The point depends on the other set's
    size: sizes are in classes, a STEP wide, and a shingle is a key for
    each class of partners for which enough is left.  share is the part of a
    set that other nodes have as well.
    """
    grams = node_grams(sets.join(nodes, "fp", "left_semi"))
    common = grams.groupBy("gram").agg(F.count("*").alias("nodes")).where("nodes > 1")
    # shingles of one node alone come first and are no keys, so the others' places can be counted from the end
    by_node = Window.partitionBy("fp").orderBy(F.desc("nodes"), F.desc("gram"))
    ordered = grams.join(common, "gram").withColumn("left", F.row_number().over(by_node)).withColumn("share", F.max("left").over(Window.partitionBy("fp")) / F.col("n"))
    step, reach = float(np.log(STEP)), int(np.ceil(-np.log(similarity) / np.log(STEP))) + 1
    own = ordered.where(F.col("left") >= similarity * F.col("n") - 1e-6).withColumn("own", F.floor(F.log("n") / step).cast("int"))
    sized = own.withColumn("other", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    least = F.col("n") + F.pow(F.lit(STEP), F.col("other"))
    return sized.where(F.col("left") >= similarity / (1 + similarity) * least - 1e-6).select("gram", "own", "other", "fp", "n", "left", "share")


def prefix_pairs(keys: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of nodes that meet under keys, have enough left there and differ in their roots in named (fp, root).

    Under a key all but the nodes of its most frequent root look for partners.
    """
    rooted = keys.drop("share").join(named.select("fp", "root"), "fp").withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    counted = rooted.groupBy("gram", "lo", "hi", "root").agg(F.count("*").alias("nodes"))
    main = counted.groupBy("gram", "lo", "hi").agg(F.max_by("root", F.struct("nodes", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    split = written(rooted.join(main, ["gram", "lo", "hi"]).drop("lo", "hi"), "prefixes-split")
    one = split.where("root <> main").select("gram", F.col("own").alias("c"), F.col("other").alias("d"), F.col("fp").alias("a"), F.col("root").alias("p"), F.col("n").alias("m"), F.col("left").alias("x"))
    two = split.select("gram", F.col("other").alias("c"), F.col("own").alias("d"), F.col("fp").alias("b"), F.col("root").alias("q"), "main", "n", F.col("left").alias("y"))
    enough = F.least("x", "y") >= similarity / (1 + similarity) * (F.col("m") + F.col("n")) - 1e-6
    met = one.join(two, ["gram", "c", "d"]).where(F.expr("p <> q AND (q = main OR a > b)") & enough)
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def fingerprint_nodes(marked: DataFrame) -> DataFrame:
    """(a, b): links that span the nodes fp of marked (fp, sim) whose SimHashes are equal or close.

    A SimHash stands on its least node; links are those of `fingerprint_links`.
    """
    leads = written(marked.groupBy("sim").agg(F.min("fp").alias("lead")), "simhash-nodes")
    same = marked.select("fp", "sim").distinct().join(leads, "sim").where("fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
    close = fingerprint_links(leads.select(F.col("sim").alias("fp")))
    one = close.join(leads.select(F.col("sim").alias("a"), F.col("lead").alias("p")), "a")
    both = one.join(leads.select(F.col("sim").alias("b"), F.col("lead").alias("q")), "b")
    return same.unionByName(both.select(F.col("p").alias("a"), F.col("q").alias("b")))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component_id): component_id is the least id that links reach, of texts with close SimHashes or `similarity` of shingle sets.

    Texts with equal sets are one node.  Nodes whose SimHashes differ in 2
    bits or less are linked, as in `near_duplicates`.  Nodes that share a band are
    candidates: first each with the least node of its band, then, where a band is
    left with several components, each with the one that has the largest part of
    its set in common with others, then all pairs across components, among the
    nodes of such bands, whose sets can be similar by `prefixes`.  A band's
    own pairs would be as many as the square of the texts that share a passage.  Each
    such pair is verified on the whole sets, so a link is never a guess, and pairs
    within a component, such as those of a large group of copies, are spared.
    The sets are as large as the texts: docs are read a second time for those
    of candidates alone, one of equal ones is kept, and they and the shuffles
    that moved them are let go once no later step reads them.
    """
    spark, own = docs.sparkSession, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = written(set_marks(own, shingle), "set-marks")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    keyed = marked.select("fp", F.posexplode("bands").alias("band", "key")).where("fp <> 0").distinct()
    shared = written(keyed.groupBy("band", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1).select("fps").distinct(), "bands")
    wanted = shared.select(F.explode("fps").alias("fp")).distinct()
    sizes = written(marked.select("fp", "n").join(wanted, "fp", "left_semi").distinct(), "set-sizes")
    cleaned(spark)
    sets = written(text_sets(own, shingle).join(sizes.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "candidate-sets")
    cleaned(spark)
    stars = shared.select(F.explode(F.expr("slice(fps, 2, size(fps) - 1)")).alias("a"), F.col("fps")[0].alias("b")).distinct()
    links = written(verified(stars, sets, sizes, similarity).unionByName(fingerprint_nodes(marked)).distinct(), "similar")
    cleaned(spark)
    def roots(of: DataFrame, links: DataFrame) -> DataFrame:
        return of.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    named = written(roots(wanted, links), "similar-roots")
    bands = shared.withColumn("of", F.xxhash64("fps"))
    member = bands.select("of", F.explode("fps").alias("fp")).join(named, "fp")
    split = member.groupBy("of").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("of")
    torn = written(member.join(split, "of", "left_semi"), "split-bands")
    keys = written(prefixes(torn.select("fp").distinct(), sets, similarity), "prefixes")
    cleaned(spark)
    met = torn.join(keys.select("fp", "share").distinct(), "fp")
    middle = met.groupBy("of").agg(F.max_by(F.struct("fp", "root"), F.struct("share", "fp")).alias("top"))
    toward = met.join(middle, "of").where("root <> top.root").select(F.greatest("fp", "top.fp").alias("a"), F.least("fp", "top.fp").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    toward = written(toward, "middle-stars")
    more = written(links.unionByName(verified(toward, sets, sizes, similarity)), "similar")
    across = prefix_pairs(keys, roots(torn.select("fp").distinct(), more), similarity).join(stars.unionByName(toward), ["a", "b"], "left_anti")
    found = components(more.unionByName(verified(across, sets, sizes, similarity)))
    for done in (shared, sizes, sets, links, named, torn, keys, toward, more):
        removed(done)
    cleaned(spark)
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("id", "fp").join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("id", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their component of similar texts: one row of each, that with the least id.

    Near copies are those of `similar_texts`: SimHashes that differ in 2 bits
    or less, and 5-word shingle sets with a Jaccard similarity of 0.8 or more,
    as at 0.8 SimHashes differ by some 10 of 64 bits, which no number of
    blocks makes selective.  Rows without an id
    come after all others, and texts with one id by a hash; so a group of
    such rows has one that stays as well.  Of repeated rows one stays.  All
    columns stay as they are.
    """
    text, key, kept = fresh_names(docs, "text_hash", "row_key", "kept_key")
    place = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    marks = similar_texts(docs.select(place.alias(key), F.col(text_col).alias(text)), key, text).where("id <=> component_id").select(F.col("id").alias(kept)).distinct()
    # a struct is never null, and equal where its parts are, nulls included; of the very type of the marks, so that one
    # shuffle of the texts serves the join and the repeats
    rows = docs.withColumn(key, place.cast(marks.schema[kept].dataType))
    return rows.join(marks, F.col(key) == F.col(kept)).dropDuplicates([key]).drop(key, kept)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
