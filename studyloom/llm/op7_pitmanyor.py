"""A hierarchical Pitman-Yor language model of the corpus, sampled by Gibbs sweeps.

Restaurants: every word is a context with its own restaurant, in which the
words that follow it are customers; all contexts share one parent, the
corpus' restaurant, whose customers are the contexts' tables; its base is
uniform over the training vocabulary and one place for any other word.  The
start of a text is a context too.  All training documents fill the same
restaurants, so what is learnt of a context grows with the corpus.

Seating.  It begins with one table for each dish.  A sweep clears a dish,
given the restaurant's other tables and its parent's probabilities, and seats
its customers again, one after the other: a customer who finds n others at t
tables of the dish opens a table with probability m / (m + n - d t), m being
(strength + d * tables of the restaurant) * the parent's probability.  Then
the corpus' restaurant is seated by the same rule from the tables that the
contexts opened.  `chains` such chains run side by side, and predictions are
averaged over them.  With `settle` sweeps go on until the tables of every chain
change by no more than that share or chance would; the next sweep is the sample.
The tables grow for some four or five sweeps from their start, so one sweep
alone would not sample the model.  Seating is exact at every count: see `seated`.  Random
numbers are hashes of the words, the rank, the sweep and the chain, so a
result does not depend on how the rows are laid out.  Discounts are estimated
from counts of counts.

How it is spread.  Texts are encoded in chunks of bounded bytes, once; these
stay where they are, in tables bucketed by the part of the input.  Words and
word pairs are known by hashes and travel as sorted, packed blocks: a part
sends its different words and a chunk its different pairs once, to the bucket
that the hash names, and gets the count over the corpus back.  A frequent pair
so sends one key a chunk, and no task holds a context.  A pair is seated by
one of the chunks that have it, its owner, and a bucket begins with another
chunk when it names owners.  A part's head row has its words and the pairs it
owns: sweeps read that row alone, not the texts.  They exchange words that
occur twice or more in training, once for a part (any other has one customer
at one table, if it has any, after every sweep).  Such words travel as keys
once, before the sweeps: a bucket keeps which of its words each part has, in
a table bucketed by it.  Then a part sends numbers alone, of the words in the
pairs with several customers that it owns: the tables beyond one a pair.  It
gets the state of these back, and after the last sweep that of all its words,
with the state before.  In the last sweep the pairs with more than `hot`
customers travel too, once for a part: the seats of all
others follow from numbers that every part knows.  What came back is written
before it is dealt to the parts, so the keys sent need not stay beside it.  The
driver sees totals.  Hashes have 24 bits more than the number of tokens, at most 64;
those of hot pairs 24 more than the number of these.

A null or empty text has the end token only.  Without training rows every
word has the probability 1.  A row without an id is not held out.  Very long texts are scored whole.
Repeated rows get equal scores, and each trains; extra columns are ignored.
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .shared import cleaned, dropped, executors_cleaned, fresh_path, removed, written

#: The context of a text's first token, and the end token.
START = np.uint64(0x9D4E5C6FB2A1E387)
END = np.uint64(textkit.hash_of(b""))
#: Customers of a dish whose numbers are drawn one by one from hashes; later ones by thinning.
SINGLY = 4096
#: Customers of a dish that sit down beside those of all other dishes with the same number.
ABREAST = 64
#: The query's burn-in ends when a sweep changes the tables by this share or less.
SETTLE = 0.005
#: So many tokens or customers are worked on at a time: what they take fits a core's cache.
SLICE = 1 << 15
#: Where uniform() begins.
SEED = np.uint64(0x243F6A8885A308D3)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Uniform numbers from hashes of the parts."""
    h = SEED
    with np.errstate(over="ignore"):
        for p in parts:
            h = textkit.mix(np.atleast_1d(np.asarray(p).astype(np.uint64)) + h * _STEP)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def opened(draw: np.ndarray, found: np.ndarray, start: np.ndarray, tables: np.ndarray, mass: np.ndarray, discount: float) -> np.ndarray:
    """Which customers open a table, where each sees the tables that those before it opened.

    Customers are in order, dish after dish; start has a dish's first place,
    tables what the dish has before it, found the customers that each finds.
    A customer's answer rests on earlier ones alone, so repeating the rule
    from the fewest tables on settles at the one sequence that obeys it.
    """
    dish = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(draw))))
    m = mass[dish]
    opens = draw * (m + found - discount * tables[dish]) < m
    while True:
        sums = np.concatenate([[0], np.cumsum(opens)])
        t = tables[dish] + sums[:-1] - sums[start][dish]
        again = draw * (m + found - discount * t) < m
        if np.array_equal(again, opens):
            return opens
        opens = again


def seated(customers: np.ndarray, mass: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """The tables of each dish after all its customers have sat down one after the other."""
    return seated_in(customers, [mass], discount, key, [salt])[0]


def seated_in(customers: np.ndarray, masses: list[np.ndarray], discount: float, key: np.ndarray, salts: list[int]) -> list[np.ndarray]:
    """seated() for chains with the same customers and keys, each with masses and a salt of its own.

    The first SINGLY customers of a dish have a random number each.  The first
    ABREAST are seated for all dishes at once, one number after the other, those
    up to SINGLY dish after dish.  For later ones, in blocks that double, the probability at the block's start bounds
    all others of the block (customers found less the tables' discount never
    fall), so candidates come from geometric gaps at that probability and are
    accepted by their own: the same law, at a cost of the tables opened.
    """
    out = [np.minimum(customers, 1).astype(np.int64) for _ in masses]

    def drawn(place: np.ndarray) -> Iterator[np.ndarray]:
        """uniform(place, salt) for each salt, its first step taken once."""
        with np.errstate(over="ignore"):
            first = textkit.mix(place + SEED * _STEP) * _STEP
            for salt in salts:
                yield (textkit.mix(first + np.uint64(salt)) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    upto = np.minimum(customers, ABREAST).astype(np.uint8)
    many = np.flatnonzero(upto > 1)
    for at in range(0, len(many), 2 * SLICE):
        own = many[at : at + 2 * SLICE]
        own = own[np.argsort(upto[own], kind="stable")[::-1]]
        left = len(own) - np.cumsum(np.bincount(upto[own], minlength=ABREAST))  # with more customers than 0, 1, 2, ...
        place, m, t = key[own], [x[own] for x in masses], [np.ones(len(own)) for _ in masses]
        for found in range(1, ABREAST):
            k = int(left[found])
            if not k:
                break
            place = place[:k] + np.uint64(0xD1342543DE82EF95)
            for x, tables, draw in zip(m, t, drawn(place), strict=True):
                tables[:k] += draw * (x[:k] + found - discount * tables[:k]) < x[:k]
        for tables, found_tables in zip(out, t, strict=True):
            tables[own] = found_tables
    many = np.flatnonzero(customers > ABREAST)
    size = np.minimum(customers[many], SINGLY) - ABREAST
    upto = np.cumsum(size)
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        own, count = many[at:to], size[at:to]
        dish = np.repeat(np.arange(len(own)), count)
        found = np.arange(ABREAST, ABREAST + len(dish)) - (np.cumsum(count) - count)[dish]
        with np.errstate(over="ignore"):
            draws = drawn(key[own][dish] + found.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        far = found * (1 - discount)
        for tables, mass, draw in zip(out, masses, draws, strict=True):
            m = mass[own][dish]
            # with as many tables as customers a table is as likely as can be: others never open one
            some = np.flatnonzero(draw * (m + far) < m)
            if len(some):
                own_dish = dish[some]
                start = np.flatnonzero(np.append(True, own_dish[1:] != own_dish[:-1]))
                which = own[own_dish[start]]
                opens = opened(draw[some], found[some].astype(np.float64), start, tables[which], mass[which], discount)
                tables[which] += np.add.reduceat(opens, start)
        at = to
    for tables, mass, salt in zip(out, masses, salts, strict=True):
        crowded(customers, mass, discount, key, salt, tables)
    return out


def crowded(customers: np.ndarray, mass: np.ndarray, discount: float, key: np.ndarray, salt: int, tables: np.ndarray) -> None:
    """Seat the customers beyond the first SINGLY of each dish."""
    for i in np.flatnonzero(customers > SINGLY).tolist():
        rng = np.random.Generator(np.random.PCG64([int(key[i]), salt]))
        n, c, m, t = SINGLY, int(customers[i]), float(mass[i]), int(tables[i])
        while n < c:
            block = min(n, c - n)
            most = m / (m + n - discount * t)
            gaps = [np.minimum(rng.geometric(most, int(block * most * 1.2) + 16), block + 1)]
            while sum(int(g.sum()) for g in gaps) <= block:
                gaps.append(np.minimum(rng.geometric(most, 64), block + 1))
            place = np.cumsum(np.concatenate(gaps)) - 1
            place = place[place < block]
            if len(place):
                t += int(opened(rng.random(len(place)) * most, (n + place).astype(np.float64), np.array([0]), np.array([t]), np.array([m]), discount).sum())
            n += block
        tables[i] = t


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones and twos else 0.5


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, as compressed planes of their bytes."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 3)


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(zstandard.decompress(data[1:], n * data[0] + 1), np.uint8).reshape(data[0], n).T
    return out.view(np.uint64).ravel()


def gaps_of(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as the first and the differences."""
    return np.diff(keys, prepend=np.uint64(0))


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and the place of each key among them."""
    # the keys' upper bits with the places below them sort faster than places by keys; equal upper bits of different keys are rare
    bits = np.uint64(len(keys).bit_length())
    order = (np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], rank


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textkit.mix(context * np.uint64(0x9FB21C651E98DF25) + textkit.mix(word + np.uint64(0x5851F42D4C957F2D)))


class Chunk:
    """Texts of a part: their tokens as numbers of the chunk's words, ascending by hash, and the pairs of neighbours by theirs."""

    def __init__(self, words: np.ndarray, token: np.ndarray, sizes: np.ndarray, train: np.ndarray) -> None:
        self.words, self.token = words, token
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        begin = self.first[:-1]
        context = np.empty(len(token), np.int32)
        context[1:] = token[:-1]
        context[begin] = np.searchsorted(words, START)
        keys = np.empty(len(token), np.uint64)
        for at in range(0, len(token), SLICE):
            keys[at : at + SLICE] = pair_key(words[context[at : at + SLICE]], words[token[at : at + SLICE]])
        self.keys, self.pair = ranked(keys)
        del keys
        some = np.empty(len(self.keys), np.int32)
        some[self.pair] = np.arange(len(token), dtype=np.int32)
        self.place, self.context, self.word = some, context[some], token[some]
        use = np.repeat(train, sizes)
        self.n_pair = np.bincount(self.pair[use], minlength=len(self.keys))
        self.n_word = np.bincount(token[use], minlength=len(words))
        self.n_word[np.searchsorted(words, START)] = int(train.sum())

    @classmethod
    def read(cls, row: dict, held_out: Callable[[str], bool]) -> Chunk:
        sizes = np.array(row["sizes"], np.int64)
        words = np.cumsum(unpacked(row["words"], row["n_words"]), dtype=np.uint64)
        return cls(words, unpacked(row["token"], int(sizes.sum())).astype(np.int32), sizes, trained(row["ids"], held_out))


class Head:
    """A part's head row: its words, their counts over the corpus, the pairs with several customers that it owns, and its hot pairs."""

    def __init__(self, row: dict) -> None:
        self.words = np.cumsum(unpacked(row["words"], row["n_words"]), dtype=np.uint64)
        self.n = unpacked(row["counts"], row["n_words"]).astype(np.int64)
        self.live = np.flatnonzero(self.n > 1)
        self.hot = np.cumsum(unpacked(row["hot"], row["n_hot"]), dtype=np.uint64)
        self.least = unpacked(row["sums"], 2 * row["n_words"]).astype(np.int64).reshape(2, -1)
        self.row = row

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of the pairs that the part owns."""
        return np.divmod(np.cumsum(unpacked(self.row["own"], self.row["n_own"]), dtype=np.uint64).astype(np.int64), max(1, len(self.words)))

    def used(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which of the live words are in these pairs."""
        out = np.zeros(len(self.words), bool)
        out[context] = out[word] = True
        return out[self.live]

    def owned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context, word, customers and key of the pairs that the part owns."""
        n = self.row["n_own"]
        context, word = self.places()
        keys = np.empty(n, np.uint64)
        for at in range(0, n, SLICE):
            keys[at : at + SLICE] = pair_key(self.words[context[at : at + SLICE]], self.words[word[at : at + SLICE]])
        return context, word, unpacked(self.row["own_counts"], n).astype(np.int64), keys

    def state(self, back: pa.Table, chains: int, used: np.ndarray | None = None) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each chain, by the part's words: tables of the context, customers and tables in the corpus' restaurant.

        used: which of the live words the state came back for.  Without it, it
        came for all, and so did the state before, which follows.
        """
        own = self.live if used is None else self.live[used]
        x = received(back, WHOLE, WORDS, len(self.live), 3 * chains * (2 if used is None else 1), used)
        states = []
        for at in range(0, len(x), 3 * chains):
            out = np.repeat(np.minimum(self.n, 1)[None], 3 * chains, 0)
            out[:, own] = x[at : at + 3 * chains]
            states.append([(out[2 * k], out[2 * k + 1], out[2 * chains + k]) for k in range(chains)])
        return states


def trained(ids: list, held_out: Callable[[str], bool]) -> np.ndarray:
    return np.array([i is None or not held_out(str(i)) for i in ids], bool)


_CHUNK = "part int, chunk int, ids array<{id}>, sizes array<int>, n_words int, words binary, token binary"
#: A chunk's words are places among its part's, and its pair_counts those of its tokens.  A head has chunk WHOLE, and what follows these.
_COUNTED = _CHUNK + ", pair_counts binary, counts binary, n_own int, own binary, own_counts binary, n_hot int, hot binary, sums binary, stats array<long>"
_HEAD = ("part", "n_words", "words", "counts", "n_own", "own", "own_counts", "n_hot", "hot", "sums")
#: A block of keys and their numbers, on its way to a bucket and back; chunk is WHOLE where all of a part share it.
_BLOCK = "part int, chunk int, kind int, bucket int, n int, keys binary, values binary"
WORDS, PAIRS = 0, 1
WHOLE = -1
#: The part of a row with a bucket's totals, and of one with the state of its words.
TOTALS, KEPT = -1, -2


@dataclass
class Wire:
    """How keys travel: their bits, and the number of buckets for each kind of key."""

    bits: int
    buckets: tuple[int, int]

    def cut(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits)

    def borders(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Where each bucket begins among ascending keys."""
        n = self.buckets[kind]
        edges = np.array([-(-(i << 64) // n) for i in range(1, n)], np.uint64)
        # a key's bucket must follow from its bits on the wire
        return np.concatenate([[0], np.searchsorted(self.cut(keys), self.cut(edges)), [len(keys)]])

    def send(self, part: int, chunk: int, kind: int, keys: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple]:
        at = self.borders(keys, kind)
        short = self.cut(keys)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if a < b:
                yield part, chunk, kind, i, b - a, packed(gaps_of(short[a:b])), packed(np.concatenate([v[a:b] for v in values]))


def received(rows: pa.Table, chunk: int, kind: int, n: int, width: int, used: np.ndarray | None = None) -> np.ndarray:
    """The values that came back for a chunk's n keys of a kind, or for those used: an array with `width` rows."""
    chunks, kinds = rows["chunk"].to_numpy(), rows["kind"].to_numpy()
    at = np.flatnonzero((chunks == chunk) & (kinds == kind))
    at = at[np.argsort(rows["bucket"].to_numpy()[at])]
    edge = np.concatenate([[0], np.cumsum(rows["n"].to_numpy()[at], dtype=np.int64)])
    if edge[-1] != n:
        raise RuntimeError(f"{n} keys were sent and {edge[-1]} came back")
    sizes = np.diff(edge if used is None else np.concatenate([[0], np.cumsum(used)])[edge]).tolist()
    parts = [unpacked(rows["values"][i].as_py(), width * k).reshape(width, k) for i, k in zip(at.tolist(), sizes, strict=True)]
    return np.concatenate([*parts, np.zeros((width, 0), np.uint64)], axis=1).astype(np.int64)


def words_of(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different words of a part's chunks, ascending, and where among them each chunk has its own."""
    own = [np.cumsum(unpacked(w.as_py(), n.as_py()), dtype=np.uint64) for w, n in zip(rows["words"], rows["n_words"], strict=True)]
    words = np.unique(np.concatenate(own))
    return words, [np.searchsorted(words, w).astype(np.int32) for w in own]


def each(rows: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for i in range(rows.num_rows):
        textkit.lean()
        yield rows.slice(i, 1).to_pylist()[0]
    textkit.lean()


def blocks(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _BLOCK.split(", ")])


class Sums:
    """Blocks of a bucket with a number of values a key: the different keys, the sums of their values, and which of these each block has."""

    def __init__(self, rows: pa.Table, wide: int) -> None:
        order = np.lexsort((rows["chunk"].to_numpy(), rows["part"].to_numpy()))
        rows = rows.take(pa.array(np.roll(order, rows["bucket"][0].as_py() * 2654435761 % (1 << 32) * len(order) >> 32)))
        self.parts, self.chunks, self.sizes = (rows[c].to_pylist() for c in ("part", "chunk", "n"))
        self.kind, self.bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
        self.edge = np.concatenate([[0], np.cumsum(self.sizes)])
        keys, self.values = np.empty(self.edge[-1], np.uint64), np.empty((wide, self.edge[-1]), np.int64)
        for i, (a, b) in enumerate(zip(self.edge[:-1].tolist(), self.edge[1:].tolist(), strict=True)):
            keys[a:b] = np.cumsum(unpacked(rows["keys"][i].as_py(), b - a), dtype=np.uint64)
            self.values[:, a:b] = unpacked(rows["values"][i].as_py(), wide * (b - a)).reshape(wide, -1)
        self.order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[self.order[1:]] != keys[self.order[:-1]])
        self.start = np.flatnonzero(new)
        self.group = np.empty(len(keys), np.int64)
        self.group[self.order] = np.cumsum(new) - 1
        self.keys = keys[self.order[self.start]]
        self.sums = [np.add.reduceat(v[self.order], self.start) for v in self.values]

    def rows(self, back: list[np.ndarray], keys: np.ndarray | None = None) -> list[tuple]:
        """The blocks with these values, and keys, instead of theirs."""
        out = []
        for i, (a, b) in enumerate(zip(self.edge[:-1].tolist(), self.edge[1:].tolist(), strict=True)):
            out.append((self.parts[i], self.chunks[i], self.kind, self.bucket, b - a, None if keys is None else packed(gaps_of(keys[a:b])), packed(np.concatenate([x[a:b] for x in back]))))
        return out


def exchanged(sent: DataFrame, widths: dict[int, int], owners: bool = False) -> DataFrame:
    """Blocks come back with the sums of their keys' values over all chunks.

    owners adds whether the block is the first with a value above 0, counted
    from another block in each bucket, so that no part owns the most.  A
    bucket holds a bounded number of keys.
    """

    def merge(rows: pa.Table) -> pa.Table:
        textkit.lean()
        own = Sums(rows, widths[rows["kind"][0].as_py()])
        back = [x[own.group] for x in own.sums]
        if owners:
            places = np.arange(len(own.group))
            first = np.minimum.reduceat(np.where(own.values[0] > 0, places, len(places))[own.order], own.start)
            back.append((first[own.group] == places).astype(np.int64))
        return blocks(own.rows(back))

    return sent.groupBy("kind", "bucket").applyInArrow(merge, _BLOCK)


def indexed(sent: DataFrame) -> DataFrame:
    """For blocks of words with two values and a flag: a row with each bucket's words and the sums of both values.

    A block comes back with the places of its words among the bucket's, as
    keys, and its flags.  So later blocks of the same words need no keys.
    """

    def merge(rows: pa.Table) -> pa.Table:
        textkit.lean()
        own = Sums(rows, 3)
        whole = (KEPT, WHOLE, own.kind, own.bucket, len(own.keys), packed(gaps_of(own.keys)), packed(np.concatenate(own.sums[:2])))
        return blocks([whole, *own.rows([own.values[2]], own.group.astype(np.uint64))])

    return sent.groupBy("kind", "bucket").applyInArrow(merge, _BLOCK)


def swept(sent: pa.Table, index: pa.Table, chains: int, root: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], last: bool) -> pa.Table:
    """The state of a bucket's words, to each part for those it uses; of the last sweep for all that it has, with the state before.

    sent has what each part adds to the first sums of the words it uses, and
    for the last sweep the state before.
    """
    textkit.lean()
    bucket, blocks_of, base = index["bucket"][0].as_py(), {}, None
    for part, n, keys, values in zip(*(index[c].to_pylist() for c in ("part", "n", "keys", "values")), strict=True):
        if part == KEPT:
            base = np.cumsum(unpacked(keys, n), dtype=np.uint64), unpacked(values, 2 * n).astype(np.int64).reshape(2, n)
        else:
            blocks_of[part] = n, keys, values

    def places(part: int, used: bool) -> np.ndarray:
        n, keys, flags = blocks_of[part]
        out = np.cumsum(unpacked(keys, n), dtype=np.uint64).astype(np.int64)
        return out[unpacked(flags, n) > 0] if used else out

    words, first = base
    sums, before = np.tile(first, (chains, 1)), []
    for part, values in zip(*(sent[c].to_pylist() for c in ("part", "values")), strict=True):
        if part == KEPT:
            before = list(unpacked(values, 3 * chains * len(words)).astype(np.int64).reshape(3 * chains, -1))
        else:
            at = places(part, True)
            sums[:, at] += unpacked(values, 2 * chains * len(at)).astype(np.int64).reshape(2 * chains, -1)
    state = np.stack([*sums, *root(words, sums)])
    told = np.stack([*state, *before]) if last else state
    out = [(part, WHOLE, WORDS, bucket, n, None, packed(told[:, places(part, not last)].ravel())) for part, (n, _, _) in sorted(blocks_of.items())]
    out.append((TOTALS, WHOLE, WORDS, bucket, len(state), None, packed(state.sum(axis=1))))
    if not last:
        out.append((KEPT, WHOLE, WORDS, bucket, len(words), None, packed(state.ravel())))
    return blocks(out)


def totals(back: DataFrame, kind: int) -> list[int]:
    """Sums over all keys of a kind, of each value in the state."""
    out: list[int] = []
    for r in back.where((F.col("part") == TOTALS) & (F.col("kind") == kind)).select("n", "values").toLocalIterator():  # one row a bucket
        own = unpacked(bytes(r["values"]), r["n"]).tolist()
        out = [a + b for a, b in zip(out, own, strict=True)] if out else own
    return out


def bucketed(df: DataFrame, name: str, parts: int) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared folder whose rows are found by part without a shuffle, and what removes it."""
    return bucketed_by(df, name, parts, "part")


def bucketed_by(df: DataFrame, name: str, parts: int, *by: str) -> tuple[DataFrame, Callable[[], None]]:
    """bucketed() by these columns."""
    spark = df.sparkSession
    table, path = f"lm_{name}_{uuid.uuid4().hex}", fresh_path(spark, f"lm-{name}")
    df.write.bucketBy(parts, *by).option("path", path).option("compression", "uncompressed").saveAsTable(table)

    def remove() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        dropped(spark, path)

    return spark.read.table(table), remove


def shuffles(spark: SparkSession) -> set[str]:
    """The shuffles that executors have files of."""
    return set(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(" ").split())


def let_go(spark: SparkSession, finished: set[str], rounds: int = 10) -> None:
    """Have the files of finished shuffles deleted before more is written.

    One cleaned() does not do: Py4J tells the JVM what Python has dropped once a
    second, and a collection may free no more than what holds a shuffle.
    """
    for _ in range(rounds):
        cleaned(spark)
        time.sleep(1)
        if not finished & shuffles(spark):
            break


def encoded(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of docs (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def finish() -> pa.RecordBatch:
            nonlocal number
            words, token = ranked(np.concatenate([*hashes, np.array([START, END])]))
            columns = [[part], [number], pa.array([np.concatenate(ids).tolist()], pa.list_(id_type)), pa.array([np.concatenate(sizes).tolist()], pa.list_(pa.int32())), [len(words)], [packed(gaps_of(words))], [packed(token[:-2])]]
            kinds = [pa.int32(), pa.int32(), None, None, pa.int32(), pa.binary(), pa.binary()]
            number += 1
            return pa.record_batch([c if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "chunk", "ids", "sizes", "n_words", "words", "token"])

        hashes, ids, sizes, size = [], [], [], 0
        for batch in textkit.sliced(batches, "text", 1 << 20):
            id_type = batch.schema.types[0]
            w = textkit.words(batch.column(1), textkit.LOWER)
            counts = np.diff(w.first) + 1
            own = np.full(int(counts.sum()), END, np.uint64)
            place = np.ones(len(own), bool)
            place[np.cumsum(counts) - 1] = False  # the end token of each text
            own[place] = w.hash
            hashes.append(own)
            sizes.append(counts)
            ids.append(np.array(batch.column(0).to_pylist(), object))
            size += len(w.buf) + 64 * batch.num_rows
            if size >= chunk_bytes:
                yield finish()
                hashes, ids, sizes, size = [], [], [], 0
                textkit.lean()
        if ids:
            yield finish()

    return docs.mapInArrow(run, _CHUNK.format(id=kind))


@dataclass
class Law:
    """What holds for all restaurants, and the totals of the corpus' restaurant in the chains of each state."""

    discount: float
    strength: float
    root_discount: float
    root_strength: float
    base: float
    #: For each state, from the start on, the totals (customers, tables) of each chain.
    root: list[list[tuple[int, int]]]

    def settled(self, share: float) -> bool:
        """Whether the last sweep changed the tables of each chain by that share or less, or by what chance explains."""
        pairs = [(a, b) for old, new in zip(*self.root[-2:], strict=True) for a, b in zip(old, new, strict=True)]
        return all(abs(a - b) <= share * b + 4 * b**0.5 for a, b in pairs)

    def parent(self, state: int, chain: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The corpus' probability of each word."""
        n, t = self.root[state][chain]
        return (np.maximum(customers - self.root_discount * tables, 0) + (self.root_strength + self.root_discount * t) * self.base) / (self.root_strength + n)


def scored(
    docs: DataFrame,
    held_out: Callable[[str], bool],
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = 5 << 19,
    strength: float = 1.0,
    root_strength: float = 10.0,
    chains: int = 2,
    sweeps: int = 1,
    settle: float | None = None,
    hot: int = 32,
    bucket_keys: int = 1 << 19,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    held_out says of an id, as text, whether its document is left out of training.
    sweeps is their number, or with settle the least one.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = max(own.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks, forget = bucketed(encoded(own, chunk_bytes), "chunks", parts)
    size = chunks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("tokens"), F.sum("n_words").alias("words")).first()
    tokens = size["tokens"] or 0
    wire = Wire(min(64, 24 + max(1, tokens).bit_length()), (max(64, -(-(size["words"] or 0) // bucket_keys)), max(64, -(-tokens // bucket_keys))))

    def ask(rows: pa.Table) -> pa.Table:
        part, out = rows["part"][0].as_py(), []
        words, places = words_of(rows)
        n = np.zeros(len(words), np.int64)
        for row, place in zip(each(rows), places, strict=True):
            c = Chunk.read(row, held_out)
            n[place] += c.n_word
            out += wire.send(part, row["chunk"], PAIRS, c.keys, [c.n_pair])
        return blocks([*out, *wire.send(part, WHOLE, WORDS, words, [n])])

    others = shuffles(spark)
    # written, so that what was sent is gone before the counts are dealt to the parts and lie beside the chunks
    counts = written(exchanged(chunks.groupBy("part").applyInArrow(ask, _BLOCK), {WORDS: 1, PAIRS: 1}, owners=True), "lm-counts")
    let_go(spark, shuffles(spark) - others)
    # dealt before the chunks are written anew, so that neither the counts' shuffle nor their first copy lies beside these
    dealt, forget_dealt = bucketed(counts.repartition(parts, "part"), "dealt", parts)
    removed(counts)
    let_go(spark, shuffles(spark) - others)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        part, out, owned, many = left["part"][0].as_py(), [], [], []
        words, places = words_of(left)
        n, mine = received(right, WHOLE, WORDS, len(words), 2)
        word = (mine > 0) & (words != START)
        sums, stats = np.zeros((2, len(words)), np.int64), np.zeros(8, np.int64)
        stats[1:4] = word.sum(), (n[word] == 1).sum(), (n[word] == 2).sum()
        for row, place in zip(each(left), places, strict=True):
            c = Chunk.read(row, held_out)
            pairs, own = received(right, row["chunk"], PAIRS, len(c.keys), 2)
            first = own > 0
            sums[0, place] += np.bincount(c.context[first], minlength=len(place))
            sums[1, place] += np.bincount(c.word[first], minlength=len(place))
            at = np.flatnonzero(first & (pairs > 1))  # one customer has one table, always
            owned.append((place[c.context[at]].astype(np.int64) * len(words) + place[c.word[at]], pairs[at]))
            many = [np.union1d(many[0], c.keys[pairs > hot]) if many else c.keys[pairs > hot]]
            stats[0] += c.n_word[c.words != START].sum()
            stats[4:] += first.sum(), (pairs[first] == 1).sum(), (pairs[first] == 2).sum(), (pairs[first] > hot).sum()
            out.append(row | {"words": packed(gaps_of(place.astype(np.uint64))), "pair_counts": packed(pairs[c.pair])})
        own, customers = (np.concatenate(x) for x in zip(*owned, strict=True))
        order = np.argsort(own)
        head = {"part": part, "chunk": WHOLE, "ids": [], "sizes": [], "n_words": len(words), "words": packed(gaps_of(words)), "counts": packed(n), "n_own": len(own), "own": packed(gaps_of(own[order].astype(np.uint64))), "own_counts": packed(customers[order])}
        head |= {"n_hot": len(many[0]), "hot": packed(gaps_of(many[0])), "sums": packed(sums.ravel()), "stats": stats.tolist()}
        more = {"pair_counts": pa.binary(), "counts": pa.binary(), "n_own": pa.int32(), "own": pa.binary(), "own_counts": pa.binary(), "n_hot": pa.int32(), "hot": pa.binary(), "sums": pa.binary(), "stats": pa.list_(pa.int64())}
        return pa.Table.from_pylist([head, *out], pa.schema([*left.schema, *more.items()]))

    counted, forget_counted = bucketed(chunks.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(count, _COUNTED.format(id=kind)), "counted", parts)
    forget()
    forget_dealt()
    cleaned(spark)
    n_all, types, ones, twos, dishes, pair_ones, pair_twos, crowds = (x or 0 for x in counted.agg(*[F.sum(F.col("stats")[i]) for i in range(8)]).first())
    hot_wire = Wire(min(wire.bits, 24 + max(1, crowds).bit_length()), wire.buckets)  # hot pairs are few: fewer bits tell them apart as well
    law = Law(discount_of(pair_ones, pair_twos), strength, discount_of(ones, twos), root_strength, 1.0 / (types + 1), [[(dishes, types)] * chains])

    def head_of(rows: pa.Table) -> Head:
        return Head(rows.to_pylist()[0])

    def least(rows: pa.Table) -> pa.Table:
        head = head_of(rows)
        used = head.used(*head.places()).astype(np.int64)
        return blocks(list(wire.send(rows["part"][0].as_py(), WHOLE, WORDS, head.words[head.live], [*head.least[:, head.live], used])))

    def begun(index: pa.Table) -> pa.Table:
        """One table for each dish, in every chain."""
        return swept(blocks([]), index, chains, lambda _, sums: list(np.minimum(sums[1::2], 1)), False)

    def seats(context: np.ndarray, word: np.ndarray, n: np.ndarray, keys: np.ndarray, state: list[tuple], sweep: int) -> list[np.ndarray]:
        """For each chain the tables of pairs after a sweep."""
        masses = [(law.strength + law.discount * tables[context]) * law.parent(sweep - 1, k, customers, top)[word] for k, (tables, customers, top) in enumerate(state)]
        return seated_in(n, masses, law.discount, keys, [2 * (sweep * chains + k) for k in range(chains)])

    heads = counted.where(F.col("chunk") == WHOLE).select(*_HEAD)
    others = shuffles(spark)
    index, forget_index = bucketed_by(indexed(heads.groupBy("part").applyInArrow(least, _BLOCK)), "index", parts, "kind", "bucket")
    let_go(spark, shuffles(spark) - others)
    state = written(index.groupBy("kind", "bucket").applyInArrow(begun, _BLOCK), "lm-state")
    sweep, last = 0, False
    while not last:
        sweep += 1
        last = sweep >= sweeps and (settle is None or sweep > 1 and law.settled(settle))

        def sit(left: pa.Table, right: pa.Table, *, sweep: int = sweep, last: bool = last) -> pa.Table:
            """Tables beyond one a pair, by context and by word; of the last sweep the hot pairs' tables as well, for all who have them."""
            part, head = left["part"][0].as_py(), head_of(left)
            context, word, n, keys = head.owned()
            used = head.used(context, word)
            tables = seats(context, word, n, keys, head.state(right, chains, used)[0], sweep)
            more = np.stack([np.bincount(where, t - 1, len(head.words)).astype(np.int64)[head.live][used] for t in tables for where in (context, word)])
            edge = wire.borders(head.words[head.live], WORDS)
            at = np.concatenate([[0], np.cumsum(used)])[edge]
            out = [(part, WHOLE, WORDS, i, int(edge[i + 1] - edge[i]), None, packed(more[:, at[i] : at[i + 1]].ravel())) for i in np.flatnonzero(np.diff(at)).tolist()]
            if last:
                many = n > hot
                found = np.zeros((chains, len(head.hot)), np.int64)
                found[:, np.searchsorted(head.hot, keys[many])] = [t[many] for t in tables]
                out += hot_wire.send(part, WHOLE, PAIRS, head.hot, list(found))
            return blocks(out)

        def root(words: np.ndarray, sums: np.ndarray, *, sweep: int = sweep) -> list[np.ndarray]:
            full = words << np.uint64(64 - wire.bits)
            mass = [(law.root_strength + law.root_discount * t) * law.base for _, t in law.root[sweep - 1]]
            return [seated(sums[2 * k + 1], np.full(len(words), mass[k]), law.root_discount, full, 2 * (sweep * chains + k) + 1) for k in range(chains)]

        def merge(sent: pa.Table, index: pa.Table, *, root: Callable = root, last: bool = last) -> pa.Table:
            if index.num_rows:
                return swept(sent, index, chains, root, last)
            own = Sums(sent, chains)  # hot pairs
            return blocks(own.rows([x[own.group] for x in own.sums]))

        sent = heads.groupBy("part").cogroup(state.where("part >= 0").groupBy("part")).applyInArrow(sit, _BLOCK)
        if last:
            sent = sent.unionByName(state.where(F.col("part") == KEPT))
        before, state = state, written(sent.groupBy("kind", "bucket").cogroup(index.groupBy("kind", "bucket")).applyInArrow(merge, _BLOCK), "lm-state")
        removed(before)
        cleaned(spark)
        executors_cleaned(spark)
        found = totals(state, WORDS) or [0] * (3 * chains)
        law.root.append([(ones + found[2 * k + 1], ones + found[2 * chains + k]) for k in range(chains)])
    forget_index()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        whole = pc.equal(left["chunk"], WHOLE)
        head = head_of(left.filter(whole))
        words, n, begin_word = head.words, head.n, np.searchsorted(head.words, START)
        new, old = head.state(right, chains)
        hot_tables = received(right, WHOLE, PAIRS, len(head.hot), chains)
        plain_of, room, rest, parent = np.log10((n + 1) / (n_all + types + 1)), law.strength + n, [], []
        for k, (context, customers, top) in enumerate(new):
            rest.append((law.strength + law.discount * context) / room)
            parent.append(law.parent(sweep, k, customers, top))
        for row in each(left.filter(pc.invert(whole))):
            sizes = np.array(row["sizes"], np.int64)
            begin = np.cumsum(sizes) - sizes
            place = np.cumsum(unpacked(row["words"], row["n_words"]), dtype=np.uint64).astype(np.int64)
            token = place[unpacked(row["token"], int(sizes.sum())).astype(np.int64)]
            context = np.roll(token, 1)
            context[begin] = begin_word
            pairs = unpacked(row["pair_counts"], len(token)).astype(np.int64)
            at = np.flatnonzero(pairs > 1)
            keys, which = ranked(pair_key(words[context[at]], words[token[at]]))
            some = np.empty(len(keys), np.int64)
            some[which] = at
            many = pairs[some] > hot
            few = some[~many]
            found = np.zeros((chains, len(keys)), np.int64)
            found[:, ~many] = seats(context[few], token[few], pairs[few], keys[~many], old, sweep)
            found[:, many] = hot_tables[:, np.searchsorted(head.hot, keys[many])]
            mean = np.zeros(len(token))
            for k in range(chains):
                tables = np.minimum(pairs, 1)
                tables[at] = found[k][which]
                mean += np.maximum(pairs - law.discount * tables, 0) / room[context] + rest[k][context] * parent[k][token]
            known = np.add.reduceat((n > 0)[token], begin, dtype=np.int64)
            plain = np.add.reduceat(plain_of[token], begin)
            logs = np.add.reduceat(np.log10(mean / chains), begin)
            out.append(
                pa.table(
                    {
                        "id": pa.array(row["ids"], left.schema.field("ids").type.value_type),
                        "held_out": pa.array(~trained(row["ids"], held_out)),
                        "n_tokens": pa.array(sizes),
                        "n_known": pa.array(known),
                        "train_tokens": pa.array(np.full(len(begin), n_all, np.int64)),
                        "base_score": pa.array(plain),
                        "score": pa.array(logs),
                    }
                )
            )
        return pa.concat_tables(out)

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = written(counted.groupBy("part").cogroup(state.where("part >= 0").groupBy("part")).applyInArrow(score, schema), "lm-scores")
    forget_counted()
    removed(state)
    return result


def op7_pitmanyor(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held_out(key: str) -> bool:
        return zlib.crc32(key.encode()) % 7 == 2

    found = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out, settle=SETTLE)
    return found.withColumnRenamed("id", "doc_id").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
