"""BPE encoding and decoding with forced boundaries.

A merge makes a vocabulary token, so two neighbouring bytes that occur inside
no token are never merged: between them lies a certain cut.  Every word of a
text is split at its certain cuts, the fragments are encoded independently,
lowest merge rank first and leftmost among equals, and their ids are put
together again.  With word-end tokens the last byte of a word is another
symbol than the same byte inside it, and pairs are told apart accordingly.
Fragments are short and few, so their ids are kept for the next time they come
up; one that is longer than `KEPT` is encoded by a heap in n log n.  Ids are
kept as bytes of 32-bit integers, which are joined like text.

The vocabulary is a BPE file of the tokenizers library (JSON), read by the
driver, at most `MOST_BYTES` bytes, and broadcast.  Supported are the
normalizers NFC, Lowercase and Replace of white space, splitting by a pattern
or by the byte-level default, byte-level symbols, an end-of-word suffix,
special tokens found in the text, and byte-level or no decoding; any other
part of a file is an error.  Pieces with letters or digits that are newer than
Python's Unicode tables are normalised and split by the tokenizers library,
whose tables are newer; their words are encoded here like all others.

Work is a map over rows: no shuffle, and a hot source or a group of copies is
no hot spot.  A worker holds one slice of text and at most 2 ** 19 words of
up to KEPT characters (some 100 MB), and 2 ** 16 fragments.  Texts beyond `PIECE` characters are encoded in pieces
cut in front of white space, where no word, normalisation or match can cross.

A null or empty text has no ids and decodes to the empty text.  Repeated rows
get equal answers.  Ids outside the vocabulary are left out in decoding.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

NONE = 1 << 48
MOST_BYTES, KEPT, PIECE = 64 << 20, 40, 1 << 20
#: Fixed value: the pattern of byte-level splitting where a file asks for the default.
DEFAULT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BREAK = regex.compile(r"(?<=\S)(?=[ \n\t\r])")


@cache
def newer() -> regex.Pattern:
    """Letters and numbers that Python's tables do not have yet."""
    found, signs = [], regex.compile(r"[\p{L}\p{N}]")
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        if unicodedata.category(c) == "Cn" and signs.match(c):
            if found and ord(c) == found[-1][1] + 1:
                found[-1][1] += 1
            else:
                found.append([ord(c), ord(c)])
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in found) + "]" if found else r"(?!)")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest in order from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def lowered(text: str) -> str:
    """Every character in lower case by itself: a final sigma is a sigma."""
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, all of which Python's tables have."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Words(dict):
    """word -> the bytes of its ids, filled as words come up and emptied when full."""

    def __init__(self, encode: Callable[[str], bytes], most: int = 1 << 19):
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= KEPT:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """An encoder and decoder of one vocabulary file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.content = content
        model = spec["model"]
        for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"):
            if model.get(k):
                raise ValueError(f"{k} of a BPE file is not supported")
        self.normal = [self._normalizer(n) for n in self._parts(spec.get("normalizer"), "normalizers")]
        self.pattern = self._splitter(self._parts(spec.get("pre_tokenizer"), "pretokenizers"))
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.of = {s: b for b, s in enumerate(symbols)}
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or []):
            raise ValueError("added tokens are supported only where they stand for themselves")
        # Symbols 0-255 are bytes within a word, 256-511 last bytes.
        self.first = [vocab[s] for s in symbols] + [vocab[s + suffix] for s in symbols]
        if len(vocab) > NONE >> 24:
            raise ValueError("a vocabulary of more than 2 ** 24 tokens is not supported")
        self.merges = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            self.merges[vocab[a] << 24 | vocab[b]] = rank << 24 | vocab[a + b]
        self.inside = bytearray(1 << 17)  # pairs of neighbours within some token: byte, then byte or last byte
        for token in vocab:
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            data = [self.of[c] for c in (token[: -len(suffix)] if ends else token) if c in self.of]
            for i, (x, y) in enumerate(zip(data, data[1:])):
                self.inside[x << 9 | y | (256 if ends and i == len(data) - 2 else 0)] = 1
        self.last = 256 if suffix else 0
        self.fragments: dict[bytes, bytes] = {}
        self.words = Words(self.word)
        self.library = None
        named = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        decoder = (spec.get("decoder") or {"type": None})["type"]
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"decoder {decoder} is not supported")
        self.joined = decoder is None
        self.tokens = pa.array([named.get(i) for i in range(max(named) + 1)], pa.string())
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @staticmethod
    def _parts(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    @staticmethod
    def _normalizer(part: dict) -> Callable[[str], str]:
        if part["type"] == "NFC":
            return lambda t: unicodedata.normalize("NFC", t)
        if part["type"] == "Lowercase":
            return lowered
        if part["type"] == "Replace" and "Regex" in part["pattern"]:
            found, to = regex.compile(part["pattern"]["Regex"]), part["content"]
            return lambda t: found.sub(to, t)
        raise ValueError(f"normalizer {part['type']} is not supported")

    @staticmethod
    def _splitter(parts: list[dict]) -> regex.Pattern:
        kinds = [p["type"] for p in parts]
        if kinds == ["ByteLevel"] and parts[0]["use_regex"] and not parts[0]["add_prefix_space"]:
            return regex.compile(DEFAULT_PATTERN)
        if kinds == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            return regex.compile(parts[0]["pattern"]["Regex"])
        raise ValueError(f"splitting by {kinds} is not supported")

    def cuts(self, data: bytes) -> list[int]:
        """Where the bytes of a word fall apart for certain; the last byte is a word's end."""
        inside, n = self.inside, len(data) - 1
        found = [i + 1 for i in range(n - 1) if not inside[data[i] << 9 | data[i + 1]]]
        if n > 0 and not inside[data[n - 1] << 9 | data[n] | self.last]:
            found.append(n)
        return found

    def word(self, word: str) -> bytes:
        """The ids of one word: those of its fragments in order."""
        data = word.encode()
        cuts = self.cuts(data)
        if not cuts:
            return self.merged(data, True)
        cuts.append(len(data))
        at, out = 0, []
        for to in cuts:
            key = data[at:to] + b"\xff" if to == len(data) else data[at:to]  # 0xff is no byte of UTF-8
            ids = self.fragments.get(key)
            if ids is None:
                ids = self.merged(data[at:to], to == len(data))
                if len(key) <= KEPT:
                    if len(self.fragments) >= 1 << 16:
                        self.fragments.clear()
                    self.fragments[key] = ids
            out.append(ids)
            at = to
        return b"".join(out)

    def merged(self, data: bytes, ends: bool) -> bytes:
        """The ids of one fragment: the merge of lowest rank, leftmost first, until none is left."""
        ids = [self.first[b] for b in data]
        if ends:
            ids[-1] = self.first[data[-1] + self.last]
        if len(ids) > KEPT:
            return array("i", self._heaped(ids)).tobytes()
        get = self.merges.get
        ranks = [get(a << 24 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            ids[i] = new = least & 0xFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << 24 | ids[i + 1], NONE)
        return array("i", ids).tobytes()

    def _heaped(self, ids: list[int]) -> list[int]:
        """The same merges of a long fragment, by a heap over a linked list."""
        n, get = len(ids), self.merges.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit, i) for i in range(n - 1) if (hit := get(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            hit, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 24 | ids[j]) != hit:
                continue
            ids[i], ids[j] = hit & 0xFFFFFF, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (then := get(ids[i] << 24 | ids[k])) is not None:
                    heapq.heappush(heap, (then, i))
            if (h := left[i]) >= 0 and (then := get(ids[h] << 24 | ids[i])) is not None:
                heapq.heappush(heap, (then, h))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> Iterator[str]:
        """Pieces of about PIECE characters that begin with white space after a word, the first apart."""
        at = 0
        while len(text) - at > PIECE:
            cut = _BREAK.search(text, at + PIECE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text without special tokens."""
        out = []
        for piece in self.pieces(text):
            if not latin(piece) and newer().search(piece):
                found = self.split_by_library(piece)
            else:
                for step in self.normal:
                    piece = step(piece)
                found = self.pattern.findall(piece)
            out.append(np.frombuffer(b"".join(map(self.words.__getitem__, found)), np.int32))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def split_by_library(self, piece: str) -> list[str]:
        """The words of a piece as the library's normalizer and splitter give them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content)
        if self.library.normalizer is not None:
            piece = self.library.normalizer.normalize_str(piece)
        return [bytes(self.of[c] for c in symbols).decode() for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def encode(self, text: str) -> np.ndarray:
        if not self.marks:
            return self.plain(text)
        parts = self.marks.split(text)
        if len(parts) == 1:
            return self.plain(text)
        return np.concatenate([np.array([self.special[p]], np.int32) if i % 2 else self.plain(p) for i, p in enumerate(parts)])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        if ids.null_count:
            ids = pc.fill_null(ids, pa.scalar([], ids.type))
        flat, ends = ids.flatten(), pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]), pa.int32())
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.tokens)))
        tokens = self.tokens.take(pc.if_else(known, flat, None))
        if tokens.null_count:
            size = np.concatenate([[0], np.cumsum(tokens.is_valid().to_numpy(zero_copy_only=False))])
            ends, tokens = pa.array(size[ends.to_numpy()], pa.int32()), tokens.drop_null()
        texts = pc.binary_join(pa.ListArray.from_arrays(ends, tokens), " " if self.joined else "")
        if self.joined:
            return texts
        return pa.array([self._bytes(t) for t in texts.to_pylist()], pa.string())

    def _bytes(self, text: str) -> str:
        """Symbols back to bytes; special tokens stay as they are."""
        parts = self.marks.split(text) if self.marks else [text]
        return b"".join(p.encode() if i % 2 else bytes(self.of[c] for c in p) for i, p in enumerate(parts)).decode("utf-8", "replace")


@cache
def loaded(content: str) -> Bpe:
    return Bpe(content)


def vocabulary(path: str) -> str:
    """A vocabulary file's content; beyond MOST_BYTES an error, for it is broadcast."""
    with open(path, encoding="utf-8") as f:
        content = f.read(MOST_BYTES + 1)
    if len(content.encode()) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return content


def encode(docs: DataFrame, content: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for each row, ids an array of int."""
    given = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(given.value)
        for batch in textkit.sliced(batches, "text", 1 << 20):
            found = [bpe.encode(t) if t else np.zeros(0, np.int32) for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(coded: DataFrame, content: str) -> DataFrame:
    """(id, ids, text) for each row of (id, ids)."""
    given = coded.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(given.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch([part.column(0), part.column(1), bpe.decode(part.column(1))], names=["id", "ids", "text"])

    return coded.select("id", "ids").mapInArrow(run, f"id {coded.schema['id'].dataType.simpleString()}, ids array<int>, text string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    content = vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), content), content)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
