"""Personal data, also where it is disguised, with spans in the source text.

Plain identifiers are found in the text as it stands.  Then transducers
rewrite the text in steps: homoglyphs and invisible characters, bracketed or
spelled "at" and "dot", spelled digits.  Each step carries, for every
character of its output, the source range it came from, so steps compose and
a span found in the rewritten text maps back to source code points.  A span
is added if its source differs from the rewritten text and it overlaps no
span added before it and no plain span but those of its own kind that it
strictly contains, which a disguise of a part leaves; plain spans always stay.
A number that stands plainly is not made longer by spelled digits beside it,
which may be prose, only by figures of other scripts or invisible characters.

All scanners are linear in the text, so very long texts and runs are safe.
The work is a map over rows without a shuffle.  Null and empty texts have no
spans.  Repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LETTER = re.compile("[A-Za-z]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def plain(text: str) -> dict[str, list[Span]]:
    """The spans of each kind in the text as it stands; a match that fails its test is dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


#: Letters of other scripts that look like ASCII letters, then the letters that they look like.
_LOOKALIKE = (
    "АВСЕНІЈКМОРЅТХУаеорсухіјѕԁһԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρ",
    "ABCEHIJKMOPSTXYaeopcyxijsdhqw" "ABEZHIKMNOPTYXoavikp",
)
_HOMOGLYPH = dict(zip(*_LOOKALIKE, strict=True)) | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"․": ".", "。": ".", "﹫": "@", "‐": "-", "‑": "-", " ": " "}
_INVISIBLE = "​‌‍⁠﻿­"
_ODD = re.compile(f"[{re.escape(''.join(_HOMOGLYPH) + _INVISIBLE)}]|(?![0-9])\\d")

_ODD_CHARS = frozenset(_HOMOGLYPH) | frozenset(_INVISIBLE)


def _odd(m: re.Match) -> str:
    c = m.group()
    return "" if c in _INVISIBLE else _HOMOGLYPH.get(c) or str(unicodedata.digit(c, c))


#: The digits 0 to 9 spelled in English, German, Spanish and French, and words for the signs.
_SPELLED = [
    "zero null cero zéro oh",
    "one eins uno un",
    "two zwei dos deux",
    "three drei tres trois",
    "four vier cuatro quatre",
    "five fünf cinco cinq",
    "six sechs seis",
    "seven sieben siete sept",
    "eight acht ocho huit",
    "nine neun nueve neuf",
]
_DIGIT = {w: str(i) for i, names in enumerate(_SPELLED) for w in names.split()}
_AT, _DOT, _PLUS = "at|arroba|arobase|klammeraffe", "dot|punkt|punto|point", "plus|más|mas"
_WORD = "|".join(sorted(_DIGIT, key=len, reverse=True))
_BRACKETED = re.compile(rf"\s?[\[({{<]\s?(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s?[\])}}>]\s?", re.I)
#: A spelled digit counts if it stands beside another, beside a spelled dot or plus, or beside a figure.
_ITEM = rf"(?:{_WORD}|[0-9]+)"
_RUN = re.compile(rf"(?<!\w)(?:(?P<plus>{_PLUS})[\s-]+)?(?=(?:{_ITEM})[\s,-]+)(?:(?:{_WORD}|[0-9]+)(?:[\s,]{{1,2}}|-|[\s]+(?:{_DOT})[\s]+|\.(?=\w)))+(?:{_WORD}|[0-9]+)(?!\w)", re.I)
_PIECE = re.compile(rf"(?P<word>{_WORD})|(?P<num>[0-9]+)|(?P<dot>\s+(?:{_DOT})\s+|\.)|(?P<plus>{_PLUS})|(?P<gap>[\s,-]+)", re.I)
#: "un" is an article too: a run needs another spelled digit beside it.
_TELLING = frozenset(w.encode() for w in _DIGIT if w != "un")
_DOT_WORDS = frozenset(w.encode() for w in _DOT.split("|"))
_TO_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Top-level domains that an address spelled with bare "at" and "dot" must end in.
_TOP = "com|org|net|edu|gov|info|io|co|eu|uk|us|de|at|ch|fr|es|it|nl|be|ca|au|mx|br|in|jp|cn|ru|dev|app|biz|me"
_AT_DOT = re.compile(rf"(?<=[A-Za-z0-9._%+-])\s+(?:{_AT})\s+(?=[A-Za-z0-9-]+(?:\s+(?:{_DOT})\s+[A-Za-z0-9-]+)*?\s+(?:{_DOT})\s+(?:{_TOP})(?![\w@]))", re.I)
_DOTS = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:{_DOT})\s+(?=[A-Za-z0-9])", re.I)
_HAS_SIGN = re.compile(rf"[\[({{<]\s?(?:{_AT}|@|{_DOT}|\.)\s?[\])}}>]", re.I)


def _digit_run(m: re.Match) -> str:
    """The figures of a run of spelled digits; a run without a spelled digit stays."""
    words, telling = 0, False
    out = []
    for p in _PIECE.finditer(m.group()):
        kind = p.lastgroup
        if kind == "word":
            words += 1
            telling |= p.group().lower() != "un"
            out.append(_DIGIT[p.group().lower()])
        elif kind == "num":
            out.append(p.group())
        elif kind == "dot":
            out.append(".")
        elif kind == "plus":
            out.append("+")
    return "".join(out) if words >= 2 and telling else m.group()


class Rewritten:
    """A text and, for each of its characters, the source range [lo, hi) that it came from."""

    def __init__(self, text: str, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> None:
        self.text = text
        self.lo = np.arange(len(text)) if lo is None else lo
        self.hi = self.lo + 1 if hi is None else hi

    def step(self, pattern: re.Pattern, replace: Callable[[re.Match], str]) -> Rewritten:
        """Every match replaced; all characters of a replacement come from the whole match."""
        pieces, lo, hi, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = replace(m)
            if new == m.group():
                continue
            pieces += [self.text[at:a], new]
            lo += [self.lo[at:a], np.full(len(new), self.lo[a])]
            hi += [self.hi[at:a], np.full(len(new), self.hi[b - 1])]
            at = b
        if not pieces:
            return self
        return Rewritten("".join([*pieces, self.text[at:]]), np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]]))

    def source(self, span: Span) -> Span:
        return int(self.lo[span[0]]), int(self.hi[span[1] - 1])


def rewritten(text: str) -> Rewritten:
    """The text after all transducers."""
    out = Rewritten(text)
    if not text.isascii():
        chars = set(text)
        if not _ODD_CHARS.isdisjoint(chars) or any(c.isdigit() and c > "9" for c in chars):
            out = out.step(_ODD, _odd)
    names = set(out.text.lower().encode().translate(_TO_WORDS).split())
    if not _TELLING.isdisjoint(names):
        out = out.step(_RUN, _digit_run)
    if _HAS_SIGN.search(out.text):
        out = out.step(_BRACKETED, lambda m: "@" if m["at"] else ".")
    if not _DOT_WORDS.isdisjoint(names):
        out = out.step(_AT_DOT, lambda m: "@").step(_DOTS, lambda m: ".")
    return out


def spans(text: str) -> tuple[dict[str, list[Span]], list[tuple[int, int, str]]]:
    """The plain spans by kind, and all spans as (start, end, kind) by start and then kind."""
    base = plain(text)
    every = [(a, b, k) for k in KINDS for a, b in base[k]]
    new = rewritten(text)
    if new.text is not text:
        ends = {k: [b for _, b in base[k]] for k in KINDS}
        more: list[tuple[int, int, str]] = []
        done = 0  # where the added spans end
        for kind, found in plain(new.text).items():
            for s in found:
                a, b = new.source(s)
                if text[a:b] != new.text[s[0] : s[1]]:
                    more.append((a, b, kind))
        for a, b, kind in sorted(more, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
            if a < done:
                continue
            # plain spans of one kind ascend and do not overlap
            met = [(k, base[k][j]) for k in KINDS for j in range(bisect_right(ends[k], a), bisect_right(base[k], (b - 1, len(text))))]
            whole = kind == "email" or not _LETTER.search(text, a, b)
            if all(whole and k == kind and a <= x and y <= b and (x, y) != (a, b) for k, (x, y) in met):
                every.append((a, b, kind))
                done = b
    every.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return base, every


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, plain counts by kind, plain spans, all spans, number added) for each row; spans as kind:start:end, comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.sliced(batches, "text", 8 << 20):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans(text or "")
                own = sorted(((a, b, k) for k in KINDS for a, b in base[k]), key=lambda x: (x[0], KINDS.index(x[2])))
                rows.append((*(len(base[k]) for k in KINDS), _joined(own), _joined(every), len(every) - len(own)))
            counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            yield pa.record_batch([batch.column(0), *counts, pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.string()), pa.array([r[6] for r in rows], pa.int64())], names=["id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_added long")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count the plain spans; spans holds these and those that the transducers add, n_added of them."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")
