"""Key terms of a short text: ranked phrases and single words grounded in it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that cannot start, end or carry a term.
STOP_WORDS = frozenset(
    """a an and are as at be by can for from has have in into is it may more of on or that the their there these this
    those to under was were when which with after before during between through also hand go goes used""".split()
)
#: Words too general for a term.
GENERIC_WORDS = frozenset(
    """about action activity amount assessment change client condition example finding general information level levels
    method patient patients person process record result results sign signs statement thing time type types way work""".split()
)
#: Words that are no nouns.
NON_NOUNS = frozenset(
    """absorb absorbs after allow allows assess assesses can cause causes change changes describe described decrease
    decreased gains go goes include includes lose loses may need occur occurs provide reports affect affects indicate
    indicates report should show shows use used when with""".split()
)
#: Parts of words that mark a medical term.
MEDICAL = "algia emia itis osis pathy penia plegia uria tension tachy cardia electrolyte volume deficit imbalance membrane hypo hyper therapy syndrome".split()
#: Words left in lower case within a term.
CONNECTORS = frozenset("and of for with in on to".split())
_BARRED = GENERIC_WORDS | NON_NOUNS | {"water", "body"}
#: The patterns at which a text is cut into spans, of a word, and of what no heading has.
_SPANS = re.compile(r"(?<=[.!?:])\s+|\n+")
_WORD = re.compile(r"[A-Za-z][A-Za-z-]*")
_ENDS = re.compile(r"[.!?]")
#: Suffix rules (least length, suffix, characters cut, added); the first that fits decides.
SUFFIXES = (
    (6, "ies", 3, "y"),
    (6, "ches", 2, ""),
    (6, "shes", 2, ""),
    (6, "xes", 2, ""),
    (6, "zes", 2, ""),
    (6, "s", 1, ""),
    (7, "ied", 3, "y"),
    (7, "ed", 2, ""),
    (8, "ing", 3, ""),
)


def lemma(word: str) -> str:
    w = word.casefold()
    for least, suffix, cut, add in SUFFIXES:
        if len(w) >= least and w.endswith(suffix) and not (suffix == "s" and w[-2] in "sui"):
            return w[:-cut] + add
    return w


def _medical(word: str) -> bool:
    return any(m in word for m in MEDICAL)


class Word(NamedTuple):
    """What a word brings to the terms that it is part of."""

    lemma: str
    barred: bool
    real: bool
    medical: bool
    #: Whether no term starts or ends with it, and whether a heading cannot have it.
    stop: bool
    plain: bool
    #: Its score as a term of its own, 0 where it is none.
    score: int


def described(shown: str) -> Word:
    w = lemma(shown)
    real, special, capital = w not in STOP_WORDS, _medical(w), shown[0].isupper()
    alone = len(w) >= 6 and real and w not in GENERIC_WORDS and (special or capital)
    return Word(w, w in _BARRED, real, real and special, shown.casefold() in STOP_WORDS, w in NON_NOUNS or w in GENERIC_WORDS, 2 + 4 * special + 2 * capital if alone else 0)


_remembered = lru_cache(1 << 16)(described)


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(score, term) in the order of the text: phrases from long to short, then single words, span by span.

    A phrase needs a medical word, or to be a whole short heading, so only the
    windows around medical words are looked at.
    """
    for span in _SPANS.split(text):
        words = [_remembered(w) if len(w) <= 64 else described(w) for w in _WORD.findall(span)]
        n = len(words)
        at = [i for i, w in enumerate(words) if w.medical]
        heading = n <= 5 and not _ENDS.search(span) and not any(w.plain for w in words)
        for size in range(min(5, n), 1, -1) if at or heading else ():
            bonus = 5 if heading and size == n else 0
            for a in (0,) if bonus else sorted({a for i in at for a in range(max(0, i - size + 1), min(i, n - size) + 1)}):
                own = words[a : a + size]
                if own[0].stop or own[-1].stop or any(w.barred for w in own):
                    continue
                hits, kept = sum(w.medical for w in own), sum(w.real for w in own)
                if kept >= 2:
                    yield 2 * size + kept + 4 * hits + bonus, " ".join([w.lemma for w in own])
        for w in words:
            if w.score:
                yield w.score, w.lemma


def titled(term: str) -> str:
    return " ".join(w if i and w in CONNECTORS else w.capitalize() for i, w in enumerate(term.split()))


def key_terms(text: str | None, limit: int = 12) -> list[str]:
    """The best terms, none of them part of a better one; equal scores in the order of the text."""
    if not text or not text.strip():
        return []
    best: dict[str, tuple[int, int]] = {}
    for place, (score, term) in enumerate(candidates(text)):
        if term not in best or -score < best[term][0]:
            best[term] = (-score, place)
    chosen: list[str] = []
    for term in sorted(best, key=best.__getitem__):
        if not any(term in better for better in chosen):
            chosen.append(term)
            if len(chosen) == limit:
                break
    return [titled(t) for t in chosen]


def key_terms_of(c: Column) -> Column:
    """key_terms as a column, by Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(key_terms)

    return F.pandas_udf(run, "array<string>")(c)
