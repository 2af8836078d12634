"""Quotes found in their source, up to white space, as the source has them.

A pattern with a node for every word would overflow the JVM's stack on long
quotes, so the search runs on collapsed text by Arrow batches and maps its
place back to the source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_PIECE = re.compile(r"\S+")
_WORD = re.compile(r"\w+")


class Source:
    """A source text, collapsed once a quote is not in it as it stands, with the places of its pieces once one is found so."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def flat(self) -> str:
        return " ".join(self.text.split())

    @cached_property
    def begin(self) -> list[int]:
        return [m.start() for m in _PIECE.finditer(self.text)]

    def _place(self, at: int) -> int:
        """Where the text has a character of a piece; the collapsed text has a space between two pieces and nowhere else."""
        return self.begin[self.flat.count(" ", 0, at)] + at - (self.flat.rfind(" ", 0, at) + 1)

    def canonical(self, quote: str | None) -> str | None:
        """The source's span for a quote of at least 12 characters and two words; null where there is none."""
        flat = " ".join((quote or "").split())
        if len(flat) < 12 or len(_WORD.findall(flat)) < 2:
            return None
        if quote in self.text:
            return quote
        at = self.flat.find(flat)
        return None if at < 0 else self.text[self._place(at) : self._place(at + len(flat) - 1) + 1]


def canonical_quote(source: Column, quote: Column) -> Column:
    def run(sources: pd.Series, quotes: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else Source(s).canonical(q) for s, q in zip(sources, quotes, strict=True)])

    return F.pandas_udf(run, "string")(source, quote)


def canonical_quotes(source: Column, quotes: Column) -> Column:
    """The distinct spans of an array of quotes that the source has, in their order."""

    def run(sources: pd.Series, quotes: pd.Series) -> pd.Series:
        out = []
        for s, qs in zip(sources, quotes, strict=True):
            own = Source(s or "")
            found = (own.canonical(q) for q in (qs if qs is not None else ()))
            out.append(list(dict.fromkeys(q for q in found if q is not None)))
        return pd.Series(out)

    return F.pandas_udf(run, "array<string>")(source, quotes)


def with_evidence(rows: DataFrame, source: str, points: str, headings: str, to: str) -> DataFrame:
    """The rows with column `to`: for each list of points the distinct spans that the source has, or that of the heading.

    A source is read and collapsed once, however many lists there are.
    """
    at = [rows.columns.index(c) for c in (source, points, headings)]
    names = [*rows.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lists, heads in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                own = Source(text or "")
                found = []
                for qs, head in zip(lists or (), heads or (), strict=True):
                    spans = [q for q in map(own.canonical, qs) if q is not None] or [q for q in [own.canonical(head)] if q is not None]
                    found.append(list(dict.fromkeys(spans)))
                out.append(found)
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(pa.list_(pa.string())))], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(to, ArrayType(ArrayType(StringType())))]))
