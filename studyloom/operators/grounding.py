"""Evidence against sources: which texts hold which quotes.

A containment join has no key, so Spark would compare every pair.  Instead
the quotes become one automaton that finds all of them in a single pass over
a text.  The automaton goes to every task, so the quotes' total size is
measured first; quotes beyond `most_bytes` are taken in several automata of
at most that size, one pass each.  Texts are never shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T

#: So many characters of a text are searched in the time that an automaton takes for one of its own.
SEARCHED = 256
_SEPARATORS, _WHITE = re.compile("[\x1c-\x1f]"), re.compile(f"[{T.WHITE}]+")
#: So many places go to Spark at once.
PLACES = 1 << 16


class Finder:
    """Where the quotes of a set begin and end in a text, by one automaton; its members are numbers in that set."""

    def __init__(self, quotes: list[str]) -> None:
        by_text: dict[str, list[int]] = {}
        for i, q in enumerate(quotes):
            if q:
                by_text.setdefault(q, []).append(i)
        self.automaton = None
        if by_text:
            self.automaton = ahocorasick.Automaton()
            for q, members in by_text.items():
                self.automaton.add_word(q, (len(q), members))
            self.automaton.make_automaton()

    def members(self, text: str) -> list[int]:
        return sorted({i for _, (_, members) in self.automaton.iter(text) for i in members}) if self.automaton else []

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """(member, begin, end) for every occurrence."""
        return [(i, at + 1 - n, at + 1) for at, (n, members) in self.automaton.iter(text) for i in members] if self.automaton else []


def places_in(quotes: list[str], text: str) -> list[tuple[int, int, int]]:
    """(member, begin, end) for every occurrence of quotes in one text.

    An automaton costs much for each character of the quotes, a search little
    for each of the text: few quotes are searched for one by one.
    """
    by_text: dict[str, list[int]] = {}
    for i, q in enumerate(quotes):
        if q:
            by_text.setdefault(q, []).append(i)
    if len(by_text) * len(text) > SEARCHED * (len(text) + sum(map(len, by_text))):
        return Finder(quotes).places(text)
    out = []
    for q, members in by_text.items():
        at = text.find(q)
        while at >= 0:
            out += [(i, at, at + len(q)) for i in members]
            at = text.find(q, at + 1)
    return out


def _flat(text: str | None) -> str:
    """White space collapsed as T.collapsed does, which does not count the separators U+001C to U+001F that str.split() does."""
    if text is None:
        return ""
    if _SEPARATORS.search(text):
        return _WHITE.sub(" ", text).strip(" ")
    return " ".join(text.split())


def grounded(sources: DataFrame, quotes: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(source_id, quote_id) for each source text that holds a quote, white space collapsed on both sides.

    sources has (id, text), quotes (id, quote) with ids of any type; quotes too short to be evidence are left out.
    """
    flat = quotes.where(T.quotable(F.col("quote"))).select("id", T.collapsed(F.col("quote")).alias("quote"))
    total = flat.agg(F.sum(F.octet_length("quote"))).first()[0] or 0
    parts = max(1, -(-total // most_bytes))
    schema = StructType([StructField("source_id", sources.schema["id"].dataType), StructField("quote_id", quotes.schema["id"].dataType)])
    out = None
    for k in range(parts):
        some = flat.where(F.pmod(F.xxhash64("id", "quote"), F.lit(parts)) == k) if parts > 1 else flat
        given = sources.sparkSession.sparkContext.broadcast(some.select("id", "quote").toArrow())

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            ids = given.value.column("id").combine_chunks()
            finder = Finder(given.value.column("quote").to_pylist())
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    hits = finder.members(_flat(text))
                    at += [i] * len(hits)
                    found += hits
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(found, pa.int64()))], names=["source_id", "quote_id"])

        one = sources.select("id", "text").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _dealt(sources: DataFrame, quotes: DataFrame, most: int) -> DataFrame:
    """(source_id, ids, quotes, text): quotes (id, source_id, quote) in lots of about `most`, each with the text of its source.

    A source that very many quotes name so is no hot group.  Quotes without
    two words are left out; their white space is not collapsed yet.
    """
    fit = quotes.where(T.two_words(F.col("quote"))).select(F.col("id").alias("quote_id"), "source_id", "quote")
    lots = quotes.groupBy("source_id").agg(F.ceil(F.count("*") / most).alias("lots"))
    dealt = fit.join(lots, "source_id").groupBy("source_id", F.pmod(F.xxhash64("quote_id", "quote"), F.col("lots")).alias("lot")).agg(F.collect_list("quote_id").alias("ids"), F.collect_list("quote").alias("quotes"))
    return dealt.join(sources.select(F.col("id").alias("source_id"), "text"), "source_id").select("source_id", "ids", "quotes", "text")


def _found(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """For each row (source_id, ids, quotes, text, ...): its number, where its ids begin in the batch's, and its quotes' places."""
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())]).tolist()
    for i in range(batch.num_rows):
        flat: dict[str, str] = {}
        said = batch.column(2)[i].as_py()
        for q in said:
            if q not in flat:
                flat[q] = f if len(f := _flat(q)) >= T.LEAST_QUOTE else ""
        yield i, first[i], places_in([flat[q] for q in said], _flat(batch.column(3)[i].as_py()))


def located(sources: DataFrame, quotes: DataFrame, most: int = 1000) -> DataFrame:
    """(source_id, quote_id, begin, end) for every place of quotes (id, source_id, quote) in their own source's collapsed text.

    Quotes too short to be evidence have no place.
    """
    met = _dealt(sources, quotes, most)
    schema = StructType([*met.schema.fields[:1], StructField("quote_id", quotes.schema["id"].dataType), StructField("begin", IntegerType()), StructField("end", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column(1).flatten()
            for i, first, places in _found(batch):
                rows += [(i, first + m, a, z) for m, a, z in places]
                if len(rows) >= PLACES or rows and i == batch.num_rows - 1:
                    at, member, begin, end = zip(*rows, strict=True)
                    yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(member, pa.int64())), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["source_id", "quote_id", "begin", "end"])
                    rows = []

    return met.mapInArrow(run, schema)


def held(sources: DataFrame, quotes: DataFrame, spans: DataFrame, most: int = 1000) -> DataFrame:
    """(quote_id, section) for each section (source_id, section, first, last) of their own source that holds quotes (id, source_id, quote) whole.

    What `contained` says of the places that `located` finds, told beside the
    text: no place is shuffled, and a quote's sections come once for a lot.
    """
    listed = spans.where("last > first").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("first", "last", "section"))).alias("spans"))
    met = _dealt(sources, quotes, most).join(listed, "source_id").select("source_id", "ids", "quotes", "text", *[F.col(f"spans.{c}").alias(c) for c in ("first", "last", "section")])
    schema = StructType([StructField("quote_id", quotes.schema["id"].dataType), StructField("section", spans.schema["section"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, sections = batch.column(1).flatten(), batch.column(6).flatten()
            own = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(6)).to_numpy())]).tolist()
            for i, first, places in _found(batch):
                begins, ends = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                furthest = list(accumulate(ends, max))
                hits = set()
                for m, a, z in places:
                    k = bisect_right(begins, a) - 1
                    while k >= 0 and furthest[k] >= z:
                        if ends[k] >= z:
                            hits.add((first + m, own[i] + k))
                        k -= 1
                rows += sorted(hits)
                if len(rows) >= PLACES or rows and i == batch.num_rows - 1:
                    member, section = zip(*rows, strict=True)
                    yield pa.record_batch([ids.take(pa.array(member, pa.int64())), sections.take(pa.array(section, pa.int64()))], names=["quote_id", "section"])
                    rows = []

    return met.mapInArrow(run, schema)


def extraction_errors(expected: DataFrame, returned: DataFrame, chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """(request, error, source_id, n): what an extractor's output has wrong against the sources that it was given.

    expected has (request, source_id), returned (request, source_id) for each
    source in the output, chunks (request, source_id, chunk_source_id, chunk_id,
    quotes) for each chunk under its source, texts (id, text).  The bags of
    sources are compared by a full outer join of their counts: `missing`,
    `unknown`, `twice`.  Then chunks that name another source than the one
    they stand under (`other source`), and quotes that the source does not
    have (`not in source`), found by their places; those of chunks without a
    known source are not looked for.  A null id is an unknown source.
    """
    keys = ["request", "source_id"]
    both = expected.groupBy(*keys).agg(F.count("*").alias("given")).withColumnRenamed("source_id", "a").withColumnRenamed("request", "r").join(
        returned.groupBy(*keys).agg(F.count("*").alias("got")), F.col("r").eqNullSafe(F.col("request")) & F.col("a").eqNullSafe(F.col("source_id")), "full_outer"
    )
    bag = both.select(F.coalesce("request", "r").alias("request"), F.coalesce("source_id", "a").alias("source_id"), F.coalesce("given", F.lit(0)).alias("given"), F.coalesce("got", F.lit(0)).alias("got"))
    error = F.when(F.col("got") == 0, "missing").when((F.col("given") == 0) | F.col("source_id").isNull(), "unknown").when(F.col("got") > 1, "twice")
    of_bag = bag.withColumn("error", error).where("error IS NOT NULL").select("request", "error", "source_id", F.greatest("got", F.lit(1)).alias("n"))
    other = chunks.where(~F.col("source_id").eqNullSafe(F.col("chunk_source_id"))).groupBy(*keys).agg(F.count("*").alias("n")).select("request", F.lit("other source").alias("error"), "source_id", "n")
    known = chunks.join(expected.distinct(), keys, "left_semi")
    said = known.select("request", "source_id", F.posexplode("quotes").alias("place", "quote"), "chunk_id").withColumn("id", F.struct("request", "chunk_id", "place"))
    found = located(texts, said.select("id", "source_id", "quote")).select(F.col("quote_id").alias("id")).distinct()
    lost = said.join(found, "id", "left_anti").groupBy(*keys).agg(F.count("*").alias("n")).select("request", F.lit("not in source").alias("error"), "source_id", "n")
    return of_bag.unionByName(other).unionByName(lost)


def contained(places: DataFrame, spans: DataFrame, keys: list[str], width: int = 2048) -> DataFrame:
    """Each place (keys, begin, end) with each span (keys, first, last) that holds it whole.

    An interval join by buckets of positions: a span goes to every bucket that
    it touches, a place to that where it begins, so a place meets the spans
    around it alone.
    """
    wide = spans.where("last > first").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))))
    return places.withColumn("_bucket", F.floor(F.col("begin") / width)).join(wide, [*keys, "_bucket"]).where("first <= begin AND end <= last").drop("_bucket")


def section_scores(evidence: DataFrame, held: DataFrame) -> DataFrame:
    """(plan, question, section, score): how many of a question's quotes, (plan, question, quote_id), a section holds, (quote_id, section)."""
    return evidence.join(held.select("quote_id", "section").distinct(), "quote_id").groupBy("plan", "question", "section").agg(F.count("*").alias("score"))


def assigned(questions: DataFrame, scores: DataFrame, quotas: DataFrame) -> DataFrame:
    """(plan, question, section, sections) for questions (plan, question, ordinal), taken in order.

    Each goes to the section with the highest score, then most quota left,
    then first in the plan, among those with a score and quota left, and uses
    one of its quota; without any, section is null.  sections are all with a
    score, in the plan's order.  quotas has (plan, section, quota, place).  A
    plan is a batch, so bounded; its questions are one array, folded in the JVM.
    """
    options = scores.join(quotas, ["plan", "section"]).groupBy("plan", "question").agg(F.array_sort(F.collect_list(F.struct("place", "section", "score"))).alias("options"))
    none = F.array().cast(options.schema["options"].dataType)
    listed = questions.join(options, ["plan", "question"], "left").groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("ordinal", "question", F.coalesce("options", none).alias("options")))).alias("asked"))
    left = quotas.groupBy("plan").agg(F.map_from_entries(F.collect_list(F.struct("section", F.col("quota").cast("long")))).alias("quota"))
    rows = listed.join(left, "plan", "left").withColumn("quota", F.coalesce("quota", F.create_map().cast(left.schema["quota"].dataType)))
    section, question = quotas.schema["section"].dataType.simpleString(), questions.schema["question"].dataType.simpleString()
    out = f"array<struct<question:{question},section:{section},sections:array<{section}>>>"

    def step(acc: Column, q: Column) -> Column:
        left = F.filter(q["options"], lambda o: F.coalesce(acc["left"][o["section"]], F.lit(0)) > 0)
        best = F.array_max(F.transform(left, lambda o: F.struct(o["score"].alias("score"), acc["left"][o["section"]].alias("left"), (-o["place"]).alias("place"), o["section"].alias("section"))))["section"]
        done = F.array(F.struct(q["question"], best, F.transform(q["options"], lambda o: o["section"]))).cast(out)
        after = F.transform_values(acc["left"], lambda k, v: F.when(k == best, v - 1).otherwise(v))
        return F.struct(after.alias("left"), F.concat(acc["out"], done).alias("out"))

    folded = F.aggregate("asked", F.struct(F.col("quota").alias("left"), F.array().cast(out).alias("out")), step, lambda acc: acc["out"])
    return rows.select("plan", F.inline(folded))


def unique_source(matches: DataFrame) -> DataFrame:
    """Quotes that exactly one source holds, with that source."""
    return matches.groupBy("quote_id").agg(F.count("*").alias("n"), F.min("source_id").alias("source_id")).where("n = 1").drop("n")


def best_section(scores: DataFrame) -> DataFrame:
    """For each question the section with most evidence, then most quota left, then first in quota order.

    scores has (question, section, score, remaining, ordinal); sections without score or quota do not count.
    """
    best = F.max_by("section", F.struct(F.col("score"), F.col("remaining"), -F.col("ordinal")))
    return scores.where("score > 0 AND remaining > 0").groupBy("question").agg(best.alias("section"))


def zero_filled(keys: DataFrame, counts: DataFrame, key: str, n: str) -> DataFrame:
    return keys.join(counts, key, "left").fillna(0, [n])


def remaining_quota(quota: DataFrame, used: DataFrame) -> DataFrame:
    """(section, remaining) where more than none is left of quota(section, quota) after used(section)."""
    n = used.groupBy("section").agg(F.count("*").alias("used"))
    return zero_filled(quota, n, "section", "used").select("section", (F.col("quota") - F.col("used")).alias("remaining")).where("remaining > 0")


def missing_pages(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Pages of each document that no section covers, as a sorted list."""
    return expected.join(found.select("doc", "page"), ["doc", "page"], "left_anti").groupBy("doc").agg(F.array_sort(F.collect_list("page")).alias("missing"))


def last_rows(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group, or of all rows where there are no keys (a top-k, not a sort)."""
    if not keys:
        return rows.orderBy(F.col(order).desc()).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
