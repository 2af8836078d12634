"""Terms and definitions of a source: its "term: definition" lines, or else a cloze from its sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that no cloze asks for.
CLOZE_STOP = "their about which these those where before after between through should would could during patient nursing patients assessment information because describe include record observe".split()
LEAST_PAIRS = 4


def _firsts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are the first of their source with each of the keys, letters' case aside."""
    for i, k in enumerate(keys):
        rows = rows.withColumn(f"_{i}", F.row_number().over(Window.partitionBy("id", F.lower(k)).orderBy("pos")))
    return rows.where(" AND ".join(f"_{i} = 1" for i in range(len(keys)))).drop(*(f"_{i}" for i in range(len(keys))))


def facts(sources: DataFrame) -> DataFrame:
    """(id, mode, term, definition) of (id, text): mode "topic" where there are four pairs or more, else "cloze".

    A pair counts if its term has 2 to 99 characters and its definition more
    than 15; a sentence if it has more than 35 and a word of 5 letters that is
    no stop word, of which the longest, the first of equals, is the term.
    """
    line = F.filter(F.transform(F.split("text", r"\n+"), lambda x: T.trimmed(T.without_line_signs(x))), lambda x: x != "")
    lines = sources.select("id", F.posexplode(line).alias("pos", "line")).withColumn("colon", F.instr("line", ":"))
    term, rest = T.trimmed(F.expr("left(line, colon - 1)")), T.trimmed(F.expr("substring(line, colon + 1)"))
    pairs = lines.where((F.col("colon") > 2) & (F.col("colon") <= 100)).select("id", "pos", term.alias("term"), rest.alias("definition")).where(F.length("definition") > 15)
    topical = pairs.groupBy("id").count().where(F.col("count") >= LEAST_PAIRS).select("id")
    topic = _firsts(pairs.join(topical, "id", "left_semi"), "term", "definition").select("id", F.lit("topic").alias("mode"), "term", "definition")
    said = sources.join(topical, "id", "left_anti").select("id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "definition"))
    words = F.filter(F.regexp_extract_all("definition", F.lit("[a-zA-Z][a-zA-Z-]{4,}"), F.lit(0)), lambda w: ~F.lower(w).isin(CLOZE_STOP))
    longest = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    cloze = _firsts(said.withColumn("term", longest).where((F.length("definition") > 35) & (F.col("term") != "")), "term")
    return topic.unionByName(cloze.select("id", F.lit("cloze").alias("mode"), "term", "definition"))
