"""Mixing by iterative proportional fitting, with DataFrame operations only.

Token counts are summed into cells of source, language and topic.  Raking
multiplies the cells' weights so that their sums match the target shares of
one dimension after the other, until all three agree.  A document is then
kept with a probability in proportion to its cell's weight for each token,
calibrated so that the expected tokens are a given share of all; a hash of
id and text decides, so a rerun decides alike and a copy of a row like the row.

Marginals are partial aggregations joined back to cells, so a hot source or
language is no hot spot, and nothing but single numbers reaches the driver.
Spark broadcasts the cells to the documents only where it has measured them
to be below its threshold, and otherwise joins with skew handling.

Null source, language or topic is a value of its own.  A null or empty text
has no token; it is kept as its cell is.  A cell without tokens keeps its
weight of 1.  With no topic column the topic is the form of the text, see
`form`.  An empty table gives no rows.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import removed, written

DIMS = ("source", "lang", "topic")
_NONE = "\0none"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form(text: Column) -> Column:
    """A topic where none is given: what the text looks like by its size, lines and signs."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    lines = size - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    signs = size - F.length(F.translate(t, "0123456789|#*$%&<>{}!", "x"))
    return F.when(size < 200, "note").when(signs * 20 > size, "signs").when(size < lines * 80, "lines").when(size < 2000, "article").when(size < 8000, "essay").otherwise("book")


def featured(docs: DataFrame, source_col: str, lang_col: str, text_col: str, topic_col: str | None) -> list[Column]:
    """The cell keys and the tokens of a row."""
    text = F.col(text_col).cast("string")
    topic = F.col(topic_col).cast("string") if topic_col else form(text)
    keys = zip(DIMS, (F.col(source_col), F.col(lang_col), topic), strict=True)
    return [*(F.coalesce(c.cast("string"), F.lit(_NONE)).alias(d) for d, c in keys), n_tokens(text).alias("tokens")]


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): shares of the tokens raised to a power below 1, which lifts what is rare, summing to 1."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("part"))
    whole = sums.agg(F.sum("part")).first()[0] or 1.0
    return sums.select(dim, (F.col("part") / F.lit(whole)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-4, stalled: float = 0.9) -> DataFrame:
    """cells (source, lang, topic, tokens) with weights w whose marginals match the targets.

    A weight is a cell's tokens times a factor of each of its values.  A step takes one dimension: the cells' sums
    under the other two factors say what its own must be, and that small table is written; so a step is two joins
    and an aggregation, however many went before.
    targets has for each dimension a table (dim, target) of shares; values without a target get weight 0.
    Cells of zero tokens stay at 0.  Sweeps go on until every marginal is within the relative tolerance.  Where cells
    are missing, no weights may meet all targets: once two sweeps leave more than the part `stalled` of the worst
    deviation they end, and the weights meet the last dimension.  Column off is the worst deviation; see `met`.  Targets
    that are met more slowly than that need a higher `stalled`.
    """
    factors = {d: written(targets[d].select(d, "target", F.lit(1.0).alias("f")), "raking") for d in DIMS}

    def sums(dim: str) -> DataFrame:
        some, w = cells, F.col("tokens").cast("double")
        for d in DIMS:
            if d != dim:
                some, w = some.join(factors[d].select(d, F.col("f").alias(f"f_{d}")), d), w * F.col(f"f_{d}")
        return some.groupBy(dim).agg(F.sum(w).alias("sum"))

    last = float("inf")
    while True:
        for d in DIMS * 2:
            own = factors[d].join(sums(d), d, "left").select(d, "target", F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias("f"))
            old, factors[d] = factors[d], written(own, "raking")
            removed(old)
        off = [factors[d].join(sums(d), d).where("target > 0").select(F.abs(F.col("sum") * F.col("f") / F.col("target") - 1).alias("off")) for d in DIMS[:-1]]
        worst = off[0].unionByName(off[1]).agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance or worst > stalled * last:
            break
        last = worst
    w, out = F.col("tokens").cast("double"), cells
    for d in DIMS:
        out, w = out.join(factors[d].select(d, F.col("f").alias(f"f_{d}")), d, "left"), w * F.coalesce(f"f_{d}", F.lit(0.0))
    return out.select(*cells.columns, w.alias("w"), F.lit(float(worst or 0.0)).alias("off"))


def met(cells: DataFrame, most_off: float = 0.01) -> bool:
    """Whether the raked cells' marginals are within the share most_off of their targets; a warning where they are not."""
    off = (cells.select("off").first() or [0.0])[0]
    if off > most_off:
        warnings.warn(f"no weights of these cells meet all targets: a marginal is off by {off:.3f} of its target", stacklevel=2)
    return off <= most_off


def calibrated(cells: DataFrame, share: float) -> DataFrame:
    """cells with p: least(1, rate * w / tokens), with the rate at which the expected tokens are the share of all."""
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(None))
    cells = cells.withColumn("ratio", ratio)
    edge = cells.agg(F.min(F.when(F.col("ratio") > 0, F.col("ratio"))).alias("lo"), F.max("ratio").alias("hi"), F.sum("tokens").alias("all")).first()
    if not edge["all"] or not edge["hi"]:
        return cells.withColumn("p", F.lit(share))
    low, high = 1e-3 * share / edge["hi"], 1 / edge["lo"]
    for _ in range(4):  # each round of 64 rates in one aggregation narrows the range to one step
        rates = [low * (high / low) ** (i / 63) for i in range(64)]
        got = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), r * F.coalesce("ratio", F.lit(0.0)))).alias(f"r{i}") for i, r in enumerate(rates)]).first()
        at = next((i for i in range(64) if got[i] >= share * edge["all"]), 63)
        low, high = rates[max(0, at - 1)], rates[at]
    return cells.withColumn("p", F.least(F.lit(1.0), F.lit(high) * F.coalesce("ratio", F.lit(1.0 / high))))


def mixing(docs: DataFrame, share: float = 0.8, power: float = 0.7, targets: dict[str, DataFrame] | None = None, source_col: str = "source", lang_col: str = "lang", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """The cells of docs with tokens, docs, w and p; keys are source, lang and topic."""
    own = docs.select(*featured(docs, source_col, lang_col, text_col, topic_col))
    cells = written(own.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    goal = {d: tempered(cells, d, power) for d in DIMS} | (targets or {})
    return written(calibrated(rake(cells, goal), share), "cells-raked")


def chosen(docs: DataFrame, cells: DataFrame, id_col: str = "doc_id", seed: str = "mix", source_col: str = "source", lang_col: str = "lang", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """(row, source, lang, topic, tokens, ratio, p, off, selected) for each row of docs, which is the struct `row` with all its columns.

    Rows without an id are drawn by their text alone.
    """
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(whole.alias("row"), *featured(docs, source_col, lang_col, text_col, topic_col), draw.alias("draw"))
    return keyed.join(cells.select(*DIMS, "ratio", "p", "off"), list(DIMS)).withColumn("selected", F.col("draw") < F.col("p"))


def sampled(docs: DataFrame, share: float = 0.8, power: float = 0.7) -> DataFrame:
    """The rows of docs that the mix selects, with docs' own columns; where no weights meet the targets a warning says so."""
    cells = mixing(docs, share, power)
    met(cells)
    return chosen(docs, cells).where("selected").select("row.*")


def op9_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    found = chosen(docs, mixing(docs))
    return found.select("row.doc_id", "row.source", "row.lang", "topic", F.col("tokens").alias("n_tokens"), F.col("ratio").alias("weight"), F.col("p").alias("probability"), "selected", "off")
