"""Questions against their plan and sources: which are kept, and why others are not.

Rules that need one question are column expressions.  Quotas and repeats
depend on what was kept before, so a batch is an ordered fold; a batch has a
bounded number of questions, and batches are independent groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import at_least

LEAST_RATIONALE, SAME_CONCEPT = 20, 0.58


def rule_reason(q: DataFrame) -> DataFrame:
    """q with the reason for which a question fails on its own, null if it does not.

    q has stem, options, correctIndex, concept, correctRationale, evidence
    and category, as the strict question model names them.
    """
    options = F.transform("options", lambda o: F.lower(F.trim(o)))
    reason = (
        F.when(F.length("stem") < 30, "stem is short")
        .when(~F.size("options").between(4, 8), "options must be 4 to 8")
        .when(F.size(F.array_distinct(options)) < F.size("options"), "options repeat")
        .when((F.col("correctIndex") < 0) | (F.col("correctIndex") >= F.size("options")), "correctIndex out of range")
        .when(F.length("concept") < 2, "concept is short")
        .when(F.length(F.trim(F.coalesce("correctRationale", F.lit("")))) < LEAST_RATIONALE, "rationale is short")
        .when(F.size("evidence") < 1, "no evidence")
    )
    return q.withColumn("reason", reason)


def judged(questions: DataFrame) -> DataFrame:
    """(batch, ordinal, kept, reason) of questions (batch, ordinal, section, quota, stem_key, concept_key, reason).

    In order: a question must have a section with quota left, no reason of
    its own, a stem not kept before, and no kept question of its concept that
    it resembles.  Kept questions use up quota; rejected ones do not.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal", kind="stable")
        left: dict[str, int] = {}
        kept: list[tuple[str, str]] = []
        out = []
        for r in rows.itertuples():
            known = isinstance(r.section, str)
            room = left.setdefault(r.section, int(r.quota)) if known else 0
            if room <= 0:
                why = "no section with quota left"
            elif isinstance(r.reason, str):
                why = r.reason
            elif any(r.stem_key == s for s, _ in kept):
                why = "stem repeats"
            elif any(r.concept_key == c and at_least(r.stem_key, s, SAME_CONCEPT) for s, c in kept):
                why = "concept repeats"
            else:
                why = None
                kept.append((r.stem_key, r.concept_key))
                left[r.section] -= 1
            out.append((r.batch, r.ordinal, why is None, why))
        return pd.DataFrame(out, columns=["batch", "ordinal", "kept", "reason"])

    kind = questions.schema["batch"].dataType.simpleString()
    return questions.select("batch", "ordinal", "section", "quota", "stem_key", "concept_key", "reason").groupBy("batch").applyInPandas(fold, f"batch {kind}, ordinal long, kept boolean, reason string")


def rejections(judgement: DataFrame, questions: DataFrame) -> DataFrame:
    """The quarantine: rejected questions with their reason, texts cut to the record's limits."""
    own = questions.drop("reason")
    return judgement.where("NOT kept").join(own, ["batch", "ordinal"]).select("batch", "ordinal", F.left("reason", F.lit(500)).alias("reason"), F.left("stem", F.lit(240)).alias("stem"), F.left("concept", F.lit(160)).alias("concept"), "section")


def hint(rejected: DataFrame, batch: int, sections: list[str], n: int = 12, replacement: bool = False) -> DataFrame:
    """The last n rejections of a batch or of its sections; in a replacement round the last of all."""
    return rejected.where(F.lit(replacement) | (F.col("batch") == batch) | F.col("section").isin(sections)).orderBy(F.col("ordinal").desc(), "batch").limit(n)
