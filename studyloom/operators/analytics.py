"""Practice history and pipeline telemetry as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..session import written

WEEKLY_GOAL = 30


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(100 * part / whole).cast("long"))


def accuracy(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers and the share that is correct, in per cent with halves up; null without answers."""
    n, right = F.count("correct"), F.count_if("correct")
    return answers.groupBy(*keys).agg(n.alias("answers"), percent(right, n).alias("accuracy"))


def score(answers: Column) -> Column:
    """An attempt's score from its own array of answers."""
    return percent(F.size(F.filter(answers, lambda a: a["correct"])), F.size(answers))


def rolling(attempts: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Answers within the last days, not counting the moment exactly that long ago."""
    return attempts.where(F.col("ts") > now - F.make_interval(days=F.lit(days))).agg(F.coalesce(F.sum("answers"), F.lit(0)).alias("answers"))


def daily(attempts: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """(day, answers) for each of the last days, 0 where there was none."""
    calendar = attempts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    sums = attempts.groupBy(F.to_date("ts").alias("day")).agg(F.sum("answers").alias("answers"))
    return calendar.join(sums, "day", "left").fillna(0, ["answers"])


def weekly_goal(done: Column, goal: int = WEEKLY_GOAL) -> tuple[Column, Column]:
    """Progress from 0 to 1, and what is left."""
    return F.least(done / goal, F.lit(1.0)), F.greatest(F.lit(goal) - done, F.lit(0))


def attempts_of(modules: DataFrame, attempts: DataFrame) -> DataFrame:
    """(module_id, attempt) where an attempt names the module alone or in its list; each pair once."""
    each = F.array_distinct(F.concat(F.coalesce("moduleIds", F.array().cast("array<string>")), F.when(F.col("moduleId").isNotNull(), F.array("moduleId")).otherwise(F.array().cast("array<string>"))))
    named = attempts.select("attempt", F.explode(each).alias("module_id"))
    return named.join(modules.select(F.col("id").alias("module_id")), "module_id", "left_semi").distinct()


def latest(attempts: DataFrame, n: int) -> DataFrame:
    return attempts.orderBy(F.col("ts").desc(), F.col("attempt").desc()).limit(n)


def batches(calls: DataFrame) -> DataFrame:
    """Each batch of provider calls: time from first start to last end, requests, and what was asked and came back in order."""
    listed = F.array_sort(F.collect_list(F.struct("request_number", "requested_questions", "status")))
    out = calls.groupBy("batch_index").agg(F.bround(F.max("finished_seconds") - F.min("started_seconds"), 3).alias("elapsed_seconds"), F.count("*").alias("provider_requests"), listed.alias("r"))
    return out.select("batch_index", "elapsed_seconds", "provider_requests", F.array_join(F.transform("r.requested_questions", lambda x: x.cast("string")), ",").alias("requested"), F.array_join("r.status", ",").alias("statuses"))


def call_counts(calls: DataFrame) -> DataFrame:
    """Totals over all calls: retries, failures by kind and replacements."""
    attempt = F.coalesce("generation_attempt", F.lit(1))
    return calls.agg(
        F.count("*").alias("requests"),
        F.count_if(F.coalesce("schema_attempt", F.lit(1)) > 1).alias("schema_retries"),
        F.count_if(F.col("status") == "incomplete_json").alias("incomplete_json"),
        F.count_if(F.col("status") == "schema_validation_error").alias("schema_errors"),
        F.count_if("replacement").alias("replacements"),
        F.count_distinct(F.when(attempt > 1, F.struct("batch_index", attempt))).alias("batch_retries"),
    )


def token_sums(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of tokens; null unless any call tells input or output tokens."""
    told = F.bool_or(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull())
    return calls.groupBy(*keys).agg(*[F.when(told, F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


def prefix_sums(points: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, order, value) with `total`, the sum of value up to and with each point of its group, in order.

    Points of one group and place are added up first.  The rest is dealt out
    by ranges of (keys, order); each range is summed by itself, the sums of
    whole ranges (one row for each range and each group in it) give what comes
    before a range, and the two are added.  No task holds more than a range,
    with or without keys.
    """
    own = points.groupBy(*keys, order).agg(F.sum(value).alias(value))
    ranged = written(own.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "prefix-ranges")
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    mine = ranged.withColumn("_own", F.sum(value).over(within)).alias("r")
    met = mine.join(before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_range"]])
    return met.select(*[F.col(f"r.{c}") for c in [*keys, order, value]], (F.col("_own") + F.col("_before")).alias("total"))


def concurrency(calls: DataFrame, keys: list[str]) -> DataFrame:
    """The most calls open at once, over each group or over all calls; at equal times ends come before starts.

    A start adds one and an end takes one away, and the most is that of the
    running sums.  A call without a start does not count, one without an end
    stays open; no calls give no rows, or a null without keys.
    """
    ends = calls.where("started_seconds IS NOT NULL").select(*keys, F.explode(F.array(F.struct(F.col("started_seconds").alias("t"), F.lit(1).alias("d")), F.struct(F.col("finished_seconds").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.t", "e.d")
    return prefix_sums(ends.where("t IS NOT NULL"), keys, "t", "d").groupBy(*keys).agg(F.max("total").alias("max_concurrency"))
