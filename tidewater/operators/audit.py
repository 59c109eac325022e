"""Audits and comparisons of evidence stores: overlaps, leaks, conflicts, costs and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of (track, pos, start_ms, end_ms) where an interval of inner lies within one of outer, itself excluded."""
    within = (F.col("r_start_ms") >= F.col("l_start_ms")) & (F.col("r_end_ms") <= F.col("l_end_ms")) & (F.col("l_pos") != F.col("r_pos"))
    return interval_join(outer, inner).where(within).select("track", F.col("l_pos").alias("pos"), F.col("r_pos").alias("inner_pos"))


def adjacent_repeats(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """Rows whose value isn't blank and equals that of the row before."""
    before = F.lag("__v").over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("__v", value).withColumn("__b", before).where("__v <> '' AND __v = __b").drop("__v", "__b")


def closest_by_tokens(queries: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """For each query the k entries of memory that share most tokens: shared tokens over the larger set, ties to smaller ids.

    Both have id and tokens (array). Only pairs that share a token meet.
    """
    def spread(df: DataFrame, p: str) -> DataFrame:
        own = df.select(F.col("id").alias(f"{p}_id"), F.array_distinct("tokens").alias("t"))
        return own.select(f"{p}_id", F.size("t").alias(f"{p}_size"), F.explode("t").alias("token"))

    shared = spread(queries, "query").join(spread(memory, "entry"), "token").groupBy("query_id", "entry_id", "query_size", "entry_size").agg(F.count("*").alias("shared"))
    scored = shared.select("query_id", "entry_id", (F.col("shared") / F.greatest("query_size", "entry_size")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def conflicts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that repeat: rows, distinct values, and whether the values disagree. Two levels, so one hot key is summed before it moves."""
    by_value = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    groups = by_value.groupBy(*keys).agg(F.sum("n").alias("entries"), F.count(value).alias("values"))
    return groups.where("entries > 1").withColumn("conflict", F.col("values") > 1)


def leaks(held_out: DataFrame, memory: DataFrame, text: Column) -> DataFrame:
    """Counts of entries of memory with the text of a held-out item, by normalised text."""
    items = held_out.select(text.alias("norm")).where("norm <> ''").distinct()
    return memory.select(text.alias("norm")).groupBy("norm").agg(F.count("*").alias("entries")).join(items, "norm")


def unknown_tokens(rows: DataFrame, row_id: list[str], tokens: Column, known: DataFrame, least: int) -> DataFrame:
    """Tokens in at least `least` rows that aren't in known (column token)."""
    seen = rows.select(*row_id, F.explode(F.array_distinct(tokens)).alias("token"))
    return seen.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(known, "token", "left_anti")


def priced(usage: DataFrame, rates: DataFrame, model: str, sent: str, got: str) -> DataFrame:
    """Cost of usage at rates (model, rate_in, rate_out) a million; null, and estimable false, where the model has no rate."""
    cost = (F.col(sent) * F.col("rate_in") + F.col(got) * F.col("rate_out")) / 1_000_000
    return usage.join(rates.withColumnRenamed("model", model), model, "left").withColumn("cost", cost).withColumn("estimable", F.col("rate_in").isNotNull()).drop("rate_in", "rate_out")


def regressions(baseline: DataFrame, candidate: DataFrame, key: str, metric: str, *, higher_is_better: bool = True) -> DataFrame:
    """Per key both values of a metric and the outcome: regressed, improved, same, unobservable (was there, is null) or new."""
    a, b = baseline.select(key, F.col(metric).alias("baseline")), candidate.select(key, F.col(metric).alias("candidate"))
    gain = F.col("candidate") - F.col("baseline") if higher_is_better else F.col("baseline") - F.col("candidate")
    outcome = F.when(F.col("baseline").isNull() & F.col("candidate").isNotNull(), "new").when(F.col("candidate").isNull() & F.col("baseline").isNotNull(), "unobservable").when(gain < 0, "regressed").when(gain > 0, "improved").otherwise("same")
    return a.join(b, key, "full").withColumn("outcome", outcome)
