"""Upserts, merges, differences, samples and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with each key's last change (largest order) put in its place or added; changes: base's columns and order."""
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n", order)
    return base.join(last, keys, "left_anti").unionByName(last.select(*base.columns))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: Column) -> DataFrame:
    """Keys that were added, deleted or updated between two snapshots."""
    a, b = old.select(key, digest.alias("a")), new.select(key, digest.alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "updated")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def merged_view(generated: DataFrame, automatic: DataFrame, review: DataFrame) -> DataFrame:
    """Three stores on one key: a human state is authoritative, otherwise the shown state follows from the automatic one."""
    rows = generated.join(automatic, "key", "left").join(review, "key", "left")
    auto = F.coalesce("auto_state", "state")
    derived = F.when(auto == "resolved", "auto_resolved").when(auto.isin("review", "failed"), "review").when(~F.col("review_required"), "advisory").otherwise("pending")
    return rows.select("key", auto.alias("automatic_state"), F.coalesce("review_state", derived).alias("state"), F.trim(F.coalesce("review_text", F.lit(""))).alias("manual_text"))


def round_robin(rows: DataFrame, group: str, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows a group, taken from its strata in turn, inside a stratum in the order of a seeded hash."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    # a stratum gives n rows at most, and Spark cuts it before it shuffles
    inner = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group, stratum).orderBy(order, key))).where(F.col("turn") <= n)
    return inner.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("turn", stratum))).where(F.col("place") <= n)


def seeded_order(rows: DataFrame, key: str, seed: str, limit: int) -> DataFrame:
    """The first rows in the order of sha256(seed:key)."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.orderBy(order, key).limit(limit)


def keep_last(events: DataFrame, by: str, seq: str, n: int = 300) -> DataFrame:
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(seq)))).where(F.col("__n") <= n).drop("__n")


def id_differences(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys missing from given, and keys that given has beyond wanted."""
    missing = wanted.select(key).distinct().join(given, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(given.select(key).distinct().join(wanted, key, "left_anti").withColumn("side", F.lit("extra")))
