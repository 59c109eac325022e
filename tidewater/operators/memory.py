"""Translation memory: edits merged into entries, and entries found by their normalised source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def normalised_source(text: Column, language: Column) -> Column:
    """Single spaces, none at the ends; lower case for English."""
    tidy = stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(language == "en", F.lower(tidy)).otherwise(tidy)


def entries_of(edits: DataFrame) -> DataFrame:
    """Entries that edits make: (seq, source, previous, final, game, language, target, error_type, approve) grouped by identity.

    Edits without a source or a final text, and those that change nothing, make none. An entry shows its last edit, counts
    all of them and is approved once any of them approves; edits are summed before they move.
    """
    cut = lambda name, n: F.substring(stripped(F.col(name)), 1, n)
    game = F.coalesce(F.nullif(cut("game", 50), F.lit("")), F.lit("default"))
    norm = normalised_source(cut("source", 4000), F.col("language"))
    tidy = edits.select("seq", cut("source", 4000).alias("source"), cut("previous", 4000).alias("previous"), cut("final", 4000).alias("final"), game.alias("game"), "language", "target", F.coalesce(F.nullif(cut("error_type", 80), F.lit("")), F.lit("其他")).alias("error_type"), F.coalesce("approve", F.lit(False)).alias("approve"), norm.alias("norm"))
    real = tidy.where("norm <> '' AND final <> '' AND final <> previous")
    ident = F.substring(F.sha2(F.concat_ws("\0", "language", "target", F.lower("game"), "norm", "final"), 256), 1, 24)
    last = F.max(F.struct("seq", "source", "previous", "error_type")).alias("last")
    # the first edit names the game as it was written then
    grouped = real.withColumn("id", ident).groupBy("id", "language", "target", "norm", "final").agg(last, F.min(F.struct("seq", "game")).alias("first"), F.max("approve").alias("approved"), F.count("*").alias("seen_count"))
    return grouped.select("id", "last.source", F.col("norm").alias("source_normalized"), "last.previous", "final", "first.game", "language", "target", "last.error_type", "approved", "seen_count", F.col("first.seq").alias("created_seq"), F.col("last.seq").alias("updated_seq"))


def merge_edits(base: DataFrame, edits: DataFrame) -> DataFrame:
    """base entries with later edits in them."""
    new = entries_of(edits)
    b, n = base.alias("b"), new.alias("n")
    later = lambda name: F.coalesce(f"n.{name}", f"b.{name}").alias(name)
    first = lambda name: F.coalesce(f"b.{name}", f"n.{name}").alias(name)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return b.join(n, "id", "full").select(
        "id", later("source"), first("source_normalized"), later("previous"), first("final"), first("game"), first("language"), first("target"), later("error_type"),
        F.greatest(F.coalesce("b.approved", F.lit(False)), F.coalesce("n.approved", F.lit(False))).alias("approved"), (zero("b.seen_count") + zero("n.seen_count")).alias("seen_count"), first("created_seq"), later("updated_seq"),
    )


def approved_for(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Approved entries whose source is among sources (text, language, target, game; an empty game stands for any)."""
    wanted = sources.select(normalised_source(F.col("text"), F.col("language")).alias("source_normalized"), "language", "target", F.lower(F.coalesce("game", F.lit(""))).alias("g")).where("source_normalized <> ''").distinct()
    keys = ["source_normalized", "language", "target"]
    good = entries.where("approved")
    anywhere = good.join(wanted.where("g = ''").select(*keys), keys, "left_semi")
    in_game = good.withColumn("g", F.lower("game")).join(wanted.where("g <> ''"), [*keys, "g"], "left_semi").drop("g")
    return anywhere.unionByName(in_game).dropDuplicates(["id"])


def retained(entries: DataFrame, most: int = 5000) -> DataFrame:
    """All approved entries, and of the others the latest that still fit."""
    room = F.greatest(F.lit(0), F.lit(most) - entries.where("approved").count())
    order = Window.orderBy(F.desc("updated_seq"), "id")
    # a window over all takes `most` rows of each task at most: the group limit cuts before rows meet
    others = entries.where(~F.col("approved")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).where(F.col("__n") <= room).drop("__n")
    return entries.where("approved").unionByName(others)
