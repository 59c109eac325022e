"""Union of two transcripts of one track: a secondary cue goes to the first primary cue that it covers best, the rest stay on their own."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as X
from . import intervals

HAN_BASIC = r"[\x{3400}-\x{9FFF}]"


def has_english(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?s)[A-Za-z].*[A-Za-z]")


def preferred(primary: Column, secondary: Column, language: str = "en") -> Column:
    """The evidence that stands for the source: for English the first that is English at all, a primary without Han before others."""
    p, s = F.trim(primary), F.trim(secondary)
    if language in ("ja", "ko"):
        return F.when(p != "", p).otherwise(s)
    return F.when((p != "") & ~p.rlike(HAN_BASIC) & has_english(p), p).when(has_english(s), s).when(has_english(p), p).otherwise(F.lit(""))


def contained_share(left: Column, right: Column) -> Column:
    """Length of the shorter over the longer where one holds the other, else 0."""
    a, b = F.length(left), F.length(right)
    return F.when(left.contains(right) | right.contains(left), F.least(a, b) / F.greatest(a, b, F.lit(1))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts (difflib's); null where either is null. No built-in function has this measure."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def conflict(left: Column, right: Column, least: float = 0.78) -> Column:
    """Two English wordings that are neither equal nor nearly contained in one another nor similar, once normalised."""
    a, b = X.normalised(left), X.normalised(right)
    unlike = (a != "") & (b != "") & (a != b) & (contained_share(a, b) < 0.72)
    # the rest never reaches the measure: nulls go to Python in its place
    return unlike & (similarity(F.when(unlike, a), F.when(unlike, b)) < least)


def build(primary: DataFrame, secondary: DataFrame, least: float = 0.5) -> DataFrame:
    """English union of (track, pos, start_ms, end_ms, text): track, pos, side, start_ms, end_ms, primary_evidence, secondary_evidence, secondary_coverage, flags.

    A primary cue's best secondary cue is taken if it covers enough of it and no earlier primary cue has taken it. A secondary
    cue that nobody took is left out where a primary cue within two seconds says the same.
    """
    best = intervals.best_matches(primary.select("track", "pos", "start_ms", "end_ms"), secondary.select("track", "pos", "start_ms", "end_ms")).select("track", "pos", "match_pos", "ratio")
    first = Window.partitionBy("track", "match_pos").orderBy("pos")
    taken = best.where(F.col("ratio") >= least).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    s = secondary.select("track", F.col("pos").alias("match_pos"), F.col("text").alias("secondary_evidence"))
    joined = primary.join(best.select("track", "pos", F.col("ratio").alias("seen")), ["track", "pos"]).join(taken.join(s, ["track", "match_pos"]), ["track", "pos"], "left")
    heard = F.coalesce("secondary_evidence", F.lit(""))
    flags = F.array_compact(F.array(
        F.when(F.col("match_pos").isNull(), "whisper_missing").when(conflict(F.col("text"), heard), "text_conflict"), F.when(~has_english(F.col("text")) & has_english(heard), "secondary_english_preferred"),
    ))
    own = joined.select("track", "pos", F.lit("primary").alias("side"), "start_ms", "end_ms", F.col("text").alias("primary_evidence"), heard.alias("secondary_evidence"), F.coalesce("seen", F.lit(0.0)).alias("secondary_coverage"), flags.alias("flags"))
    norm = X.normalised(F.col("text")).alias("norm")
    loose = secondary.join(taken.select("track", F.col("match_pos").alias("pos")), ["track", "pos"], "left_anti")
    alone = intervals.without_near_duplicates(loose.withColumn("norm", norm), primary.select("track", norm, "start_ms", "end_ms"))
    return own.unionByName(alone.select("track", "pos", F.lit("secondary").alias("side"), "start_ms", "end_ms", F.lit("").alias("primary_evidence"), F.col("text").alias("secondary_evidence"), F.lit(1.0).alias("secondary_coverage"), F.array(F.lit("capcut_missing")).alias("flags")))


def merge_evidence(primary: Column, secondary: Column, text: Column) -> Column:
    """Struct of both evidences once a text joins them: a longer one becomes primary, what the secondary doesn't hold yet is added to it."""
    p, s, t = F.trim(primary), F.trim(secondary), F.trim(text)
    longer = F.length(t) > F.length(p)
    less = F.when(longer, p).otherwise(t)
    return F.when(t == "", F.struct(primary.alias("primary"), secondary.alias("secondary"))).otherwise(
        F.struct(F.when(longer, t).otherwise(primary).alias("primary"), F.when((less != "") & ~s.contains(less), F.trim(F.concat_ws(" ", s, less))).otherwise(secondary).alias("secondary")))


def nested(union: DataFrame) -> DataFrame:
    """union with parent, the order of the first cue of its track that spans it (its own where none does), and order: place by start, end and pos.

    A cue within another's child is within that other one too, so the first cue that reaches as far is never a child itself.
    """
    order = Window.partitionBy("track").orderBy("start_ms", "end_ms", "side", "pos")
    placed = union.withColumn("order", F.row_number().over(order))
    a = placed.select("track", F.col("order").alias("pos"), "start_ms", "end_ms")
    spans = intervals.interval_join(a, a).where("l_start_ms <= r_start_ms and l_end_ms >= r_end_ms and l_pos < r_pos")
    parent = spans.groupBy("track", F.col("r_pos").alias("order")).agg(F.min("l_pos").alias("parent"))
    return placed.join(parent, ["track", "order"], "left").withColumn("parent", F.coalesce("parent", "order"))


def merged(union: DataFrame) -> DataFrame:
    """One row per cue that none spans, with the evidence of the cues that it spans joined to its own in their order."""
    rows = nested(union)
    said = F.when(F.trim("primary_evidence") != "", F.trim("primary_evidence")).otherwise(F.trim("secondary_evidence"))
    inner = rows.where("parent < order").select("track", F.col("parent").alias("order"), F.struct("order", said.alias("said"), F.trim("secondary_evidence").alias("more")).alias("inner")).where("inner.said <> ''")
    inside = inner.groupBy("track", "order").agg(F.array_sort(F.collect_list("inner")).alias("inside"))

    def step(acc: Column, cue: Column) -> Column:
        both = merge_evidence(acc["primary"], acc["secondary"], cue["said"])
        more = (cue["more"] != "") & ~both["secondary"].contains(cue["more"]) & (cue["more"] != both["primary"])
        return F.struct(both["primary"].alias("primary"), F.when(more, F.trim(F.concat_ws(" ", both["secondary"], cue["more"]))).otherwise(both["secondary"]).alias("secondary"))

    start = F.struct(F.col("primary_evidence").alias("primary"), F.col("secondary_evidence").alias("secondary"))
    kept = rows.where("parent = order").join(inside, ["track", "order"], "left")
    both = F.when(F.col("inside").isNull(), start).otherwise(F.aggregate("inside", start, step))
    return kept.withColumn("both", both).select("track", "pos", "side", "start_ms", "end_ms", F.col("both.primary").alias("primary_evidence"), F.col("both.secondary").alias("secondary_evidence"), "secondary_coverage", "flags")
