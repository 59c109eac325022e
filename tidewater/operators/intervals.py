"""Joins and groupings of time intervals by track.

Interval joins are equi-joins on (track, time bucket): an interval is spread over the buckets it touches, and a pair
counts in the later of its two first buckets alone, so nothing is emitted twice and no track is compared with itself whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import coverage, distance_ms, overlap_ms


def interval_join(left: DataFrame, right: DataFrame, bucket_ms: int = 30_000) -> DataFrame:
    """Overlapping pairs of (track, pos, start_ms, end_ms): columns with prefixes l_ and r_, and track."""
    def spread(df: DataFrame, p: str) -> DataFrame:
        named = df.select("track", *[F.col(c).alias(p + c) for c in df.columns if c != "track"])
        low, high = F.floor(F.col(f"{p}start_ms") / bucket_ms), F.floor(F.greatest(F.col(f"{p}start_ms"), F.col(f"{p}end_ms") - 1) / bucket_ms)
        return named.withColumn("bucket", F.explode(F.sequence(low, high))).withColumn(f"{p}first", low)

    pairs = spread(left, "l_").join(spread(right, "r_"), ["track", "bucket"])
    meets = (F.col("l_start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("l_end_ms"))
    return pairs.where(meets & (F.col("bucket") == F.greatest("l_first", "r_first"))).drop("bucket", "l_first", "r_first")


def best_matches(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each target the candidate that covers most of it; ties go to the larger overlap, then the earlier candidate. Unmatched targets keep nulls."""
    t, c = (F.col("l_start_ms"), F.col("l_end_ms")), (F.col("r_start_ms"), F.col("r_end_ms"))
    ratio, over = coverage(*t, *c), overlap_ms(*t, *c)
    scored = interval_join(targets, candidates).select("track", F.col("l_pos").alias("pos"), F.struct(ratio.alias("ratio"), over.alias("overlap"), (-F.col("r_start_ms")).alias("s"), (-F.col("r_end_ms")).alias("e"), (-F.col("r_pos")).alias("p")).alias("m"))
    best = scored.groupBy("track", "pos").agg(F.max("m").alias("m")).select("track", "pos", (-F.col("m.p")).alias("match_pos"), "m.ratio", F.col("m.overlap").alias("overlap_ms"))
    return targets.select("track", "pos").join(best, ["track", "pos"], "left")


def islands(df: DataFrame, gap_ms: int, by: str = "track") -> DataFrame:
    """Numbers runs of intervals that start no later than gap_ms after all before them ended: column island."""
    before = Window.partitionBy(by).orderBy("start_ms", "end_ms", "pos")
    reach = F.max("end_ms").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_ms") > reach + gap_ms), 1).otherwise(0)
    return df.withColumn("opens", opens).withColumn("island", F.sum("opens").over(before)).drop("opens")


def gap_runs(df: DataFrame, gap_ms: int, by: str = "track") -> DataFrame:
    """Numbers runs in the order of pos in which each interval starts at most gap_ms after the one before it ended: column island."""
    before = Window.partitionBy(by).orderBy("pos")
    opens = F.when(F.col("start_ms") - F.lag("end_ms").over(before) <= gap_ms, 0).otherwise(1)
    return df.withColumn("opens", opens).withColumn("island", F.sum("opens").over(before)).drop("opens")


def dominant_run(df: DataFrame, gap_ms: int = 2500) -> DataFrame:
    """Each track's run of most cues, of several the shortest in time, then the first."""
    runs = gap_runs(df, gap_ms).groupBy("track", "island").agg(F.count("*").alias("n"), (F.max_by("end_ms", "pos") - F.min_by("start_ms", "pos")).alias("span"))
    best = runs.groupBy("track").agg(F.max(F.struct("n", (-F.col("span")).alias("s"), (-F.col("island")).alias("i"))).alias("b"))
    return best.select("track", (-F.col("b.i")).alias("island"), F.col("b.n").alias("cues"), (-F.col("b.s")).alias("span"))


def audio_windows(risks: DataFrame, padding_ms: int = 1500, merge_gap_ms: int = 1000) -> DataFrame:
    """Padded and merged windows: track, island, start_ms, end_ms, cues."""
    padded = risks.withColumns({"start_ms": F.greatest(F.lit(0), F.col("start_ms") - padding_ms), "end_ms": F.col("end_ms") + padding_ms})
    return islands(padded, merge_gap_ms).groupBy("track", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("cues"))


def combined_coverage(targets: DataFrame, references: DataFrame) -> DataFrame:
    """Share of each target that the union of all references covers: clip, merge islands, sum."""
    pairs = interval_join(targets, references)
    clipped = pairs.select("track", F.col("l_pos").alias("target"), F.col("r_pos").alias("pos"), F.greatest("l_start_ms", "r_start_ms").alias("start_ms"), F.least("l_end_ms", "r_end_ms").alias("end_ms"))
    keyed = clipped.withColumn("owner", F.struct("track", "target"))
    covered = islands(keyed, 0, "owner").groupBy("track", "target", "island").agg((F.max("end_ms") - F.min("start_ms")).alias("ms")).groupBy("track", F.col("target").alias("pos")).agg(F.sum("ms").alias("ms"))
    return targets.join(covered, ["track", "pos"], "left").select("track", "pos", F.when(F.col("end_ms") > F.col("start_ms"), F.coalesce("ms", F.lit(0)) / (F.col("end_ms") - F.col("start_ms"))).otherwise(F.lit(0.0)).alias("covered"))


def without_near_duplicates(secondary: DataFrame, primary: DataFrame, within_ms: int = 2000) -> DataFrame:
    """Secondary rows (track, pos, start_ms, end_ms, norm) with no primary row of equal norm at most within_ms away; an empty norm equals none."""
    p = primary.select(F.col("track").alias("p_track"), F.col("norm").alias("p_norm"), F.col("start_ms").alias("p_start"), F.col("end_ms").alias("p_end"))
    near = (F.col("track") == F.col("p_track")) & (F.col("norm") == F.col("p_norm")) & (F.col("norm") != "") & (distance_ms(F.col("start_ms"), F.col("end_ms"), F.col("p_start"), F.col("p_end")) <= within_ms)
    return secondary.join(p, near, "left_anti")


def timed_tokens(cues: DataFrame) -> DataFrame:
    """(track, pos, start_ms, end_ms, text) to a row a word: its place n and its share of the cue's time, 120 to 800 ms a word."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))
    rows = cues.withColumn("w", words).where(F.size("w") > 0)
    count = F.size("w")
    raw = F.greatest(F.col("end_ms") - F.col("start_ms"), count)
    length = F.greatest(count * 120, F.least(raw, F.greatest(F.lit(800), count * 800)))
    spread = rows.select("track", "pos", "start_ms", length.alias("length"), count.alias("count"), F.posexplode("w").alias("n", "word"))
    at = lambda k: F.col("start_ms") + F.bround(F.col("length") * k / F.col("count"), 0).cast("long")
    return spread.select("track", "pos", "n", "word", at(F.col("n")).alias("start_ms"), at(F.col("n") + 1).alias("end_ms"))


def apply_timing(cues: DataFrame, reference: DataFrame, aligned: DataFrame) -> DataFrame:
    """cues at the time that the aligned cues take whose originals in reference (same pos) they overlap; others keep their own."""
    moved = aligned.select("track", "pos", F.col("start_ms").alias("to_start"), F.col("end_ms").alias("to_end"))
    pairs = interval_join(cues.select("track", "pos", "start_ms", "end_ms"), reference.select("track", "pos", "start_ms", "end_ms").join(moved, ["track", "pos"]))
    spans = pairs.groupBy("track", F.col("l_pos").alias("pos")).agg(F.min("r_to_start").alias("s"), F.max("r_to_end").alias("e"))
    return cues.join(spans, ["track", "pos"], "left").withColumns({"start_ms": F.coalesce("s", "start_ms"), "end_ms": F.coalesce("e", "end_ms")}).drop("s", "e")


def remapped(cues: DataFrame, offset_ms: int) -> DataFrame:
    """cues of a cut-out moved to where it stood, numbered anew from 1 in their order: column id."""
    order = Window.partitionBy("track").orderBy("pos")
    return cues.withColumns({"start_ms": F.col("start_ms") + offset_ms, "end_ms": F.col("end_ms") + offset_ms, "id": F.row_number().over(order)})
