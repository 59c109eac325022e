"""Track profiles and display checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions import text as X


def source_quality(cues: DataFrame) -> DataFrame:
    """One row a track: counts and ratios of an English source, rounded to four places."""
    order = Window.partitionBy("track").orderBy("pos")
    dur = F.col("end_ms") - F.col("start_ms")
    rows = cues.withColumns({"norm": X.normalised(F.col("text")), "dur": dur, "in_order": (F.col("start_ms") >= F.coalesce(F.lag("start_ms").over(order), F.lit(-1))) & (dur > 0), "fragment": X.ends_in_fragment(F.col("text"))})
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    base = rows.groupBy("track").agg(
        F.count("*").alias("cues"), share(F.col("in_order")).alias("monotonic_ratio"), share(F.col("dur") <= 50).alias("micro_cue_ratio"),
        share(F.col("dur").between(200, 1000)).alias("short_cue_ratio"), share(F.col("dur") >= 10_000).alias("long_cue_ratio"), share(F.col("fragment")).alias("fragment_ratio"),
    )
    said = rows.where("norm <> ''").groupBy("track", "norm").agg(F.count("*").alias("n"))
    loops = said.groupBy("track").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.length("norm")).alias("length"), F.sum(F.when((F.col("n") >= 3) & (F.length("norm") >= 4), F.col("n")).otherwise(0)).alias("looped"))
    count = lambda pattern: F.coalesce(F.sum(F.regexp_count("text", F.lit(pattern))), F.lit(0))
    letters = cues.groupBy("track").agg(count("[A-Za-z]").alias("latin"), count(r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]").alias("other"))
    ratio = lambda c: F.round(F.coalesce(F.col(c) / F.col("total"), F.lit(0.0)), 4)
    language = F.round(F.col("latin") / F.greatest(F.col("latin") + F.col("other"), F.lit(1)), 4)
    return base.join(loops, "track", "left").join(letters, "track").select(*base.columns, ratio("kinds").alias("unique_ratio"), ratio("looped").alias("loop_ratio"), language.alias("language_ratio"), ratio("length").alias("mean_length"))


#: Which of display_checks' findings are errors; the rest are warnings.
ERRORS = ("end_not_after_start", "hangul_residue", "kana_residue", "not_increasing", "overlap", "past_the_end")


def display_checks(cues: DataFrame, video_ms: Column | None = None, allow_residue: bool = False) -> DataFrame:
    """Rows with a finding: track, pos, errors and warnings (ascending names). video_ms: length of the video, where known."""
    order = Window.partitionBy("track").orderBy("pos")
    before, reach = F.lag("start_ms").over(order), F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    dur, seen, lines = F.col("end_ms") - F.col("start_ms"), X.visible_length(text), F.split(text, r"\r\n|\r|\n")
    residue = lambda pattern: F.lit(not allow_residue) & text.rlike(pattern)
    tests = {
        "end_not_after_start": dur <= 0, "fast": (dur > 0) & (seen >= 8) & (seen / (dur / 1000) > 14), "flash": (dur > 0) & (dur < 300), "hangul_residue": residue(X.HANGUL), "kana_residue": residue(R.KANA_RESIDUE),
        "long": dur > 7000, "not_increasing": F.col("start_ms") < before, "overlap": F.col("start_ms") < reach - 250, "past_the_end": (F.col("end_ms") > video_ms + 250) if video_ms is not None else F.lit(False),
        "starts_with_punctuation": text.rlike("^[，。！？；：,.!?;:…]"), "three_lines": F.size(lines) > 2, "wide_line": F.exists(lines, lambda x: X.visible_length(x) > 22),
    }
    found = lambda kind: F.array_compact(F.array(*[F.when(tests[n], F.lit(n)) for n in sorted(tests) if (n in ERRORS) == kind]))
    return cues.select("track", "pos", found(True).alias("errors"), found(False).alias("warnings")).where(F.size("errors") + F.size("warnings") > 0)


def verdict(profile: DataFrame, compression: Column | None = None, language: str = "en", terms_seen: Column | None = None) -> DataFrame:
    """Score, reasons, usable and needs_secondary of source_quality's rows.

    compression: share of cues that semantic units save; terms_seen: share of the expected terms that the text holds, where
    any are expected.
    """
    c = F.col
    compression, terms = (F.lit(0.0) if compression is None else compression), (F.lit(1.0) if terms_seen is None else terms_seen)
    rapid = (c("short_cue_ratio") >= 0.5) & (c("mean_length") >= 4)
    marks = {"micro": c("micro_cue_ratio") >= 0.05, "fragment": c("fragment_ratio") >= 0.2, "loop": c("loop_ratio") >= 0.3, "packed": compression >= 0.5, "late": c("long_cue_ratio") >= 0.05, "foreign": c("language_ratio") < 0.45, "termless": terms == 0}
    steps = lambda col, high, most, low, some: F.when(c(col) >= high, most).when(c(col) >= low, some).otherwise(0)
    off = lambda test, points: F.when(test, points).otherwise(0)
    gained = steps("cues", 10, 20, 3, 10) + steps("language_ratio", 0.75, 35, 0.45, 20) + steps("unique_ratio", 0.45, 25, 0.25, 12) + steps("monotonic_ratio", 0.98, 20, 0.9, 10)
    lost = off(marks["micro"], 15) + off(marks["fragment"], 15) + off(rapid, 15) + off(marks["loop"], 30) + off(marks["packed"], 10) + off(marks["termless"], 10)
    score = F.greatest(gained - lost, F.lit(0))
    reasons = {
        "too_few_subtitles": c("cues") < 3, {"en": "not_english", "ja": "not_japanese", "ko": "not_korean"}[language]: marks["foreign"], "high_repetition": c("unique_ratio") < 0.25, "invalid_timeline": c("monotonic_ratio") < 0.9,
        "rolling_fragments": marks["micro"], "sentence_fragments": marks["fragment"], "rapid_short_cues": rapid, "hallucination_loop": marks["loop"], "semantic_fragmentation": marks["packed"], "title_entities_missing": marks["termless"], "timing_anomalies": marks["late"],
    }
    usable = (score >= 60) & (c("cues") >= 3) & ~marks["foreign"]
    second = usable & (marks["micro"] | marks["fragment"] | rapid | marks["packed"] | marks["termless"] | marks["late"])
    return profile.withColumns({"score": score, "reasons": F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in reasons.items()])), "usable": usable, "needs_secondary": second})


def display_metrics(cues: DataFrame, gap_ms: int = 5000) -> DataFrame:
    """Per track: overlaps with what ran before, empty intervals, long gaps."""
    order = Window.partitionBy("track").orderBy("start_ms", "end_ms", "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = cues.withColumn("reach", F.max("end_ms").over(order))
    return rows.groupBy("track").agg(F.count_if(F.col("start_ms") < F.col("reach")).alias("overlaps"), F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("empty"), F.count_if(F.col("start_ms") - F.col("reach") > gap_ms).alias("gaps"))


def density_floor(cues: DataFrame, share: float = 0.25) -> DataFrame:
    """Cues below a share of their track's median characters per minute (of positive ones)."""
    rows = cues.withColumn("cpm", X.characters_per_minute(F.col("text"), F.col("end_ms") - F.col("start_ms")))
    floors = rows.where("cpm > 0").groupBy("track").agg((F.median("cpm") * share).alias("floor"))
    return rows.join(floors, "track").where("cpm > 0 and cpm < floor").select("track", "pos", F.round("cpm", 3).alias("cpm"), F.round("floor", 3).alias("floor"))
