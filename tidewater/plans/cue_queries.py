"""Queries over cues made of `conversations`: a conversation is a track, a turn is a cue, times follow from ids and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions import text as X
from ..functions import timecode as T
from ..operators import intervals, quality, sets
from ..sources import srt

SEED = "tidewater"

CUES = """
WITH cues AS (
  SELECT conv_id AS track, turn AS pos, role, text AS raw, replace(coalesce(text, ''), chr(10), ' ') AS text,
         turn * 4000 + (conv_id * 37 + turn * 613) % 1700 AS start_ms,
         turn * 4000 + (conv_id * 37 + turn * 613) % 1700 + (length(coalesce(text, '')) * 45 + turn * 97) % 12000 AS end_ms
  FROM conversations),
other AS (
  SELECT track, pos, text, greatest(0, start_ms - 450 + (track * 13 + pos * 71) % 900) AS start_ms, end_ms + (pos * 53) % 600 AS end_ms FROM cues)
"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    start = F.col("turn") * 4000 + (F.col("conv_id") * 37 + F.col("turn") * 613) % 1700
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    end = start + (F.length(F.coalesce("text", F.lit(""))) * 45 + F.col("turn") * 97) % 12000
    return c.select(F.col("conv_id").alias("track"), F.col("turn").alias("pos"), "role", text.alias("text"), start.alias("start_ms"), end.alias("end_ms"))


def second_track(rows: DataFrame) -> DataFrame:
    start = F.greatest(F.lit(0), F.col("start_ms") - 450 + (F.col("track") * 13 + F.col("pos") * 71) % 900)
    return rows.select("track", "pos", "text", start.alias("start_ms"), (F.col("end_ms") + (F.col("pos") * 53) % 600).alias("end_ms"))


def cue_stamps(spark, sf_dir):
    s, e = T.ms_to_stamp(F.col("start_ms")), T.ms_to_stamp(F.col("end_ms"))
    return cues(spark, sf_dir).select("track", "pos", s.alias("start_stamp"), e.alias("end_stamp"), T.stamp_to_ms(s).alias("start_ms"))


def srt_round_trip(spark, sf_dir):
    rows = cues(spark, sf_dir).withColumn("id", F.col("pos").cast("int"))
    return srt.parse_blocks(srt.blocks(rows)).select("track", "id", "start_ms", "end_ms", F.trim("text").alias("text"))


def cue_best_matches(spark, sf_dir):
    rows = cues(spark, sf_dir)
    one = rows.select("track", "pos", "start_ms", "end_ms")
    return intervals.best_matches(one, second_track(rows).drop("text")).select("track", "pos", "match_pos", F.round("ratio", 6).alias("ratio"), "overlap_ms")


def cue_combined_coverage(spark, sf_dir):
    rows = cues(spark, sf_dir)
    return intervals.combined_coverage(rows.select("track", "pos", "start_ms", "end_ms"), second_track(rows).drop("text")).withColumn("covered", F.round("covered", 6))


def cue_near_duplicate_anti_join(spark, sf_dir):
    rows = cues(spark, sf_dir)
    norm = X.normalised(F.col("text")).alias("norm")
    # every third cue of the second track lies further off
    shifted = second_track(rows).withColumns({c: F.col(c) + F.when(F.col("pos") % 3 == 0, 60_000).otherwise(0) for c in ("start_ms", "end_ms")})
    primary = rows.select("track", norm, "start_ms", "end_ms")
    return intervals.without_near_duplicates(shifted.select("track", "pos", norm, "start_ms", "end_ms"), primary).select("track", "pos")


def audio_windows(spark, sf_dir):
    return intervals.audio_windows(cues(spark, sf_dir).select("track", "pos", "start_ms", "end_ms"))


def timing_clusters(spark, sf_dir):
    return intervals.dominant_run(cues(spark, sf_dir).select("track", "pos", "start_ms", "end_ms"))


def source_quality(spark, sf_dir):
    return quality.source_quality(cues(spark, sf_dir))


def source_verdict(spark, sf_dir):
    return quality.verdict(quality.source_quality(cues(spark, sf_dir))).select("track", "language_ratio", "mean_length", "score", F.array_join("reasons", ",").alias("reasons"), "usable", "needs_secondary")


#: Texts as they are shown, with defects at fixed positions.
SHOWN = "CASE WHEN pos % 7 = 0 THEN concat('，', text) WHEN pos % 7 = 1 THEN concat('a', chr(10), 'b', chr(10), text) WHEN pos % 7 = 2 THEN 'です' WHEN pos % 7 = 3 THEN '네 그래' WHEN pos % 7 = 4 THEN ' 好 ' ELSE text END"


def display_checks(spark, sf_dir):
    shown = cues(spark, sf_dir).withColumn("text", F.expr(SHOWN.replace("chr(10)", "char(10)")))
    return quality.display_checks(shown, F.lit(20_000)).select("track", "pos", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def display_metrics(spark, sf_dir):
    return quality.display_metrics(cues(spark, sf_dir))


def density_floor(spark, sf_dir):
    return quality.density_floor(cues(spark, sf_dir)).select("track", "pos", "cpm", "floor")


def cue_neighbours(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("track").orderBy("pos")
    return cues(spark, sf_dir).select("track", F.row_number().over(w).alias("id"), F.lag("text", 1, "").over(w).alias("before"), F.lead("text", 1, "").over(w).alias("after"))


def cue_context(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("track").orderBy("pos").rowsBetween(-6, 6)
    return cues(spark, sf_dir).select("track", "pos", F.count("*").over(w).alias("cues"), F.sum(X.visible_length(F.col("text"))).over(w).alias("visible"))


def cue_predicates(spark, sf_dir):
    t = F.col("text")
    return cues(spark, sf_dir).select("track", "pos", X.cue_class(t).alias("class"), X.has_han(t).alias("han"), X.has_kana(t).alias("kana"), X.has_hangul(t).alias("hangul"), X.is_sfx_only(t).alias("sfx"), X.ends_in_fragment(t).alias("fragment"))


def cue_numbers(spark, sf_dir):
    return cues(spark, sf_dir).select("track", "pos", F.array_join(R.number_set(F.col("text")), "|").alias("numbers"), X.visible_length(F.col("text")).alias("visible"), F.size(X.words(F.col("text"))).alias("words"))


def cue_normalised(spark, sf_dir):
    return cues(spark, sf_dir).select("track", "pos", X.normalised(F.col("text")).alias("norm"), X.strip_marks(F.col("text")).alias("stripped"))


def spot_checks(spark, sf_dir):
    return cues(spark, sf_dir).where(X.is_spot_check(F.concat_ws("|", "track", "pos"), 5, SEED)).select("track", "pos")


def review_sample(spark, sf_dir):
    rows = cues(spark, sf_dir).select("role", (F.col("pos") % 3).alias("stratum"), (F.col("track") * 1000 + F.col("pos")).alias("key"))
    return sets.round_robin(rows, "role", "stratum", "key", 30, SEED).select("role", "stratum", "key", "place")


def unique_words_by_role(spark, sf_dir):
    each = cues(spark, sf_dir).select("role", F.explode(F.array_distinct(X.words(F.col("text")))).alias("word"))
    return each.groupBy("role", "word").agg(F.count("*").alias("cues"))


QUERIES = {f.__name__: f for f in (cue_stamps, srt_round_trip, cue_best_matches, cue_combined_coverage, cue_near_duplicate_anti_join, audio_windows, timing_clusters, source_quality, source_verdict, display_checks, display_metrics, density_floor, cue_neighbours, cue_context, cue_predicates, cue_numbers, cue_normalised, spot_checks, review_sample, unique_words_by_role)}

_STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"
_WORDS = "regexp_extract_all(replace(lower({0}), '’', ''''), '[a-z0-9'']+')"
_NORM = f"array_to_string({_WORDS}, ' ')"
_BEFORE = "PARTITION BY track ORDER BY start_ms, end_ms, pos"
_FRAGMENT = rf"regexp_matches(trim(regexp_replace(text, '>>+|\[[^\]]+\]', ' ', 'g')), '(?i)\b(?:{'|'.join(X.FRAGMENT_WORDS.split())})\s*[,:;-]*$')"
_PAIRS = """pairs AS (SELECT c.track, c.pos, o.pos AS other, c.start_ms, c.end_ms, o.start_ms AS s, o.end_ms AS e, least(c.end_ms, o.end_ms) - greatest(c.start_ms, o.start_ms) AS ov
    FROM cues c JOIN other o ON c.track = o.track AND c.start_ms < o.end_ms AND o.start_ms < c.end_ms)"""


def _islands(source: str, gap: int) -> str:
    return f"""r AS (SELECT *, max(end_ms) OVER ({_BEFORE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach + {gap} THEN 1 ELSE 0 END) OVER ({_BEFORE} ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM r)"""


_VISIBLE = r"length(regexp_replace(text, '\s+', '', 'g'))"
_SFX = f"(regexp_matches(text, '{X.BRACKETED}') AND NOT regexp_matches(regexp_replace(text, '{X.BRACKETED}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]'))"
_HASH = f"sha256('{SEED}:' || key::VARCHAR)"
SQL = {
    "cue_stamps": f"{CUES} SELECT track, pos, {_STAMP.format('start_ms')} AS start_stamp, {_STAMP.format('end_ms')} AS end_stamp, start_ms FROM cues",
    "srt_round_trip": f"{CUES} SELECT track, pos::INTEGER AS id, start_ms, end_ms, trim(text) AS text FROM cues",
    "cue_best_matches": f"""{CUES}, {_PAIRS},
        m AS (SELECT track, pos, other, ov / (end_ms - start_ms)::DOUBLE AS ratio, ov, row_number() OVER (PARTITION BY track, pos ORDER BY ov / (end_ms - start_ms)::DOUBLE DESC, ov DESC, s, e, other) AS n FROM pairs)
        SELECT c.track, c.pos, other AS match_pos, round(ratio, 6) AS ratio, ov AS overlap_ms FROM cues c LEFT JOIN m ON c.track = m.track AND c.pos = m.pos AND n = 1""",
    "cue_combined_coverage": f"""{CUES}, {_PAIRS},
        p AS (SELECT track, pos, other, greatest(start_ms, s) AS s, least(end_ms, e) AS e FROM pairs),
        r AS (SELECT *, max(e) OVER (PARTITION BY track, pos ORDER BY s, e, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track, pos ORDER BY s, e, other ROWS UNBOUNDED PRECEDING) AS island FROM r),
        k AS (SELECT track, pos, sum(ms) AS ms FROM (SELECT track, pos, island, max(e) - min(s) AS ms FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2)
        SELECT c.track, c.pos, round(CASE WHEN end_ms > start_ms THEN coalesce(ms, 0) / (end_ms - start_ms)::DOUBLE ELSE 0 END, 6) AS covered FROM cues c LEFT JOIN k ON c.track = k.track AND c.pos = k.pos""",
    "cue_near_duplicate_anti_join": f"""{CUES}, p AS (SELECT track, {_NORM.format('text')} AS norm, start_ms, end_ms FROM cues),
        s AS (SELECT track, pos, {_NORM.format('text')} AS norm, start_ms + CASE WHEN pos % 3 = 0 THEN 60000 ELSE 0 END AS start_ms, end_ms + CASE WHEN pos % 3 = 0 THEN 60000 ELSE 0 END AS end_ms FROM other)
        SELECT track, pos FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.track = s.track AND p.norm = s.norm AND s.norm <> '' AND greatest(0, p.start_ms - s.end_ms, s.start_ms - p.end_ms) <= 2000)""",
    "audio_windows": f"""{CUES}, w AS (SELECT track, pos, greatest(0, start_ms - 1500) AS start_ms, end_ms + 1500 AS end_ms FROM cues), {_islands('w', 1000)}
        SELECT track, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS cues FROM i GROUP BY 1, 2""",
    "timing_clusters": f"""{CUES}, o AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY track ORDER BY pos) <= 2500 THEN 0 ELSE 1 END AS opens FROM cues),
        i AS (SELECT *, sum(opens) OVER (PARTITION BY track ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM o),
        g AS (SELECT track, island, count(*) AS cues, arg_max(end_ms, pos) - arg_min(start_ms, pos) AS span FROM i GROUP BY 1, 2)
        SELECT track, island, cues, span FROM g QUALIFY row_number() OVER (PARTITION BY track ORDER BY cues DESC, span, island) = 1""",
    "source_quality": f"""{CUES}, r AS (SELECT *, {_NORM.format('text')} AS norm, end_ms - start_ms AS dur, coalesce(lag(start_ms) OVER (PARTITION BY track ORDER BY pos), -1) AS before FROM cues),
        b AS (SELECT track, count(*) AS cues, round(avg((start_ms >= before AND dur > 0)::INT), 4) AS monotonic_ratio, round(avg((dur <= 50)::INT), 4) AS micro_cue_ratio, round(avg((dur BETWEEN 200 AND 1000)::INT), 4) AS short_cue_ratio,
              round(avg((dur >= 10000)::INT), 4) AS long_cue_ratio, round(avg(({_FRAGMENT})::INT), 4) AS fragment_ratio FROM r GROUP BY 1),
        s AS (SELECT track, norm, count(*) AS n FROM r WHERE norm <> '' GROUP BY 1, 2),
        l AS (SELECT track, sum(n) AS total, count(*) AS kinds, sum(n * length(norm)) AS letters, sum(CASE WHEN n >= 3 AND length(norm) >= 4 THEN n ELSE 0 END) AS looped FROM s GROUP BY 1),
        g AS (SELECT track, sum(len(regexp_extract_all(text, '[A-Za-z]'))) AS latin, sum(len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]'))) AS other FROM cues GROUP BY 1)
        SELECT b.*, round(latin / greatest(latin + other, 1), 4) AS language_ratio, round(coalesce(letters / total, 0), 4) AS mean_length, round(coalesce(kinds / total, 0), 4) AS unique_ratio, round(coalesce(looped / total, 0), 4) AS loop_ratio FROM b LEFT JOIN l USING (track) JOIN g USING (track)""",
    "display_checks": f"""{CUES}, z AS (SELECT track, pos, start_ms, end_ms, trim({SHOWN}) AS text FROM cues),
        r AS (SELECT *, end_ms - start_ms AS dur, {_VISIBLE} AS seen, string_split(text, chr(10)) AS l, lag(start_ms) OVER w AS before, max(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM z WINDOW w AS (PARTITION BY track ORDER BY pos)),
        x AS (SELECT track, pos, array_to_string(list_filter([CASE WHEN dur <= 0 THEN 'end_not_after_start' END, CASE WHEN regexp_matches(text, '{X.HANGUL}') THEN 'hangul_residue' END, CASE WHEN regexp_matches(text, '{R.KANA_RESIDUE}') THEN 'kana_residue' END,
              CASE WHEN start_ms < before THEN 'not_increasing' END, CASE WHEN start_ms < reach - 250 THEN 'overlap' END, CASE WHEN end_ms > 20250 THEN 'past_the_end' END], lambda v: v IS NOT NULL), ',') AS errors,
              array_to_string(list_filter([CASE WHEN dur > 0 AND seen >= 8 AND seen / (dur / 1000) > 14 THEN 'fast' END, CASE WHEN dur > 0 AND dur < 300 THEN 'flash' END, CASE WHEN dur > 7000 THEN 'long' END,
              CASE WHEN regexp_matches(text, '^[，。！？；：,.!?;:…]') THEN 'starts_with_punctuation' END, CASE WHEN len(l) > 2 THEN 'three_lines' END, CASE WHEN len(list_filter(l, lambda v: {_VISIBLE.replace('text', 'v')} > 22)) > 0 THEN 'wide_line' END], lambda v: v IS NOT NULL), ',') AS warnings FROM r)
        SELECT * FROM x WHERE errors <> '' OR warnings <> ''""",
    "display_metrics": f"""{CUES}, r AS (SELECT *, max(end_ms) OVER ({_BEFORE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cues)
        SELECT track, count(*) FILTER (start_ms < reach) AS overlaps, count(*) FILTER (end_ms <= start_ms) AS empty, count(*) FILTER (start_ms - reach > 5000) AS gaps FROM r GROUP BY 1""",
    "density_floor": f"""{CUES}, r AS (SELECT track, pos, CASE WHEN end_ms > start_ms THEN {_VISIBLE} / ((end_ms - start_ms) / 60000.0::DOUBLE) ELSE 0 END AS cpm FROM cues),
        f AS (SELECT track, median(cpm) * 0.25 AS floor FROM r WHERE cpm > 0 GROUP BY 1)
        SELECT track, pos, round(cpm, 3) AS cpm, round(floor, 3) AS floor FROM r JOIN f USING (track) WHERE cpm > 0 AND cpm < floor""",
    "cue_neighbours": f"""{CUES} SELECT track, row_number() OVER w::INTEGER AS id, lag(text, 1, '') OVER w AS before, lead(text, 1, '') OVER w AS after FROM cues WINDOW w AS (PARTITION BY track ORDER BY pos)""",
    "cue_context": f"""{CUES} SELECT track, pos, count(*) OVER w AS cues, sum({_VISIBLE}) OVER w::BIGINT AS visible FROM cues WINDOW w AS (PARTITION BY track ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)""",
    "cue_predicates": rf"""{CUES}, r AS (SELECT *, regexp_replace(text, '[\s\p{{P}}\p{{S}}]', '', 'g') AS content FROM cues),
        q AS (SELECT *, length(regexp_replace(content, '[^{X.HAN[1:-1]}]', '', 'g')) / length(content) AS h, length(regexp_replace(content, '[^\p{{Latin}}]', '', 'g')) / length(content) AS l FROM r)
        SELECT track, pos, CASE WHEN {_SFX} THEN 'music_sfx' WHEN length(content) = 0 THEN 'unknown' WHEN h >= 0.6 AND l < 0.15 THEN 'already_zh' WHEN l >= 0.6 AND h < 0.15 THEN 'english_reaction' WHEN h >= 0.15 AND l >= 0.15 THEN 'mixed' ELSE 'unknown' END AS class,
               regexp_matches(text, '{X.HAN}') AS han, regexp_matches(text, '{X.KANA}') AS kana, regexp_matches(text, '{X.HANGUL}') AS hangul, {_SFX} AS sfx, {_FRAGMENT} AS fragment FROM q""",
    "cue_numbers": rf"""{CUES} SELECT track, pos, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), lambda v: regexp_replace(v, '[.,]', '', 'g')))), '|') AS numbers, {_VISIBLE} AS visible, len({_WORDS.format('text')})::INTEGER AS words FROM cues""",
    "cue_normalised": rf"""{CUES} SELECT track, pos, {_NORM.format('text')} AS norm, trim(regexp_replace(text, '>>+|\[[^\]]+\]', ' ', 'g')) AS stripped FROM cues""",
    "spot_checks": f"""{CUES}, k AS (SELECT track, pos, track::VARCHAR || '|' || pos::VARCHAR AS key FROM cues) SELECT track, pos FROM k WHERE ('0x' || substr({_HASH}, 1, 8))::BIGINT % 100 < 5""",
    "review_sample": f"""{CUES}, k AS (SELECT role, pos % 3 AS stratum, track * 1000 + pos AS key FROM cues), t AS (SELECT *, row_number() OVER (PARTITION BY role, stratum ORDER BY {_HASH}, key) AS turn FROM k)
        SELECT role, stratum, key, row_number() OVER (PARTITION BY role ORDER BY turn, stratum)::INTEGER AS place FROM t QUALIFY place <= 30""",
    "unique_words_by_role": f"""{CUES}, s AS (SELECT DISTINCT role, track, pos, unnest({_WORDS.format('text')}) AS word FROM cues) SELECT role, word, count(*) AS cues FROM s  GROUP BY 1, 2""",
}
_PROFILE = SQL["source_quality"]
_RAPID = "(short_cue_ratio >= 0.5 AND mean_length >= 4)"
SQL["source_verdict"] = f"""WITH q AS ({_PROFILE}), v AS (SELECT *, greatest(0, CASE WHEN cues >= 10 THEN 20 WHEN cues >= 3 THEN 10 ELSE 0 END + CASE WHEN language_ratio >= 0.75 THEN 35 WHEN language_ratio >= 0.45 THEN 20 ELSE 0 END
        + CASE WHEN unique_ratio >= 0.45 THEN 25 WHEN unique_ratio >= 0.25 THEN 12 ELSE 0 END + CASE WHEN monotonic_ratio >= 0.98 THEN 20 WHEN monotonic_ratio >= 0.9 THEN 10 ELSE 0 END
        - 15 * (micro_cue_ratio >= 0.05)::INT - 15 * (fragment_ratio >= 0.2)::INT - 15 * {_RAPID}::INT - 30 * (loop_ratio >= 0.3)::INT) AS score FROM q),
    w AS (SELECT *, score >= 60 AND cues >= 3 AND language_ratio >= 0.45 AS usable FROM v)
    SELECT track, language_ratio, mean_length, score, array_to_string(list_filter([CASE WHEN cues < 3 THEN 'too_few_subtitles' END, CASE WHEN language_ratio < 0.45 THEN 'not_english' END, CASE WHEN unique_ratio < 0.25 THEN 'high_repetition' END, CASE WHEN monotonic_ratio < 0.9 THEN 'invalid_timeline' END,
           CASE WHEN micro_cue_ratio >= 0.05 THEN 'rolling_fragments' END, CASE WHEN fragment_ratio >= 0.2 THEN 'sentence_fragments' END, CASE WHEN {_RAPID} THEN 'rapid_short_cues' END, CASE WHEN loop_ratio >= 0.3 THEN 'hallucination_loop' END, CASE WHEN long_cue_ratio >= 0.05 THEN 'timing_anomalies' END], lambda x: x IS NOT NULL), ',') AS reasons,
           usable, usable AND (micro_cue_ratio >= 0.05 OR fragment_ratio >= 0.2 OR {_RAPID} OR long_cue_ratio >= 0.05) AS needs_secondary FROM w"""
