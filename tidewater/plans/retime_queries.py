"""Queries over times: cues at another transcript's times, recognised words to cues, overlapping recordings, on words of `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retime
from .cue_queries import CUES, cues


def _words(spark, sf_dir) -> DataFrame:
    """track, turn, k, word: the words of all texts."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), " ")
    return c.select(F.col("conv_id").alias("track"), "turn", F.posexplode(w).alias("k", "word")).where("word <> ''")


def _lines(words: DataFrame, size: int, step_ms: int, length_ms: int) -> DataFrame:
    """Lines of `size` words, one after another; every ninth is long."""
    i = F.floor(F.col("k") / size)
    texts = words.groupBy("track", "turn", i.alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("text"))  # at most `size` words
    start = F.col("turn") * 600_000 + F.col("i") * step_ms
    return texts.select("track", (F.col("turn") * 10_000 + F.col("i")).alias("pos"), start.alias("start_ms"), (start + F.when(F.col("i") % 9 == 4, 14_000).otherwise(length_ms)).alias("end_ms"), "text")


def transcripts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two transcripts of the same words: lines of 8, and lines of 13 a little earlier, with words left out and misheard."""
    words = _words(spark, sf_dir)
    other = words.where("k % 9 <> 0").withColumn("word", F.when(F.col("k") % 11 == 0, "uh").otherwise(F.col("word")))
    heard = _lines(other, 13, 4875, 4600).withColumns({c: F.greatest(F.lit(0), F.col(c) - 700 + F.col("pos") * 37 % 400) for c in ("start_ms", "end_ms")})
    return _lines(words, 8, 3000, 2600), heard


def retimed_cues(spark, sf_dir):
    return retime.retimed(*transcripts(spark, sf_dir)).select("track", "pos", "start_ms", "end_ms", "used")


def recognised(spark, sf_dir) -> DataFrame:
    """Single words with times of their own: some pauses, an ending here and there."""
    start = F.col("turn") * 600_000 + F.col("k") * 310 + F.floor(F.col("k") / 23) * 900
    return _words(spark, sf_dir).select("track", (F.col("turn") * 100_000 + F.col("k")).alias("pos"), start.alias("start_ms"), (start + 200 + F.col("k") % 5 * 60).alias("end_ms"), F.col("word").alias("text"))


def word_cues(spark, sf_dir):
    return retime.cues_of_words(recognised(spark, sf_dir))


def recordings(spark, sf_dir) -> DataFrame:
    """Cues, and of two in three a second take that begins a little later, whole, shortened or of other words."""
    c = cues(spark, sf_dir).select("track", (F.col("pos") * 2).alias("pos"), "start_ms", "end_ms", "text")
    text = F.expr("CASE WHEN pos % 6 = 0 THEN concat(text, ' and more') WHEN pos % 6 = 2 THEN substring(text, 1, 60) ELSE concat('other ', text) END")
    again = c.where("pos % 10 <> 4").select("track", (F.col("pos") + 1).alias("pos"), (F.col("start_ms") + 300).alias("start_ms"), (F.col("end_ms") + F.col("pos") % 4 * 200 - 200).alias("end_ms"), text.alias("text"))
    return c.unionByName(again)


def joined_recordings(spark, sf_dir):
    return retime.without_overlaps(recordings(spark, sf_dir))


def recording_windows(spark, sf_dir):
    ends = cues(spark, sf_dir).groupBy("track").agg(F.max("end_ms").alias("length"))
    return retime.recording_windows(ends, 9_000, 1_500)


QUERIES = {f.__name__: f for f in (retimed_cues, word_cues, joined_recordings, recording_windows)}
SQL = {
    "word_cues": r"""WITH RECURSIVE s AS (SELECT conv_id AS track, turn, string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS w FROM conversations),
        e AS (SELECT track, turn, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS text FROM s),
        t AS (SELECT track, turn * 100000 + k AS pos, turn * 600000 + k * 310 + k // 23 * 900 AS start_ms, turn * 600000 + k * 310 + k // 23 * 900 + 200 + k % 5 * 60 AS end_ms, text FROM e WHERE text <> ''),
        n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY start_ms, pos) AS i, regexp_matches(text, '[.!?。！？…]$') AS closes FROM t),
        r AS (SELECT track, i, pos, start_ms AS begun, end_ms, closes, 1 AS cue FROM n WHERE i = 1
              UNION ALL SELECT n.track, n.i, n.pos, CASE WHEN x.c THEN n.start_ms ELSE r.begun END, n.end_ms, n.closes, r.cue + x.c::INT
              FROM r JOIN n ON n.track = r.track AND n.i = r.i + 1, LATERAL (SELECT r.closes OR n.start_ms - r.end_ms >= 750 OR n.end_ms - r.begun >= 6000 AS c) x)
        SELECT r.track, min_by(n.pos, i) AS pos, min(begun) AS start_ms, max_by(n.end_ms, i) AS end_ms, string_agg(n.text, ' ' ORDER BY i) AS text FROM r JOIN n USING (track, i) GROUP BY r.track, cue""",
    "recording_windows": f"""{CUES}, d AS (SELECT track, max(end_ms) AS length FROM cues GROUP BY 1 HAVING max(end_ms) > 0),
        k AS (SELECT track, length, unnest(range(0, 1 + greatest(0, (length - 9000 + 7499) // 7500))) AS k FROM d)
        SELECT track, k::INTEGER AS k, k * 7500 AS start, least(k * 7500 + 9000, length) AS "end" FROM k""",
}
