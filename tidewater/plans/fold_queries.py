"""Queries over folds of cue tracks. Texts are cut into rolling captions: each cue begins with the end of the one before it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds
from .cue_queries import CUES, cues


def _captions(spark, sf_dir) -> DataFrame:
    """Cues of rolling captions: short, overlapping, some of a few milliseconds, some repeating the one before or carrying it on."""
    c = cues(spark, sf_dir)
    piece = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int")), lambda k: F.substring("text", k * 40 + 1, F.when(k % 3 == 1, 70).otherwise(40)))
    rows = c.select("track", F.col("pos").alias("turn"), "start_ms", F.posexplode(piece).alias("k", "text"))
    number = F.row_number().over(Window.partitionBy("track").orderBy("turn", "k"))
    rows = rows.withColumn("pos", number.cast("long"))
    start = F.col("pos") * 1500
    return rows.select("track", "pos", start.alias("start_ms"), (start + F.when(F.col("pos") % 7 == 0, 40).when(F.col("pos") % 5 == 0, 2800).otherwise(1400)).alias("end_ms"), "text")


def _fold(name: str, fold: folds.Fold):
    def query(spark, sf_dir):
        return folds.run(_captions(spark, sf_dir), fold)

    query.__name__ = name
    return query


def semantic_units(spark, sf_dir):
    return folds.units(_captions(spark, sf_dir))


def adaptive_batches(spark, sf_dir):
    return folds.batches(cues(spark, sf_dir).select("track", "pos", "start_ms", "end_ms", "text"), target=3, budget=900)


_FOLDS = {"rolling_overlaps": folds.rolling_overlaps, "micro_cues": folds.micro_cues, "fragment_merge": partial(folds.fragment_openings, language="en"), "export_clean": folds.export_clean, "rolling_dedupe": folds.rolling_dedupe, "minimum_duration": folds.minimum_duration}
QUERIES = {name: _fold(name, f) for name, f in _FOLDS.items()} | {"semantic_units": semantic_units, "adaptive_batches": adaptive_batches}
SQL = {
    "adaptive_batches": f"""WITH RECURSIVE {CUES.strip().removeprefix('WITH')}, r AS (SELECT track, pos, row_number() OVER (PARTITION BY track ORDER BY pos) AS k, greatest(1, (length(text) + 3) // 4) + 8 AS need,
              regexp_matches(trim(text), '[.!?…。！？]["''”’）)\\]]*$') AS closes FROM cues),
        m AS (SELECT *, max(closes) OVER (PARTITION BY track ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS near FROM r),
        s AS (SELECT track, k, pos, 1 AS batch, 1 AS n, need AS used, closes FROM m WHERE k = 1
              UNION ALL
              SELECT m.track, m.k, m.pos, CASE WHEN c THEN s.batch + 1 ELSE s.batch END, CASE WHEN c THEN 1 ELSE s.n + 1 END, CASE WHEN c THEN m.need ELSE s.used + m.need END, m.closes
              FROM s JOIN m ON m.track = s.track AND m.k = s.k + 1, LATERAL (SELECT s.used + m.need > 900 OR (s.n >= 3 AND NOT (NOT s.closes AND m.near AND s.n < 7)) AS c) x)
        SELECT track, pos, batch::BIGINT AS batch FROM s""",
}
