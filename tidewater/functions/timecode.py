"""Cue times: stamps, milliseconds and interval measures as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^(\d{2}):([0-5]\d):([0-5]\d),(\d{3})$"


def stamp_to_ms(stamp: Column) -> Column:
    """`HH:MM:SS,mmm` in milliseconds; null where the stamp is not of that form or minutes or seconds exceed 59."""
    part = lambda i: F.regexp_extract(stamp, STAMP, i).cast("long")
    return F.when(stamp.rlike(STAMP), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def ms_to_stamp(ms: Column) -> Column:
    """Milliseconds as `HH:MM:SS,mmm`; negative times count as 0."""
    t = F.greatest(F.lit(0).cast("long"), ms)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000)


def vtt_to_stamp(value: Column) -> Column:
    """`MM:SS.mmm`, `H:MM:SS.mmm` or `HH:MM:SS.mmm` as `HH:MM:SS,mmm`."""
    dotted = F.replace(F.trim(value), F.lit("."), F.lit(","))
    return F.when(F.size(F.split(dotted, ":")) == 2, F.concat(F.lit("00:"), dotted)).when(dotted.rlike("^[0-9]:"), F.concat(F.lit("0"), dotted)).otherwise(dotted)


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def coverage(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Share of the first interval that the second covers; 0 where the first is empty."""
    return F.when(e1 > s1, overlap_ms(s1, e1, s2, e2) / (e1 - s1)).otherwise(F.lit(0.0))


def distance_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), s2 - e1, s1 - e2)


def rate(count: Column, total: Column, places: int = 6) -> Column:
    """count / total, null where the total is not positive: unknown is not zero."""
    return F.when(total > 0, F.round(count / total, places))
