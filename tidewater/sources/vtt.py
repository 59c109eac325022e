"""WebVTT text as cues: whole files to rows, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timecode import stamp_to_ms, vtt_to_stamp
from .srt import stripped

# fixed values: forms of a timing line and of marks inside a payload line
TIMING = r"^\s*((?:\d+:)?\d{2}:\d{2}\.\d{3})\s+-->\s+((?:\d+:)?\d{2}:\d{2}\.\d{3})(?:\s+.*)?$"
INLINE_TIME, RUBY_TEXT, TAG = r"<(?:\d+:)?\d{2}:\d{2}\.\d{3}>", r"(?i)<rt(?:\s[^>]*)?>.*?</rt>", "</?[^>]+>"
REFERENCE = "&#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"
#: Entities that payloads use, besides numbers of characters; others stay as they are.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&amp;": "&"}


def _character(number: Column) -> Column:
    """The character of that number; a sign of replacement where there is none."""
    code = F.when(F.lower(number).startswith("x"), F.conv(F.substring(number, 2, 9), 16, 10)).otherwise(number).cast("int")
    known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def numbered_characters(line: Column) -> Column:
    """A line with `&#233;` and `&#xE9;` put as the characters they name."""
    found = F.array_distinct(F.regexp_extract_all(line, F.lit(REFERENCE)))
    return F.aggregate(found, line, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), _character(n)))


def payload_line(line: Column) -> Column:
    """A payload line without inline times, ruby text and tags, entities resolved, hard spaces as spaces."""
    for pattern in (INLINE_TIME, RUBY_TEXT, TAG):
        line = F.regexp_replace(line, pattern, "")
    line = numbered_characters(line)
    for name, sign in ENTITIES.items():
        line = F.replace(line, F.lit(name), F.lit(sign))
    return stripped(F.translate(line, "\u00a0\u200b", " "))


def without_repeats(lines: Column) -> Column:
    """Lines that aren't empty, each once where it repeats the one before it."""
    said = F.filter(lines, lambda x: x != "")
    return F.filter(said, lambda x, i: (i == 0) | (x != F.get(said, i - 1)))


def parse(files: DataFrame) -> DataFrame:
    """(track, content) to (track, id, start_ms, end_ms, text): cues with a timing in their first two lines and something to say, numbered in file order.

    Header, STYLE, REGION and NOTE blocks are passed over; a stamp that is no time of day raises. A file without cues gives no rows.
    """
    clean = F.regexp_replace(F.regexp_replace("content", "^\\x{FEFF}", ""), r"\r\n?", "\n")
    blocks = files.select("track", F.posexplode(F.split(stripped(clean), r"\n[ \t]*\n")).alias("block_no", "block"))
    lines = blocks.select("track", "block_no", F.transform(F.split("block", "\n"), lambda x: F.regexp_replace(x, r"\s+$", "")).alias("lines"))
    head = F.upper(stripped(F.get("lines", F.lit(0))))
    lines = lines.where(~head.startswith("WEBVTT") & ~head.isin("STYLE", "REGION") & ~head.startswith("NOTE"))
    at = F.when(F.get("lines", F.lit(0)).rlike(TIMING), 1).when(F.get("lines", F.lit(1)).rlike(TIMING), 2)
    timed = lines.withColumn("at", at).where("at is not null").withColumn("timing", F.get("lines", F.col("at") - 1))
    said = without_repeats(F.transform(F.slice("lines", F.col("at") + 1, F.size("lines")), payload_line))
    cues = timed.select("track", "block_no", "timing", F.array_join(said, "\n").alias("text")).where("text <> ''")

    def ms(i: int) -> Column:
        stamp = vtt_to_stamp(F.regexp_extract("timing", TIMING, i))
        return F.coalesce(stamp_to_ms(stamp), F.raise_error(F.concat(F.lit("no time of day: "), stamp)).cast("long"))

    return cues.select("track", F.row_number().over(Window.partitionBy("track").orderBy("block_no")).alias("id"), ms(1).alias("start_ms"), ms(2).alias("end_ms"), "text")
