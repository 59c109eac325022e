"""SubRip text as DataFrames: whole files to cues and back, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecode import ms_to_stamp, stamp_to_ms

ARROW = r"^\s*(\S+)\s*-->\s*(\S+)\s*$"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse(files: DataFrame, strict: bool = True) -> DataFrame:
    """(track, content) to (track, pos, id, start_ms, end_ms, text) in file order.

    Byte-order mark and CR LF are normalised. Only an empty line ends a block; lines of white space alone inside one are
    left out. Blocks of fewer than two lines are skipped. A malformed block raises, or is left out where strict is false.
    """
    clean = F.regexp_replace(F.regexp_replace("content", "^\\x{FEFF}", ""), r"\r\n?", "\n")
    return parse_blocks(files.select("track", F.posexplode(F.split(stripped(clean), r"\n\n")).alias("pos", "block")), strict)


def parse_blocks(blocks: DataFrame, strict: bool = True) -> DataFrame:
    """As parse(), from a row a block (track, pos, block): no row holds a whole track."""
    blocks = blocks.withColumn("block", F.regexp_replace("block", r"\r\n?", "\n"))
    lines = blocks.select("track", "pos", F.split(stripped(F.col("block")), "\n").alias("lines")).where(F.size("lines") >= 2)
    at = lambda i: F.regexp_extract(F.get("lines", F.lit(1)), ARROW, i)
    rows = lines.select("track", "pos", F.when(F.get("lines", F.lit(0)).rlike(r"^\s*[0-9]+\s*$"), stripped(F.get("lines", F.lit(0)))).try_cast("int").alias("id"), stamp_to_ms(at(1)).alias("start_ms"), stamp_to_ms(at(2)).alias("end_ms"), F.array_join(F.filter(F.slice("lines", F.lit(3), F.size("lines")), lambda x: x.rlike(r"\S")), "\n").alias("text"))
    good = F.col("id").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    if strict:
        return rows.withColumn("id", F.when(good, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("malformed block "), F.col("pos").cast("string"), F.lit(" of "), F.col("track").cast("string"))).cast("int")))
    return rows.where(good)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("track"), F.col("value").alias("content"))
    return parse(files, strict)


def blocks(cues: DataFrame) -> DataFrame:
    """(track, pos, id, start_ms, end_ms, text) to a row a block (track, pos, block), CR LF within it."""
    block = F.concat_ws("\r\n", F.col("id").cast("string"), F.concat_ws(" --> ", ms_to_stamp(F.col("start_ms")), ms_to_stamp(F.col("end_ms"))), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return cues.select("track", "pos", block.alias("block"))


def write(cues: DataFrame, path: str) -> None:
    """A folder a track with SubRip text in the order of pos, in as many files as ranges of (track, pos): long tracks are several files, read one after another."""
    n = int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks(cues).repartitionByRange(n, "track", "pos").sortWithinPartitions("track", "pos")
    ordered.select("track", F.concat(F.col("block"), F.lit("\r\n")).alias("value")).write.mode("error").option("lineSep", "\n").partitionBy("track").text(path)


def render(cues: DataFrame) -> DataFrame:
    """One SubRip document a track, for tracks that a row may hold: byte-order mark, CR LF within blocks, a line feed alone between them."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return blocks(cues).groupBy("track").agg(F.concat(F.lit("\ufeff"), F.array_join(F.transform(ordered, lambda x: x["block"]), "\r\n\n"), F.lit("\r\n")).alias("content"))
