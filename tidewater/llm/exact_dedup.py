"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries name the digests that may be frequent; their exact counts and winners, k rows at most, are
broadcast and settle those rows where they lie. Only rows with other digests are shuffled, and no such digest has
more than about rows / (k + 1) copies, so no task gets a hot group.

Defined results: a null text counts as empty. Of rows with equal texts the largest id stays; a null id loses to any
other, and where all ids are null the group's keep_id is null. Rows that repeat both id and text share one decision in
decide(); survivors() leaves one of them. An empty table gives an empty result. Other columns are neither read nor
able to clash in decide(); survivors() returns exactly the input's columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free, row_key, text_or_empty

#: Counters of a Misra-Gries summary; what is broadcast is at most so many rows of about 60 bytes.
COUNTERS = 1024


def summarise(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Misra-Gries over one partition, a batch at a time: add the batch's counts, then take the (k + 1)-th largest off all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            for digest, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True):
                held[digest] = held.get(digest, 0) + n
            if len(held) > k:
                off = sorted(held.values(), reverse=True)[k]
                held = {d: n - off for d, n in held.items() if n > off}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    return run


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """At most k digests, among them every one with more than rows / (k + 1) copies (summaries of partitions merge by adding)."""
    merged = digests.select("digest").mapInArrow(summarise(k), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "digest").limit(k).select("digest")


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(text_col)
    rows = cut(df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(normalise(text) if normalise else text, 256)).alias("digest")))
    named = F.broadcast(frequent(rows, counters))
    winners = rows.join(named, "digest").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.lit(True).alias("heavy"))
    split = rows.join(F.broadcast(cut(winners)), "digest", "left")
    heavy = split.where("heavy").select("id", "digest", "keep_id", "group_size")
    same = Window.partitionBy("digest")
    rest = split.where("heavy is null").select("id", "digest", F.max("id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"))
    return heavy.unionByName(rest).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The input's rows without later copies: one row of each distinct text, with all columns of the input."""
    kept = decide(df, id_col, text_col, counters=counters).where("kept").select(id_col, "text_sha256").distinct()
    ident = F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("~")), F.lit("|"), F.col("sha"))
    name = free("__row_key", df.columns)
    keys = kept.toDF("id", "sha").select(ident.alias(name))
    own = F.concat(F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit("~")), F.lit("|"), F.sha2(text_or_empty(text_col), 256))
    return df.withColumn(name, own).join(keys, name, "left_semi").dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in df.columns])
