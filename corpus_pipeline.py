"""A corpus pipeline: documents pass five stages, each written as Parquet and read again.

toxicity    rows that score 0.7 or more for toxicity go
exact       of equal texts the row with the largest doc_id stays
near        of each component of near-duplicates (five words, similarity 0.8 or more) the smallest doc_id stays
mixing      rows are put in the order of the sources' target weights; none go
bpe         rows become token ids and back, beside their slot and place in the mixing schedule and in that order

All but the last return the columns of documents. Nulls, empty tables, repeated rows and clashing columns have the
results that the operators' modules state; of rows that repeat an id and a text one passes stage exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import bpe_chunks, exact_dedup, minhash_dedup, mixing, queries, toxicity
from tidewater.llm.shared import new_folder, row_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model, most=queries.TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.survivors(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs, queries.WEIGHTS, queries.OTHER_WEIGHT, queries.BLOCK_SIZE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe_chunks.encode(docs, output=("row_key", "n_tokens", "ids_sha256", "decoded_sha256")).drop("doc_id")
    # the schedule again: it follows from id, text and source, and no text moves for it
    rows = docs.select("doc_id", "source", "text", row_key("doc_id", "text").alias("row_key"))
    placed = mixing.arrange(rows, queries.WEIGHTS, queries.OTHER_WEIGHT, queries.BLOCK_SIZE).select("doc_id", "row_key", "slot", "place")
    # rows that repeat id and text have equal tokens, and a place each
    joined = placed.join(tokens.dropDuplicates(["row_key"]).hint("merge"), "row_key")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "slot", "place")


STAGES = [("toxicity", drop_toxic), ("exact", drop_copies), ("near", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
#: The classifier and the tokenizer have no SQL. tests/llm checks columns, unique ids and texts, and the schedule of the last
#: stage; no test compares all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
