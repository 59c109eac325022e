"""Versioned JSON stores as rows: files {"schema_version": n, "kind": k, "items": [...]}, read without Python.

A file that is no JSON, of another version or without a list of items, and an item that doesn't fit its kind's schema,
is told in the column `fault` and not lost: its text is in `raw`. Spark parses only the fields that a query uses. A file is
one value, so stores larger than a task's memory should be several files; all files under a path are one store.

Empty files hold nothing. Maps of hearings to names ({"gin gran": "Jingran"}) and lists of ids are read likewise; a missing path is an empty store.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A store's versions that can be read, its items' fields and those that an item must have."""

    versions: tuple[int, ...]
    schema: str
    needs: tuple[str, ...] = ("key",)


KINDS = {
    "risk.generated": Kind((2,), "key string, subtitle_id int, start string, end string, score int, reasons array<string>, source_language string, source_text string, translated string, severity string, review_required boolean"),
    "round2.results": Kind((1,), "key string, round2_text string, decision string, confidence double, reason string, accepted boolean, state string"),
    "review-state": Kind((1,), "key string, state string, text string, note string, updated_at string"),
    "translation-memory": Kind((1, 2), "id string, source string, source_normalized string, final string, game string, source_language string, target_language string, approved boolean, seen_count int", ("id", "source")),
}


def _files(spark: SparkSession, path: str) -> DataFrame:
    try:
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, content string")
    return files.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("content"))


def items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """file, place, the kind's fields, fault and raw: a row an item, and a row for each file that can't be read (its place is null)."""
    known = KINDS[kind]
    head = F.from_json("content", "schema_version int, kind string, items array<string>, broken string", {"columnNameOfCorruptRecord": "broken"})
    files = _files(spark, path).withColumn("head", head)
    version = F.col("head.schema_version")
    fault = F.when(F.col("head").isNull() | F.col("head.broken").isNotNull(), "no JSON of this form").when(version.isNull() | ~version.isin(*known.versions), F.concat(F.lit("schema version "), F.coalesce(version.cast("string"), F.lit("missing"))))
    fault = fault.when(F.col("head.kind").isNotNull() & (F.col("head.kind") != kind), F.concat(F.lit("kind "), F.col("head.kind"))).when(F.col("head.items").isNull(), "no items")
    told = files.withColumn("fault", fault)
    each = told.where("fault IS NULL").select("file", F.posexplode("head.items").alias("place", "raw"))
    parsed = each.withColumn("item", F.from_json("raw", f"{known.schema}, broken string", {"columnNameOfCorruptRecord": "broken"}))
    empty = F.lit(False)
    for c in known.needs:
        empty = empty | (F.coalesce(F.col(f"item.{c}"), F.lit("")) == "")
    wrong = F.when(F.col("item").isNull() | F.col("item.broken").isNotNull(), "no item of this kind").when(empty, f"without {' or '.join(known.needs)}")
    names = [f.split()[0] for f in known.schema.split(", ")]
    good = parsed.select("file", "place", *[F.when(wrong.isNull(), F.col(f"item.{c}")).alias(c) for c in names], wrong.alias("fault"), F.when(wrong.isNotNull(), F.col("raw")).alias("raw"))
    return good.unionByName(told.where("fault IS NOT NULL").select("file", "fault", F.col("content").alias("raw")), allowMissingColumns=True)


def envelopes(rows: DataFrame, kind: str, by: str, version: int | None = None, **more: Column) -> DataFrame:
    """`by` and content: an envelope for each value of `by`, its items in the order of the first needed field, without nulls. A value's rows are one file and must fit a row."""
    known = KINDS[kind]
    fields = [c for c in (f.split()[0] for f in known.schema.split(", ")) if c in rows.columns]
    own = F.array_sort(F.collect_list(F.struct(F.col(known.needs[0]).alias("order"), F.to_json(F.struct(*fields)).alias("item"))))
    whole = rows.groupBy(by).agg(own.alias("items"))
    extra = F.to_json(F.struct(F.lit(version or known.versions[-1]).alias("schema_version"), F.lit(kind).alias("kind"), *[c.alias(k) for k, c in more.items()]))
    listed = F.array_join(F.transform("items", lambda x: x["item"]), ",")
    return whole.select(by, F.concat(F.regexp_replace(extra, r"\}$", ', "items": ['), listed, F.lit("]}")).alias("content"))


def hearings(spark: SparkSession, path: str) -> DataFrame:
    """term and target of files that hold one map of names each, longest terms first to be used; empty ones are left out."""
    pairs = _files(spark, path).select(F.explode(F.from_json("content", "map<string,string>")).alias("term", "target"))
    return pairs.where("term <> '' AND target <> ''").dropDuplicates(["term"])


def ids(spark: SparkSession, path: str) -> DataFrame:
    """id: of files with a JSON list, with {"ids": [...]}, or with an id a line and # before remarks."""
    text = F.trim(F.col("content"))
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.from_json(text, "ids array<string>")["ids"])
    lines = F.transform(F.split("content", r"\r\n?|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    each = _files(spark, path).select(F.explode(F.coalesce(listed, lines)).alias("id"))
    return each.where("id <> ''").distinct()
