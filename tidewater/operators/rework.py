"""Work of an earlier run that a new one keeps, sources that are put to a rebuild, and changes of a store that are left to make.

Null texts count as empty ones. Rows without a track or an id meet nothing and keep nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import AUTOMATIC
from ..functions.text import strip_sounds


def _plain(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _written(name: str) -> Column:
    return _plain(name).rlike(r"\S")


def kept_results(fresh: DataFrame, results: DataFrame, entries: DataFrame) -> DataFrame:
    """fresh (track, id, start_ms, end_ms, text) with kept, an earlier translation of the same words, and by, what it was found by.

    By times and text, else by id and text, else by id and the text without sounds and music; of several results (track,
    seq, id, original, translated) under one key the last counts, blank ones never. entries (track, id, start_ms, end_ms,
    original) are the earlier cues, one a track and id.
    """
    said = results.where(_written("translated")).withColumn("original", _plain("original"))

    def last(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        return rows.groupBy("track", *keys).agg(F.max_by("translated", "seq").alias(name))

    timed = said.drop("original").join(entries.select("track", "id", "start_ms", "end_ms", _plain("original").alias("text")), ["track", "id"])
    same = said.where("original <> ''")
    bare = same.withColumn("bare", strip_sounds(F.col("original"))).where("bare <> ''")
    rows = fresh.withColumn("text", _plain("text")).withColumn("bare", strip_sounds(F.col("text")))
    found = (
        rows.join(last(timed, "by_times", "start_ms", "end_ms", "text"), ["track", "start_ms", "end_ms", "text"], "left")
        .join(last(same.withColumnRenamed("original", "text"), "by_id", "id", "text"), ["track", "id", "text"], "left")
        .join(last(bare, "by_cleaned", "id", "bare"), ["track", "id", "bare"], "left")
    )
    ways = ("times", "id", "cleaned")
    by = F.coalesce(*[F.when(F.col(f"by_{w}").isNotNull(), w) for w in ways])
    return found.withColumns({"kept": F.coalesce(*[f"by_{w}" for w in ways]), "by": by}).drop("bare", *[f"by_{w}" for w in ways])


def kept_answers(active: DataFrame, entries: DataFrame, results: DataFrame, legacy: bool = False) -> DataFrame:
    """Earlier answers to risks that stand under the same id and the same key: track, id, decision, text and confidence.

    active (track, id, key, language), entries (track, id, key), results (track, seq, id, decision, translated,
    confidence). Answers of the legacy scheme hold for English alone; any decision but keep and replace becomes review.
    """
    asked = active.select("track", "id", _plain("key").alias("key"), F.coalesce(F.nullif("language", F.lit("")), F.lit("en")).alias("language"))
    if legacy:
        asked = asked.where("language = 'en'")
    same = asked.join(entries.select("track", "id", _plain("key").alias("key")), ["track", "id", "key"]).select("track", "id")
    text, decision = F.regexp_replace("translated", r"^\s+|\s+$", ""), F.lower("decision")
    answer = F.struct(F.when(decision.isin("keep", "replace"), decision).otherwise("review").alias("decision"), text.alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    last = results.where(_written("translated")).groupBy("track", "id").agg(F.max_by(answer, "seq").alias("a"))
    return same.join(last, ["track", "id"]).select("track", "id", "a.*")


def rebuild_reasons(decision: Column, conflict: Column, confidence: Column, unknown: Column) -> Column:
    """Why a source is to be rebuilt, in fixed order; empty where it is not."""
    clash = F.coalesce(conflict, F.lit(False))
    named = {"source_unresolved": decision == "unresolved", "low_confidence_conflict": clash & (confidence < 0.45), "unknown_entity_conflict": clash & (F.size(F.coalesce(unknown, F.array().cast("array<string>"))) > 0)}
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in named.items()]))


def rebuild_queue(units: DataFrame, most: int = 25) -> DataFrame:
    """units with reasons (track, pos, start_ms, end_ms, reasons) that have any; the first `most` of a track by time are called, the rest are told."""
    order = Window.partitionBy("track").orderBy("start_ms", "end_ms", "pos")
    wanted = units.where(F.size("reasons") > 0)
    # a limit of rows a track is cut before the shuffle; all rows then meet those few
    first = wanted.select("track", "pos", "start_ms", "end_ms").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return wanted.join(first.select("track", "pos", F.lit(True).alias("called")), ["track", "pos"], "left").withColumn("called", F.coalesce("called", F.lit(False)))


def neighbours(units: DataFrame, reach: int = 2) -> DataFrame:
    """track, pos, before and after: the texts of up to `reach` units each way, the settled text (canonical) before the first evidence; empty ones are left out."""
    order = Window.partitionBy("track").orderBy("pos")
    text = F.coalesce(F.nullif("canonical", F.lit("")), F.nullif("evidence", F.lit("")))
    said = units.select("track", "pos", text.alias("said"))
    before = F.array(*[F.lag("said", k).over(order) for k in range(reach, 0, -1)])
    after = F.array(*[F.lead("said", k).over(order) for k in range(1, reach + 1)])
    return said.select("track", "pos", F.array_compact(before).alias("before"), F.array_compact(after).alias("after"))


def blocks(reasons: Column) -> Column:
    """Whether a risk holds back the export: one of its reasons, without the evidence after a colon, is reviewed automatically."""
    names = F.transform(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: F.split_part(r, F.lit(":"), F.lit(1)))
    return F.arrays_overlap(names, F.array(*[F.lit(a) for a in AUTOMATIC]))


def change_plan(actions: DataFrame, store: DataFrame) -> DataFrame:
    """actions (action, operation, old_term, term, target, category) with state: change, applied or conflict, and why it is a conflict.

    store (term, target, category) holds one row a term. An `add` wants its term absent, any other operation wants
    old_term there, with the same target, and term absent; what stands there already just as asked is applied.
    """
    new = store.select("term", F.col("target").alias("new_target"), F.col("category").alias("new_category"), F.lit(True).alias("new"))
    old = store.select(F.col("term").alias("old_term"), F.col("target").alias("old_target"), F.lit(True).alias("old"))
    both = actions.join(new, "term", "left").join(old, "old_term", "left")
    there, gone = F.col("new").isNotNull(), F.col("old").isNull()
    as_asked = there & F.col("new_target").eqNullSafe(F.col("target")) & F.col("new_category").eqNullSafe(F.col("category"))
    added = F.when(~there, "change").when(as_asked, "applied").otherwise("existing row conflicts")
    replaced = F.when(gone & as_asked, "applied").when(gone, "old row is missing").when(there, "both rows exist").when(~F.col("old_target").eqNullSafe(F.col("target")), "target differs").otherwise("change")
    said = F.when(F.col("operation") == "add", added).otherwise(replaced)
    settled = said.isin("change", "applied")
    out = both.withColumns({"state": F.when(settled, said).otherwise("conflict"), "why": F.when(~settled, said)})
    return out.select(*actions.columns, "state", "why")


def apply_plan(store: DataFrame, plan: DataFrame) -> DataFrame:
    """store after the plan's changes: replaced terms go, new ones come. Conflicts change nothing; two changes to one term are an error."""
    change = plan.where("state = 'change'")
    repeated = F.count("*").over(Window.partitionBy("term")) > 1
    fresh = change.withColumn("twice", repeated).select("term", "target", "category", F.when(F.col("twice"), F.raise_error(F.concat(F.lit("two changes to "), "term")).cast("boolean")).alias("e")).where("e IS NULL").drop("e")
    left = store.join(change.where("operation <> 'add'").select(F.col("old_term").alias("term")).distinct(), "term", "left_anti")
    return left.select("term", "target", "category").unionByName(fresh)
