"""Batches of work: states, results that can be used again, and checks of results against their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import strings

# fixed values: words that may stay in a translation, as they are spelled
SAFE = (
    "DPS AoE BOSS CD ATK DEF HP EXP XP DMG ER HB TH CC BGM CDR WTF WTH OK OKs Yay Wow Oh Yeah Nah Bro Dude Man Hmm Ugh Eww Ah Ha Heh Huh Hm Oof Pop Bam Boom Whoa Woo Hey "
    "PVP PVE NPC DLC FPS RPG META GG"
).split()
CLEARS = ("running", "success")


def states(changes: DataFrame) -> DataFrame:
    """(batch, seq, state, error) to each batch's last state, the times it began to run, and its error, which running and success clear."""
    order = Window.partitionBy("batch").orderBy("seq")
    starts = (F.col("state") == "running") & ~F.lag("state").over(order).eqNullSafe("running")
    told = F.col("error").isNotNull() | F.col("state").isin(*CLEARS)
    marked = changes.withColumn("starts", starts.cast("int"))
    return marked.groupBy("batch").agg(F.max_by("state", "seq").alias("state"), F.sum("starts").alias("attempts"), F.max_by("error", F.when(told, F.col("seq"))).alias("error"))


def _spoken(results: Column) -> Column:
    return F.filter(results, lambda r: r["id"].isNotNull() & F.coalesce(r["translated"], F.lit("")).rlike(r"\S"))


def usable(batches: DataFrame) -> DataFrame:
    """batches (state, ids, results: array of id, translated) with whole, whether a finished batch's results are just those expected, and partial, the last result of each expected id that says something. A batch's arrays are as short as a request."""
    said = _spoken(F.coalesce("results", F.array().cast("array<struct<id:int,translated:string>>")))
    got, want = F.array_sort(F.array_distinct(F.transform(said, lambda r: r["id"]))), F.array_sort(F.array_distinct(F.coalesce("ids", F.array().cast("array<int>"))))
    whole = (F.col("state") == "success") & (F.coalesce(F.size("results"), F.lit(0)) > 0) & ((F.size(want) == 0) | (got == want))
    fits = F.filter(said, lambda r: (F.size(want) == 0) | F.array_contains(want, r["id"]))
    last = F.transform(F.array_distinct(F.transform(fits, lambda r: r["id"])), lambda i: F.element_at(F.filter(fits, lambda r: r["id"] == i), -1))
    return batches.withColumns({"whole": F.coalesce(whole, F.lit(False)), "partial": last})


def layout_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Batches (batch, ids) whose ids differ between two layouts or that one of them lacks."""
    a, b = old.select("batch", F.col("ids").alias("a")), new.select("batch", F.col("ids").alias("b"))
    return a.join(b, "batch", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("batch")


def residual_words(text: Column) -> Column:
    """Latin words of three letters or more that a translation left, as often as they stand there."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda w: w.rlike("^[A-Za-z]{3,}$") & ~(F.array_contains(strings(SAFE), w) | F.array_contains(strings(SAFE), F.upper(w)) | F.array_contains(strings(SAFE), F.initcap(w))))


def report(given: DataFrame, results: DataFrame, by: str, strict: bool = True) -> DataFrame:
    """Per group: rows given (by, id) and got (by, id, original, translated), ids missing and extra, empty, short and long translations, leftover words, and passed."""
    a = given.select(by, "id").distinct().withColumn("g", F.lit(1))
    b = results.groupBy(by, "id").agg(F.count("*").alias("n"))
    ids = a.join(b, [by, "id"], "full").groupBy(by).agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"))
    counts = given.groupBy(by).agg(F.count("*").alias("given"))
    t, o = F.coalesce("translated", F.lit("")), F.coalesce("original", F.lit(""))
    both, ratio = (F.length(t) > 0) & (F.length(o) > 0), F.length(t) / F.greatest(F.length(o), F.lit(1))
    found = results.groupBy(by).agg(F.count("*").alias("got"), F.count_if(~t.rlike(r"\S")).alias("empty"), F.count_if(both & (ratio < 0.05)).alias("short"), F.count_if(both & (ratio > 5.0)).alias("long"), F.count_if(F.size(residual_words(t)) > 0).alias("leftover"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = ids.join(counts, by, "left").join(found, by, "left").select(by, *[zero(c) for c in ("given", "got", "missing", "extra", "empty", "short", "long", "leftover")])
    bad = (F.col("given") != F.col("got")) | (F.col("missing") > 0) | (F.col("extra") > 0) | (F.lit(strict) & (F.col("empty") > 0))
    return rows.withColumn("passed", ~bad)


def answers(responses: DataFrame) -> DataFrame:
    """(batch, expected: array of ids, response: text with a JSON object of results) to batch, id, decision, text, confidence, reason: the first valid answer for each expected id."""
    inner = F.regexp_extract("response", r"(?s)(\{.*\})", 1)
    kind = "struct<results:array<struct<id:string,text:string,decision:string,confidence:string,reason:string>>>"
    rows = responses.select("batch", "expected", F.posexplode(F.from_json(inner, kind)["results"]).alias("n", "r"))
    tidy = lambda c: F.regexp_replace(F.coalesce(F.col(f"r.{c}"), F.lit("")), r"^\s+|\s+$", "")
    parsed = rows.select("batch", "expected", "n", F.col("r.id").try_cast("int").alias("id"), F.lower(tidy("decision")).alias("decision"), tidy("text").alias("text"), F.col("r.confidence").try_cast("double").alias("confidence"), tidy("reason").alias("reason"))
    good = parsed.where(F.array_contains("expected", F.col("id")) & F.col("decision").isin("keep", "replace") & F.col("confidence").between(0.0, 1.0) & (F.col("text") != "") & (F.col("reason") != ""))
    return good.groupBy("batch", "id").agg(F.min(F.struct("n", "decision", "text", "confidence", "reason")).alias("r")).select("batch", "id", "r.decision", "r.text", "r.confidence", "r.reason")
