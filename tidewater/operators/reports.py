"""Figures over translations, runs and jobs; each is one grouping over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: signs of negation in Chinese, states of a second review
NEGATIONS = "不没别无非未"
STATES = "keep replace replace_rejected unresolved no_result deferred_weak_risk".split()
NUMBER = r"(\d+(?:\.\d+)?)"


def _share(part: Column, of: Column, places: int = 3) -> Column:
    return F.round(F.when(of > 0, part / of), places)


def translation_scores(rows: DataFrame, *by: str) -> DataFrame:
    """Per group the figures of translations (translation) against approved ones (gold): exact, numbers, negation, question, Hangul left.

    Rows with an empty gold, an empty translation or an `__ERROR__` are not checked. entities, an array of target names,
    counts name by name. Shares are null where nothing was there to check.
    """
    gold, said = F.col("gold"), F.col("translation")
    checked = rows.where((gold != "") & (said != "") & ~said.startswith("__ERROR__"))
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(NUMBER)))
    asked = lambda c: c.rlike("[?？]")
    negated = lambda c: c.rlike(f"[{NEGATIONS}]")
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    entities = F.coalesce("entities", F.array().cast("array<string>"))
    counts = {
        "checked": F.count("*"),
        "exact": F.count_if(bare(gold) == bare(said)),
        "with_numbers": F.count_if(gold.rlike(NUMBER)),
        "numbers_kept": F.count_if(gold.rlike(NUMBER) & (numbers(gold) == numbers(said))),
        "negation_kept": F.count_if(negated(gold) == negated(said)),
        "question_kept": F.count_if(asked(gold) == asked(said)),
        "names": F.sum(F.size(entities)),
        "names_kept": F.sum(F.size(F.filter(entities, lambda e: F.contains(said, e)))),
        "hangul_left": F.count_if(said.rlike(r"[\x{AC00}-\x{D7AF}]")),
    }
    g = checked.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()])
    rates = {"number_accuracy": ("numbers_kept", "with_numbers"), "negation_accuracy": ("negation_kept", "checked"), "question_accuracy": ("question_kept", "checked"), "entity_accuracy": ("names_kept", "names")}
    return g.select(*by, "checked", "exact", F.col("with_numbers").alias("number_checked"), "hangul_left", *[_share(F.col(p), F.col(n)).alias(r) for r, (p, n) in rates.items()])


def run_means(runs: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Per group of runs the mean of each metric, nulls left out, sums of tokens and seconds, and the cost, null unless every run has one."""
    total = F.coalesce(F.nullif("tokens_total", F.lit(0)), F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")]
    cost = F.when(F.bool_and(F.col("cost").isNotNull()), F.sum("cost"))
    return runs.groupBy(by).agg(F.count("*").alias("repeat"), *[F.avg(m).alias(m) for m in metrics], *sums, F.sum(total).alias("tokens_total"), F.round(F.coalesce(F.sum("wall_seconds"), F.lit(0.0)), 3).alias("wall_seconds"), cost.alias("cost"))


def state_counts(results: DataFrame, by: str) -> DataFrame:
    """Per group the number of results in each state of a second review, 0 where there is none; a null state is a weak risk put off."""
    state = F.coalesce("state", F.lit("deferred_weak_risk"))
    return results.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(state == s).alias(s) for s in STATES])


def recent_failures(jobs: DataFrame, most: int = 5) -> DataFrame:
    """Error codes of the newest failed jobs (job, state, error, updated), newest first; an empty code is internal_error."""
    failed = jobs.where("state = 'failed'").orderBy(F.desc("updated"), F.desc("job")).limit(most)
    return failed.select("job", F.coalesce(F.nullif("error", F.lit("")), F.lit("internal_error")).alias("error"))


def reviewable(jobs: DataFrame) -> DataFrame:
    """Completed jobs that were no dry runs, the last completed (else the last updated) first."""
    return jobs.where((F.col("state") == "completed") & ~F.coalesce("dry_run", F.lit(False))).orderBy(F.coalesce("completed", "updated").desc(), "job")


def tag_counts(entries: DataFrame, tags: str) -> DataFrame:
    """Per tag how often entries hold it; a tag said twice in one entry counts twice."""
    return entries.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def speech_coverage(cues: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per track the share of the audio (lengths: track, audio_ms) that its cues last; null where the audio has no length."""
    said = cues.groupBy("track").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("said"))
    return lengths.join(said, "track", "left").select("track", F.round(F.when(F.col("audio_ms") > 0, F.coalesce("said", F.lit(0)) / F.col("audio_ms")), 3).alias("coverage"))
