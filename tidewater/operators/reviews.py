"""Import of completed reviews into a store, told row by row: what is applied, what was before, what is refused and why.

Every row of a review carries the text, state and gold that its reviewer saw; a row whose store has moved on is stale and
refused. A row that the store holds already changes nothing, so a second import of one file changes nothing at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: decisions of a review, and a time with its zone
DECISIONS = ("correct", "keep", "reject", "skip", "")
STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def _said(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def imported(entries: DataFrame, reviews: DataFrame, language: str) -> DataFrame:
    """id, outcome (applied, already, skipped, refused), reason and the entry's gold, status, reviewer, evidence, reviewed_at and notes as they are to be.

    entries: id, canonical, gold, status, reviewer, evidence, reviewed_at, notes. reviews: id, language, canonical, current_gold, status, decision, corrected,
    reviewer, evidence, reviewed_at, notes. A row a review; the first reason that holds refuses."""
    seen = reviews.select(_said("id").alias("id"), F.lower(_said("decision")).alias("r_decision"), _said("language").alias("r_language"), F.coalesce("canonical", F.lit("")).alias("r_canonical"), F.coalesce("current_gold", F.lit("")).alias("r_gold"), _said("status").alias("r_status"), *[_said(c).alias(f"r_{c}") for c in ("corrected", "reviewer", "evidence", "reviewed_at", "notes")])
    seen = seen.withColumn("r_times", F.count("*").over(Window.partitionBy("id")))
    own = entries.select("id", F.lit(True).alias("known"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("canonical", "gold", "status", "reviewer", "evidence", "reviewed_at", "notes")])
    met = seen.join(own, "id", "left")
    decision = F.col("r_decision")
    gold = F.when(decision == "correct", F.col("r_corrected")).otherwise(F.col("gold"))
    status = F.when(decision == "reject", "rejected").otherwise("confirmed")
    same = (F.col("gold") == gold) & (F.col("status") == status)
    for c in ("reviewer", "evidence", "reviewed_at", "notes"):
        same = same & (F.col(c) == F.col(f"r_{c}"))
    skips = decision.isin("", "skip")
    rules = [
        (F.col("r_times") > 1, "duplicate review id"), (F.col("known").isNull(), "unknown id"), (F.col("r_language") != language, "language mismatch"), (F.col("r_canonical") != F.col("canonical"), "stale canonical text"),
        (~decision.isin(*DECISIONS), "unknown decision"), (~skips & (F.col("r_reviewer") == ""), "reviewer is required"), (~skips & (F.col("r_evidence") == ""), "evidence is required"), (~skips & ~F.col("r_reviewed_at").rlike(STAMP), "reviewed_at must be a time with its zone"),
        (~skips & (decision != "reject") & (gold == ""), "no gold text"), (~skips & ~same & (F.col("r_status") != F.col("status")), "stale status"), (~skips & ~same & (F.col("r_gold") != F.col("gold")), "stale gold text"),
    ]
    reason = F.lit(None).cast("string")
    for holds, why in reversed(rules):
        reason = F.when(holds, why).otherwise(reason)
    told = met.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNotNull(), "refused").when(skips, "skipped").when(same, "already").otherwise("applied"))
    new = lambda c, value: F.when(F.col("outcome") == "applied", value).otherwise(F.col(c)).alias(c)
    return told.select("id", "outcome", "reason", new("gold", gold), new("status", status), *[new(c, F.col(f"r_{c}")) for c in ("reviewer", "evidence", "reviewed_at", "notes")])


def merged(entries: DataFrame, told: DataFrame) -> DataFrame:
    """entries with the applied reviews; all other columns and rows as they are."""
    fields = ["gold", "status", "reviewer", "evidence", "reviewed_at", "notes"]
    new = told.where("outcome = 'applied'").select("id", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in fields])
    both = entries.join(new, "id", "left")
    return both.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in entries.columns])


def totals(told: DataFrame) -> DataFrame:
    """outcome, reason and rows of an import."""
    return told.groupBy("outcome", "reason").agg(F.count("*").alias("rows"))
