"""Glossary terms in texts: n-grams of a text's tokens meet the terms in an equi-join, whatever the terms' lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE, lowered


def term_tokens(text: Column) -> Column:
    """Lower-case runs of Latin letters and digits; any other character but white space is a token `|`, which keeps its neighbours apart."""
    spaced = F.regexp_replace(lowered(F.coalesce(text, F.lit(""))), f"[^a-z0-9{WHITE}]+", " | ")
    return F.filter(F.split(spaced, f"[{WHITE}]+"), lambda w: w != "")


def keyed(terms: DataFrame) -> DataFrame:
    """(term, target) with gram, the term's tokens in one string, and n, their number; terms without a Latin letter or digit are left out (entities.extract finds those of other scripts)."""
    tokens = F.regexp_replace(F.array_join(term_tokens(F.col("term")), " "), r"^(?:\| )+|(?: \|)+$", "")
    return terms.withColumn("gram", tokens).where(F.col("gram").rlike("[a-z0-9]")).withColumn("n", F.size(F.split("gram", " ")))


def grams(rows: DataFrame, ids: list[str], lengths: list[int]) -> DataFrame:
    """ids and gram: the n-grams of each row's text for the lengths given, as often as they stand there."""
    tokens = rows.select(*ids, term_tokens(F.col("text")).alias("w"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.array(*[of(n) for n in lengths]))
    return tokens.select(*ids, F.explode(every).alias("gram"))


def hits(rows: DataFrame, ids: list[str], terms: DataFrame) -> DataFrame:
    """ids, term, target and times a term stands in the row's text, at word boundaries, case aside. The terms' lengths are few and read first."""
    known = keyed(terms)
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())  # as many as the longest term has tokens
    if not lengths:
        return rows.select(*ids).withColumns({"term": F.lit(""), "target": F.lit(""), "times": F.lit(0).cast("long")}).limit(0)
    # n-grams meet the terms before they are counted: where the terms fit a broadcast, only hits move
    met = grams(rows, ids, lengths).join(known.select("gram", "term", "target"), "gram")
    return met.groupBy(*ids, "term", "target").agg(F.count("*").alias("times"))


def usage(found: DataFrame) -> DataFrame:
    """Per term its occurrences and the rows it is in."""
    return found.groupBy("term").agg(F.sum("times").alias("hits"), F.count("*").alias("cues"))


def target_kept(found: DataFrame, translated: DataFrame, ids: list[str]) -> DataFrame:
    """Per term the rows in which it is said and those whose translation (ids, translated) holds its target, and their rate."""
    both = found.join(translated, ids).withColumn("kept", F.col("translated").contains(F.col("target")).cast("int"))
    return both.groupBy("term", "target").agg(F.count("*").alias("said"), F.sum("kept").alias("kept")).withColumn("rate", F.round(F.col("kept") / F.col("said"), 6))


def lookup(terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (term) with the target of the term of the same spelling, case aside; null where there is none."""
    by = terms.select(F.lower("term").alias("__low"), "target")
    return wanted.withColumn("__low", F.lower("term")).join(by, "__low", "left").drop("__low")
