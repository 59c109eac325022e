"""Misheard names: runs of one to three words that are nearly, but not exactly, a known name.

Runs meet the names of as many words on forms with letters left out on both sides (neighbours.py); no run is compared
with every name. What meets is measured by the built-in distance first, and few pairs reach the exact one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .neighbours import Shared, least_shared
from .similar import near_names

# fixed values: categories of names, and common words that are no misheard names
CATEGORIES = "character story_character character_alias".split()
COMMON = (
    "about after again almost because before being better coming could every first going great brand cover drifter flora hello marina maybe "
    "mortify morty never other pebble people really right sweetsweet should still their there these thing think those through today wanderer "
    "where which would"
).split()


def folded(name: Column) -> Column:
    """Lower-case Latin letters and digits, nothing else."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    above, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        over, above, row = above, row, [i + 1]
        for j, y in enumerate(b):
            ways = [above[j] + (x != y), above[j + 1] + 1, row[j] + 1]
            if i and j and x != y and (a[i - 1], x) == (y, b[j - 1]):
                ways.append(over[j - 1] + 1)
            row.append(min(ways))
    return row[-1]


@F.pandas_udf(IntegerType())
def measured(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edits (edits) of two words; no built-in function has them."""
    return pd.Series([edits(a, b) for a, b in zip(left, right, strict=True)], dtype="int32")


def runs(rows: DataFrame, ids: list[str], lengths: list[int]) -> DataFrame:
    """ids, run, word (the folded run), n, cased: a text's runs of as many words as lengths say, each folded form once, as it first stands there."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z][A-Za-z'’-]*)"))
    words = rows.select(*ids, w.alias("w"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        made = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.array_join(F.slice("w", i, n), " ").alias("run")))
        return F.when(F.size("w") >= n, made).otherwise(F.array().cast("array<struct<n:int,i:int,run:string>>"))

    every = words.select(*ids, F.explode(F.concat(*[of(n) for n in lengths])).alias("r")).withColumns({"word": folded(F.col("r.run")), "cased": F.col("r.run").rlike(r"(?:^| )[A-Z]")})
    said = every.where((F.length("word") >= F.when(F.col("cased"), 4).otherwise(6)) & ~F.col("word").isin(COMMON))
    return said.groupBy(*ids, "word").agg(F.min_by(F.struct("r.run", "r.n", "cased"), F.struct("r.n", "r.i")).alias("f")).select(*ids, "word", "f.*")


def shared_pairs(word: Column, cased: Column) -> Column:
    """Pairs of letters that a word shares with any name it may be: of those of the longer one an edit takes three at most, where it swaps neighbours."""
    n = F.length(word)
    return F.greatest(F.lit(1), F.array_min(F.transform(F.sequence(n, n + 2), lambda m: F.when(cased & (m > 5), m - 5).otherwise(m - 2))))


def _kind(n: str, cased: str) -> Column:
    return F.concat(F.col(n).cast("string"), F.lit(" "), F.col(cased).cast("string"))


def shared_letters(cased: bool) -> Shared:
    """Letters that a word shares with any name it may be: each edit takes one of the longer one's."""

    def of(n: int, w: int) -> int:
        if not cased:
            return max(max(n, w) - 1, least_shared(n, w, 0.85))
        short = max(n, w) <= 5
        return max(max(n, w) - (1 if short else 2), least_shared(n, w, 0.80 if short else 0.82))

    return of


def misheard(rows: DataFrame, ids: list[str], names: DataFrame, exact: DataFrame) -> DataFrame:
    """ids, run, term, target and ratio: the name a run is taken for.

    rows hold ids and text; names term, target and category; exact ids and term, names that stand in the text as they
    are. A run with a capital may be two edits off (one up to five letters), others one, with the same first letter. Of
    several names the most alike counts, unless the next one means something else and is less than 0.08 behind.
    Null and empty texts and names give nothing; a run that is exactly a name's folded form is its name.
    """
    known = names.where(F.col("category").isin(CATEGORIES) & ~F.col("term").contains("(")).select("term", "target", folded(F.col("term")).alias("name"), F.size(F.regexp_extract_all("term", F.lit("([A-Za-z]+)"))).alias("n")).where("name <> ''").distinct()
    lengths = sorted(r[0] for r in known.where("n BETWEEN 1 AND 3").select("n").distinct().collect())  # three numbers at most
    if not lengths:
        return rows.select(*ids).withColumns({"run": F.lit(""), "term": F.lit(""), "target": F.lit(""), "ratio": F.lit(0.0)}).limit(0)
    said = runs(rows, ids, lengths).join(exact.select(*ids, folded(F.col("term")).alias("word")).distinct(), [*ids, "word"], "left_anti")
    asked = said.select("word", "n", "cased").distinct()
    rules = {f"{n} {str(cased).lower()}": (shared_letters(cased), 2 if cased else 1) for n in lengths for cased in (True, False)}
    of_kind = known.where(F.col("n").isin(lengths)).select(F.explode(F.array(F.lit(True), F.lit(False))).alias("cased"), "n", "name")
    met = near_names(asked.select(_kind("n", "cased").alias("kind"), "word"), of_kind.select(_kind("n", "cased").alias("kind"), "name").distinct(), rules)
    kind = F.split("kind", " ")
    meets = met.select(kind[0].cast("int").alias("n"), kind[1].cast("boolean").alias("cased"), "word", "name", F.col("ratio").alias("alike")).join(known, ["n", "name"])
    longer, gap = F.greatest(F.length("word"), F.length("name")), F.abs(F.length("word") - F.length("name"))
    fits = F.when(F.col("cased"), gap <= 2).otherwise((gap <= 1) & (F.left("word", F.lit(1)) == F.left("name", F.lit(1))))
    short = longer <= 5
    most = F.when(F.col("cased") & ~short, 2).otherwise(1)
    least = F.when(~F.col("cased"), 0.85).when(short, 0.80).otherwise(0.82)
    # a swap of neighbours counts twice in the built-in measure, which leaves few pairs to Python
    close = F.levenshtein("word", "name", 4) <= F.when(F.col("cased"), 4).otherwise(2)
    near = meets.where(fits & close & (F.levenshtein("word", "name", 4) >= 0) & (F.col("alike") >= least)).distinct().withColumn("m", F.struct(measured("word", "name").alias("edits"), F.col("alike").alias("ratio"))).where(F.col("m.edits") <= most)
    order = Window.partitionBy("word", "n", "cased").orderBy(F.desc("m.ratio"), F.asc("m.edits"), F.desc("term"), F.desc("target"))
    ranked = near.withColumns({"k": F.row_number().over(order), "next": F.lead(F.struct("target", "m.ratio")).over(order)}).where("k = 1")
    sure = F.col("next").isNull() | F.col("next.target").eqNullSafe(F.col("target")) | (F.col("m.ratio") - F.col("next.ratio") >= 0.08)
    taken = ranked.where(sure).select("word", "n", "cased", "term", "target", F.col("m.ratio").alias("ratio"))
    return said.join(taken, ["word", "n", "cased"]).select(*ids, "run", "term", "target", "ratio")
