"""Words and names that are nearly alike: joins on few of their pairs of letters, then exact measures.

Two words within a number of edits share a number of pairs of neighbouring letters (with marks at both ends); so of a
word's pairs, the rarest ones that are left when that number less one is taken off must hold one of the other's. Only
those meet the names' pairs, which keeps pairs that half the words have out of the join. What meets is measured exactly:
edits by the built-in function, the share of matching blocks (as in Ratcliff and Obershelp's measure) by arrays. Names that
are short of few letters or have few more are met on forms with letters left out instead (neighbours.py).

Null and empty words and names meet nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import Names, Shared, least_shared
from .stretches import Stretches, spans

#: Bytes of names that one task takes.
MOST_BYTES = 8 << 20
MARGIN = 0.08


def pairs_of(word: Column) -> Column:
    """Pairs of neighbouring characters, the word's ends marked."""
    w = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))


def near_pairs(asked: DataFrame, names: DataFrame, shared: Column, same: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (word, name) of asked (word) and names (name) that may share `shared` of the word's pairs at least (a column over asked; 1 or more).

    same: columns that asked and names both have and that must agree. carry: columns of asked that come along."""
    by = list(same)
    own_key = [*by, *carry, "word"]
    words, known = asked.select(own_key + [shared.alias("__shared")]).where("word <> ''").distinct(), names.select(*by, "name").where("name <> ''").distinct()
    theirs = known.select(*by, "name", F.explode(F.array_distinct(pairs_of(F.col("name")))).alias("pair"))
    rare = theirs.groupBy(*by, "pair").agg(F.count("*").alias("__n"))
    own = words.select(*own_key, (F.length("word") + 2 - F.col("__shared")).alias("__most"), F.posexplode(pairs_of(F.col("word"))).alias("__i", "pair")).join(rare, [*by, "pair"], "left")
    order = Window.partitionBy(*own_key).orderBy(F.coalesce("__n", F.lit(0)), "pair", "__i")
    prefix = own.withColumn("__k", F.row_number().over(order)).where((F.col("__k") <= F.col("__most")) & F.col("__n").isNotNull())
    return prefix.select(*own_key, "pair").distinct().join(theirs, [*by, "pair"]).select(*own_key, "name").distinct()


Search = Callable[[Iterator[pd.DataFrame], list[tuple]], Iterator[pd.DataFrame]]


def dealt(rows: DataFrame, known: DataFrame, search: Search, schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """What `search` makes of all rows and all known: a task holds known of most_bytes; where there are more, every group of them meets all rows."""
    size = known.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in known.columns), F.lit(64)))).first()[0] or 0
    if size <= most_bytes:
        held = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])  # most_bytes at most
        # small tables lie in few parts
        return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(lambda frames: search(frames, held.value), schema)
    groups, n = -(-size // most_bytes), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-n // groups))
    group = F.pmod(F.xxhash64(*known.columns), F.lit(groups)).cast("int")
    keys = [f"__k{i}" for i in range(len(known.columns))]
    # what a side lacks is no null, which would turn whole numbers into broken ones in pandas
    told = known.select(group.alias("__group"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"), F.lit(False).alias("__asks"), *[F.col(c).alias(k) for c, k in zip(known.columns, keys, strict=True)], *[F.lit("0").cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    sent = rows.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group"), salt.alias("__salt"), F.lit(True).alias("__asks"), *[F.lit("0").cast(known.schema[c].dataType).alias(k) for c, k in zip(known.columns, keys, strict=True)], *rows.columns)
    met = told.unionByName(sent)
    met = met.repartition(n, "__group", "__salt").sortWithinPartitions("__group", "__salt", "__asks")
    names = rows.columns

    def grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (kp for frame in frames for kp in frame.groupby(["__group", "__salt"], sort=True))
        for _, own_parts in groupby(parts, key=lambda kp: kp[0]):
            own: list[tuple] = []

            def asked(own_parts=own_parts, own=own) -> Iterator[pd.DataFrame]:
                for _, part in own_parts:
                    asks = part["__asks"].to_numpy(bool)
                    own += list(part.loc[~asks, keys].itertuples(index=False, name=None))
                    if asks.any():
                        yield part.loc[asks, names]

            each = asked()
            # a group's known come before its rows, so that one search takes all of these
            for first in each:
                yield from search(chain([first], each), own)

    return met.mapInPandas(grouped, schema)


def near_names(asked: DataFrame, names: DataFrame, shared: dict[str, tuple[Shared, int]], most_bytes: int = MOST_BYTES) -> DataFrame:
    """kind, word, name, ratio: distinct words (kind, word) that have as many letters of a name (kind, name) as their kind's rule says, in order, and the share of their matching blocks.

    shared: by kind the letters that a name and a word of given lengths share at least, and how many letters more or less a word has at most."""

    def search(frames: Iterator[pd.DataFrame], own: list[tuple[str, str]]) -> Iterator[pd.DataFrame]:
        held = {kind: Names([name for k, name in own if k == kind], *rule) for kind, rule in shared.items()}
        for frame in frames:
            for kind, part in frame.groupby("kind"):
                words, index = list(part["word"]), held[kind]
                lengths = np.array([len(n) for n in index.names], np.int64)
                for at, found, share in index.near(words):
                    told = [words[k] for k in at]
                    ratio = 2.0 * share / (lengths[found] + np.array([len(t) for t in told], np.int64))
                    yield pd.DataFrame({"kind": kind, "word": told, "name": [index.names[k] for k in found], "ratio": ratio}).astype({"kind": object, "word": object, "name": object})

    return dealt(asked.where("word <> ''"), names.where("name <> ''"), search, "kind string, word string, name string, ratio double", most_bytes)


# fixed values: how much alike audited words and known ones are at least, and from where on they surely are
ALIKE, SURELY = 0.6, 0.75
#: Scripts that audited words are written in: of letters, with their least and greatest number.
WORDS = {"en": "[A-Za-z]{3,12}", "ko": "[가-힣]{2,6}", "ja": "[ァ-ン]{2,8}"}  # fixed values
KEPT = {"en": "[^a-z]", "ko": "[^가-힣]", "ja": "[^ぁ-んァ-ン]"}  # fixed values: what a known word loses before it is compared


def audited(rows: DataFrame, known: DataFrame, language: str = "en", least: int = 3, file: str = "track") -> DataFrame:
    """word, files, match, similarity, band: words that `least` files or more hold and that aren't known.

    rows: file and text; known: term. A word counts once a file. similarity is 1 - edits / the longer length, of the most alike known word (of several the first),
    null below ALIKE; band is high from SURELY on, medium from ALIKE on, else low. Words with other letters are compared without them."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORDS[language]})"))
    found = F.transform(found, lambda w: F.lower(w)) if language == "en" else found
    said = rows.select(file, F.explode(F.array_distinct(found)).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("files")).where(F.col("files") >= least)
    low = known.select(F.lower("term").alias("name")).where("name <> ''").distinct()
    asked = said.join(low, F.col("word") == F.col("name"), "left_anti")
    bare = low if language == "en" else low.select(F.regexp_replace("name", KEPT[language], "").alias("name")).where("name <> ''").distinct()
    # with m letters in the longer word at most 0.4 m edits are left, and m + 1 - 2 * edits pairs shared
    n = F.length("word")
    shared = F.array_min(F.transform(F.sequence(n, F.floor(n / ALIKE).cast("int")), lambda m: m + 1 - 2 * F.floor(m * F.lit(1 - ALIKE) + F.lit(1e-9)).cast("int")))
    longer = F.greatest(n, F.length("name"))
    edits = F.levenshtein("word", "name")
    alike = near_pairs(asked, bare, F.greatest(shared, F.lit(1))).where(F.least(n, F.length("name")) >= longer * 0.5).withColumn("similarity", 1 - edits / longer).where(F.col("similarity") >= ALIKE - 1e-9)
    best = alike.groupBy("word").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "name")).alias("b"))
    out = asked.join(best, "word", "left").select("word", "files", F.col("b.name").alias("match"), F.round(-F.col("b.s"), 3).alias("similarity"))
    return out.withColumn("band", F.when(F.col("similarity") >= SURELY, "high").when(F.col("similarity").isNotNull(), "medium").otherwise("low"))


# fixed values: words that no half of a name's two-word hearing is
FUNCTION_WORDS = (
    "a an and are at but by did for had has have he her his in is it met my not of on or our she that the their then they this to was were with your"
).split()


def letters(text: Column) -> Column:
    """Latin letters and digits in lower case, nothing else."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def heard_as(rows: DataFrame, ids: list[str], names: DataFrame) -> DataFrame:
    """ids, surface, term: names that a capitalised word, or two words one after another, of a text are nearly.

    names: term; those of one word, with five letters or more and a capital, take part. One word is at most two edits off, with a ratio of 0.82 at least;
    two words, neither a function word nor of one letter, at most three, with at most two letters more or less, and either two edits or a ratio of 0.72.
    Of several names the most alike counts (then the fewest edits, then the last by name) unless the next is less than MARGIN behind. A surface stands once a text."""
    known = names.where(F.col("term").rlike("^[A-Z][A-Za-z]{4,}$")).select("term", letters(F.col("term")).alias("name")).distinct()
    text = F.coalesce("text", F.lit(""))
    one = F.filter(F.regexp_extract_all(text, F.lit("(?<![A-Za-z])([A-Za-z]{5,})(?![A-Za-z])")), lambda w: w.rlike("^[A-Z]"))
    two = F.regexp_extract_all(text, F.lit("(?<![A-Za-z])([A-Za-z]+[ -][A-Za-z]+)(?![A-Za-z])"))
    plain = lambda w: F.forall(F.split(w, " "), lambda x: (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 2) & ~F.lower(x).isin(FUNCTION_WORDS))
    said = rows.select(*ids, F.explode(F.array_distinct(F.concat(F.transform(one, lambda w: F.struct(F.lit(1).alias("n"), w.alias("surface"))), F.transform(F.filter(two, plain), lambda w: F.struct(F.lit(2).alias("n"), w.alias("surface")))))).alias("x"))
    said = said.select(*ids, "x.n", "x.surface", letters(F.col("x.surface")).alias("word")).where("n = 1 OR length(word) >= 4")
    asked = said.select("n", "word").distinct()
    most = lambda n, w: max(n, w)
    within = {1: lambda n, w: max(most(n, w) - 2, least_shared(n, w, 0.82)), 2: lambda n, w: min(most(n, w) - 2, max(most(n, w) - 3, least_shared(n, w, 0.72)))}
    close = near_names(asked.select(F.col("n").cast("string").alias("kind"), "word"), known.select(F.explode(F.array(F.lit("1"), F.lit("2"))).alias("kind"), "name").distinct(), {str(k): (f, 2) for k, f in within.items()})
    close = close.select(F.col("kind").cast("int").alias("n"), "word", "name", "ratio").withColumn("edits", F.levenshtein("word", "name"))
    met = close.join(known, "name")
    fits = F.when(F.col("n") == 1, (F.col("edits") <= 2) & (F.col("ratio") >= 0.82) & (F.col("word") != F.col("name"))).otherwise((F.col("edits") <= 2) | ((F.col("edits") <= 3) & (F.col("ratio") >= 0.72)))
    order = Window.partitionBy("n", "word").orderBy(F.desc("ratio"), "edits", F.desc("term"))
    first = met.where(fits).withColumns({"k": F.row_number().over(order), "next": F.lead("ratio").over(order)}).where("k = 1")
    sure = first.where(F.col("next").isNull() | (F.col("ratio") - F.col("next") >= MARGIN)).select("n", "word", "term")
    return said.join(sure, ["n", "word"]).select(*ids, "surface", "term").distinct()


# --- terms that nearly stand in an unsegmented text


def compact(text: str | None) -> str:
    """Letters and digits of the compatibility form."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "") if c.isalnum())


def _compacted(column: str, schema: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(compact=[compact(t) for t in frame[column]])

    return lambda df: df.mapInPandas(run, f"{schema}, compact string")


def nearly_in(rows: DataFrame, ids: list[str], terms: DataFrame, least: float = 0.78, most_bytes: int = MOST_BYTES) -> DataFrame:
    """ids, term, target, surface, confidence: terms that don't stand in a text, with the stretch of it that is most like each, if alike enough.

    rows: ids and text; terms: term and target, of three letters or more. Texts and terms are compared without white space and signs, in compatibility form.
    Of terms that fold alike with one target the first counts."""
    id_schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids)
    texts = rows.select(*ids, F.col("text").cast("string").alias("text")).transform(_compacted("text", f"{id_schema}, text string")).select(*ids, F.col("compact").alias("body")).where("body <> ''")
    known = terms.select(F.col("term").cast("string").alias("term"), F.col("target").cast("string").alias("target")).where("target <> ''").transform(_compacted("term", "term string, target string")).where("length(compact) >= 3").groupBy(F.col("compact").alias("name"), "target").agg(F.min("term").alias("term"))
    schema = f"{id_schema}, term string, target string, surface string, confidence double"
    at = [*ids, "term", "target", "surface", "confidence"]

    def search(frames: Iterator[pd.DataFrame], own: list[tuple[str, str, str]]) -> Iterator[pd.DataFrame]:
        by_name: dict[str, list[tuple[str, str]]] = {}
        for name, target, term in own:
            by_name.setdefault(name, []).append((term, target))
        index = Stretches(list(by_name), least)
        told = [t for n in by_name.values() for t in n]
        terms, targets = (pa.array([t[i] for t in told], pa.string()) for i in (0, 1))
        many = np.array([len(n) for n in by_name.values()], np.int64)
        first = np.cumsum(many) - many
        for frame in frames:
            for which, name, surface, share, both in index.best(list(frame["body"])):
                often = many[name]
                k = spans(first[name], often)
                made = frame[ids].take(np.repeat(which, often)).reset_index(drop=True)
                again = surface.take(pa.array(np.repeat(np.arange(len(name)), often))) if len(k) > len(name) else surface
                strings = {"term": terms.take(pa.array(k)), "target": targets.take(pa.array(k)), "surface": again}
                confidence = (4000 * share + both) // (2 * both) / 1000  # the ratio 2 share / both to three places, halves up
                # strings stay Arrow's on their way to Spark
                yield made.assign(**{c: pd.Series(pd.arrays.ArrowExtensionArray(v)) for c, v in strings.items()}, confidence=np.repeat(confidence, often))[at]

    return dealt(texts, known.select("name", "target", "term"), search, schema, most_bytes)
