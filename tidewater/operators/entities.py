"""Names and terms in texts: glossary extraction by language, entity candidates, and English names put as the glossary has them.

All of it stands on the automaton's occurrences (automaton.py) and on joins of distinct words (similar.py); what is left to
Python looks at one text and its own occurrences. ids are columns that tell rows apart; null texts hold nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import MOST_ROWS, Found, leftmost_longest, longest_first, occurrences, outside_longer, replaced
from .carry import settled
from .similar import heard_as

# fixed values: title-case runs, addresses, words that announce a sponsor
TITLE_RUN = re.compile(r"\b[A-Z][a-z]{2,}(?:[ -][A-Z][a-z]{2,})*\b")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
ANNOUNCED = re.compile(r"(?:sponsored\s+by|sponsor(?:ed)?|brought\s+to\s+you\s+by|thanks\s+to|check\s+out|visit|download|try|use(?:\s+code)?)[\s:,-]{0,12}$", re.IGNORECASE)
# fixed values: words that no unknown name holds
STOP_WORDS = (
    "A", "Actually", "An", "And", "Because", "Boss", "But", "Check", "Dps", "Boy", "Brother", "Dad", "Dude", "Everyone", "Father", "Finally", "Friend", "Get", "Girl", "Guy",
    "He", "Hello", "Here", "How", "Hp", "I", "It", "Look", "Make", "Man", "Maybe", "My", "No", "Oh", "Okay", "Kid", "Mom", "Mother", "Our", "Please", "See", "She", "Sister", "Someone",
    "Take", "That", "The", "Their", "Then", "There", "Think", "These", "They", "This", "Those", "Today", "Tomorrow", "Watch", "We", "What", "When", "Where", "Who", "Why", "Woman",
    "Wow", "Yes", "You", "Your", "Bro", "God", "Hey", "Jesus", "Jim", "Like", "Lily", "Rome",
)
GAME_WORDS = ("DPS", "HP", "BOSS")  # fixed values
CONTEXT = 48
#: Texts whose occurrences a task holds as Python objects at once.
TEXTS = 64


def searchable(text: str) -> str:
    """Compatibility form with addresses blanked."""
    return ADDRESS.sub(lambda m: " " * len(m[0]), unicodedata.normalize("NFKC", text))


def contextual(text: str) -> list[tuple[int, int]]:
    """Spans of title-case phrases of one word repeated, right behind an announcement."""
    out = []
    for m in TITLE_RUN.finditer(text):
        words = m[0].replace("-", " ").lower().split()
        if len(words) > 1 and len(set(words)) == 1 and ANNOUNCED.search(text[max(0, m.start() - CONTEXT) : m.start()]):
            out.append(m.span())
    return out


def _every(found: list[Found]) -> list[Found]:
    return found


def _id_schema(rows: DataFrame, ids: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids)


def _with_spans(rows: DataFrame, ids: list[str], spans: DataFrame) -> DataFrame:
    """ids, text and spans: a text's own occurrences."""
    own = spans.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("start", "end", "term", "target"))).alias("spans"))
    return rows.select(*ids, "text").join(own, ids, "left")


def _settled(with_spans: DataFrame, ids: list[str], made: dict[str, str], settle: Callable[[str, list[dict] | None], Iterator[tuple]]) -> DataFrame:
    """ids and the columns `made` (names and types, string or int) that `settle` makes of each text and its spans; few texts are Python objects at a time, the others stay in Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [*batch.schema.types[: len(ids)], *(pa.int32() if k == "int" else pa.string() for k in made.values())]
            parts = (batch.slice(lo, TEXTS) for lo in range(0, batch.num_rows, TEXTS))
            texts = (r for part in parts for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
            rows = ((*key, *m) for *key, text, spans in texts for m in settle(text, spans))
            for some in batched(rows, MOST_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], [*ids, *made])

    return with_spans.mapInArrow(run, ", ".join([_id_schema(with_spans, ids), *(f"{c} {k}" for c, k in made.items())]))


def _found(spans) -> list[Found]:
    return [Found(s["start"], s["end"], s["term"], s["target"], (1 << 20) - len(s["term"])) for s in (spans if spans is not None else [])]


def extract(rows: DataFrame, ids: list[str], terms: DataFrame, language: str = "en", **bound) -> DataFrame:
    """ids, term, target, times: glossary terms that a text holds.

    en: at boundaries of letters and digits, case aside, white space as it comes; longer terms first, spans exclusive, announced phrases left out.
    ja: in compatibility form, anywhere; ko: likewise, but not right behind a Korean syllable; both without terms that a longer term found there contains."""
    if language in ("ja", "ko"):
        spans = occurrences(rows, ids, terms, "compatible" if language == "ja" else "hangul", outside_longer, **bound)
        return spans.groupBy(*ids, "term", "target").agg(F.count("*").alias("times"))
    spans = occurrences(rows, ids, terms, "spaced", _every, **bound)

    def settle(text: str, own: list[dict]) -> Iterator[tuple]:
        found = _found(own)
        if found and (phrases := {text[s:e] for s, e in contextual(searchable(text))}):
            masked = [m.span() for p in phrases for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(p)}(?![A-Za-z0-9])".replace(r"\ ", r"\s+"), text, re.IGNORECASE)]
            found = [f for f in found if not any(f.start < e and f.end > s for s, e in masked)]
        yield from ((f.term, f.target) for f in longest_first(found))

    kept = _settled(_with_spans(rows, ids, spans).where("spans IS NOT NULL"), ids, {"term": "string", "target": "string"}, settle)
    return kept.groupBy(*ids, "term", "target").agg(F.count("*").alias("times"))


def candidates(rows: DataFrame, ids: list[str], terms: DataFrame, ordinary: DataFrame | None = None, **bound) -> DataFrame:
    """ids, start, surface, term, target, class: English entities of a text, none over another: announced phrases, then terms (three letters or more, with a target), longest first, then unknown title-case runs.

    ordinary: (word) lower-case words that, alone, are no unknown name. Phrases and unknown runs stand once a text."""
    texts = rows.select(*ids, F.col("text").cast("string").alias("text"))

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(text=[searchable(t or "") for t in frame["text"]])

    texts = texts.mapInPandas(folded, f"{_id_schema(rows, ids)}, text string")
    useful = terms.select(F.trim("term").alias("term"), F.trim("target").alias("target")).where("length(term) >= 3 AND target <> ''")
    spans = occurrences(texts, ids, useful, "spaced", _every, **bound)

    def settle(text: str, own: list[dict] | None) -> Iterator[tuple]:
        taken, seen = contextual(text), set()
        for s, e in taken:
            if text[s:e].casefold() not in seen:
                seen.add(text[s:e].casefold())
                yield s, text[s:e], "", "", "contextual_entity"
        free = [f for f in _found(own) if not any(f.start < e and f.end > s for s, e in taken)]
        for f in longest_first(free):
            taken.append((f.start, f.end))
            yield f.start, text[f.start : f.end], f.term, f.target, "known_entity"
        seen = set()
        for m in TITLE_RUN.finditer(text):
            words = m[0].replace("-", " ").split()
            if any(m.start() < e and m.end() > s for s, e in taken) or m[0].casefold() in seen or any(w in STOP_WORDS or w.upper() in GAME_WORDS for w in words):
                continue
            seen.add(m[0].casefold())
            yield m.start(), m[0], "", "", "possible_entity"

    out = _settled(_with_spans(texts, ids, spans), ids, {"start": "int", "surface": "string", "term": "string", "target": "string", "class": "string"}, settle)
    plain = F.lower(F.regexp_replace("surface", "[^A-Za-z]", ""))
    unknown = out.where("class = 'possible_entity' AND NOT surface RLIKE '[ -]'").withColumn("__word", plain)
    unknown = unknown.where(~F.col("__word").isin([w.lower() for w in STOP_WORDS]))
    if ordinary is not None:
        unknown = unknown.join(ordinary.select(F.col("word").alias("__word")).distinct(), "__word", "left_anti")
    return out.where("class <> 'possible_entity' OR surface RLIKE '[ -]'").unionByName(unknown.drop("__word"))


def alias_spans(rows: DataFrame, ids: list[str], aliases: DataFrame, terms: DataFrame, **bound) -> DataFrame:
    """ids, start, end, term, target: hearings (aliases: term, target) of terms of the glossary, from left to right the longest; the target is spelled as the glossary has it."""
    spelled = terms.select(F.col("term").alias("target"), F.lower("term").alias("__low")).groupBy("__low").agg(F.max("target").alias("target"))
    known = aliases.select("term", F.lower("target").alias("__low")).join(spelled, "__low").select(F.lower("term").alias("term"), "target")
    return occurrences(rows, ids, known, "spaced", leftmost_longest, **bound)


def form_spans(rows: DataFrame, ids: list[str], terms: DataFrame, **bound) -> DataFrame:
    """ids, start, end, term, target (the term): the glossary's terms with other signs, white space or case between and in their letters, from left to right the longest."""
    return occurrences(rows, ids, terms.select("term", F.col("term").alias("target")).where(F.col("term").rlike("[A-Za-z0-9]")), "parts", leftmost_longest, **bound)


def attached(rows: DataFrame, ids: list[str], terms: DataFrame) -> DataFrame:
    """ids, i, surface, term: words that are a one-word name with up to three letters behind or two before it (with a capital somewhere), or without its first letter
    (from five letters on), if one name alone fits; i is the word's place among the text's runs of letters and of other characters."""
    names = terms.where(F.col("term").rlike("^[A-Z][A-Za-z]{4,}$")).select("term", F.lower("term").alias("__key")).distinct()
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+|[^A-Za-z]+)"))
    words = rows.select(*ids, F.posexplode(runs).alias("i", "surface")).where(F.col("surface").rlike("^[A-Za-z]"))
    distinct = words.select("surface").distinct()
    low, n, cased = F.lower("surface"), F.length("surface"), F.col("surface").rlike("[A-Z]")
    cut = lambda start, length: F.when(cased & (length >= 5), F.substring(low, start, length))
    keys = F.array(*[cut(F.lit(1), n - k) for k in (1, 2, 3)], *[cut(F.lit(k + 1), n - k) for k in (1, 2)])
    by_key = distinct.select("surface", F.explode(F.array_compact(keys)).alias("__key")).join(names, "__key").select("surface", "term")
    headless = names.select("term", F.expr("substring(__key, 2)").alias("__key")).where("length(__key) >= 5")
    met = by_key.unionByName(distinct.withColumn("__key", low).join(headless, "__key").select("surface", "term")).distinct()
    sure = met.groupBy("surface").agg(F.count("*").alias("n"), F.min("term").alias("term")).where("n = 1").drop("n")
    return words.join(sure, "surface").select(*ids, "i", "surface", "term")


def _swapped(rows: DataFrame, ids: list[str], swaps: DataFrame) -> DataFrame:
    """rows with the runs of letters named by swaps (ids, i, term) put as their terms."""
    own = swaps.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("i", "term"))).alias("__swaps"))
    runs = F.regexp_extract_all(F.col("text"), F.lit("([A-Za-z]+|[^A-Za-z]+)"))
    text = F.when(F.col("__swaps").isNull(), F.col("text")).otherwise(F.array_join(F.transform(runs, lambda r, i: F.coalesce(F.element_at("__swaps", i), r)), ""))
    return rows.join(own, ids, "left").withColumn("text", text).drop("__swaps")


def normalised(rows: DataFrame, ids: list[str], terms: DataFrame, aliases: DataFrame, **bound) -> DataFrame:
    """ids, text, canonical, confidence, reasons: texts with the glossary's names put right.

    In this order: known hearings, other forms, words with a name attached, names that one or two words are nearly (heard_as, where a surface of a text has one name).
    confidence is high where anything was put, else medium where a surface has several names, else low. canonical and reasons are distinct, in the order in which they were found.
    What each step finds and puts is kept, as later steps read it several times."""
    now = rows.select(*ids, F.col("text").cast("string").alias("text"))
    first = settled(alias_spans(now, ids, aliases, terms, **bound))
    noted = [first.select(*ids, F.lit(1).alias("stage"), F.lit(0).alias("rank"), F.col("start").alias("at"), F.col("target").alias("name"), F.lit("evidence-alias").alias("reason"))]
    now = settled(replaced(now, ids, first))
    forms = settled(form_spans(now, ids, terms, **bound))
    seen = forms.join(now, ids).withColumn("surface", F.expr("substring(text, start + 1, end - start)"))
    kind = F.when(F.col("surface") == F.col("target"), "exact").when(F.lower("surface") == F.lower("target"), "case-normalized").otherwise("punctuation-normalized")
    noted.append(seen.select(*ids, F.lit(2).alias("stage"), (-F.length("target")).alias("rank"), F.col("start").alias("at"), F.col("target").alias("name"), kind.alias("reason")))
    now = settled(replaced(now, ids, forms))
    swaps = settled(attached(now, ids, terms))
    noted.append(swaps.select(*ids, F.lit(3).alias("stage"), F.lit(0).alias("rank"), F.col("i").alias("at"), F.col("term").alias("name"), F.lit("unique-affix-stripping").alias("reason")))
    now = settled(_swapped(now, ids, swaps))
    every_heard = settled(heard_as(now, ids, terms).groupBy(*ids, F.lower("surface").alias("low")).agg(F.countDistinct("term").alias("n"), F.min("term").alias("term")))
    heard, unsure = every_heard.where("n = 1").drop("n"), every_heard.where("n > 1").select(*ids).distinct().withColumn("__unsure", F.lit(True))
    place = heard.join(now, ids).withColumn("at", F.expr("instr(lower(text), low) - 1"))
    noted.append(place.select(*ids, F.lit(4).alias("stage"), F.lit(0).alias("rank"), "at", F.col("term").alias("name"), F.lit("unique-similarity-canonicalized").alias("reason")))
    own = heard.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct((-F.length("low")).alias("size"), "low", "term"))).alias("__heard"))
    # one surface after another, the longest first, case aside, between characters that are no letters
    put = F.aggregate("__heard", F.col("text"), lambda t, h: F.call_function("regexp_replace", t, F.concat(F.lit("(?i)(?<![A-Za-z])"), h["low"], F.lit("(?![A-Za-z])")), h["term"]))
    now = now.join(own, ids, "left").withColumn("text", F.when(F.col("__heard").isNull(), F.col("text")).otherwise(put)).drop("__heard")
    every = noted[0]
    for some in noted[1:]:
        every = every.unionByName(some)
    told = every.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("stage", "rank", "at", "name", "reason"))).alias("__told"))
    out = now.join(told, ids, "left").join(unsure, ids, "left")
    return out.select(*ids, "text", F.coalesce(F.array_distinct(F.col("__told.name")), F.array().cast("array<string>")).alias("canonical"), F.when(F.col("__told").isNotNull(), "high").when(F.col("__unsure"), "medium").otherwise("low").alias("confidence"),
                      F.coalesce(F.array_join(F.array_distinct(F.col("__told.reason")), ", "), F.when(F.col("__unsure"), "token-similarity-advisory"), F.lit("unknown")).alias("reasons"))
