"""Many terms in texts of any script: all occurrences by an automaton with suffix links, then those that may stand side by side.

Texts and terms meet in a view: lower-cased with white space folded, letters and digits with one mark between them, or
compatibility forms (NFKC). While the terms' bytes stay within a bound, every task builds one automaton of all of them.
Beyond it, terms are dealt into groups by their first characters, a text goes to the groups of which it has a head, and a
task builds one group's automaton; a salt spreads a group's texts. Both ways find the same occurrences.

Null and empty texts and terms have no occurrences; terms that come twice with one target count once.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms and targets that one automaton takes, and rows that a task makes at once, however many its texts hold.
MOST_BYTES = 8 << 20
MOST_ROWS = 8192
BREAK = "\x1f"
HANGUL = ("가", "힯")  # fixed value: syllables between which no Korean term begins


@dataclass(frozen=True, slots=True)
class Found:
    """An occurrence: places in the text, the term, its target and its place in the order of all terms."""

    start: int
    end: int
    term: str
    target: str | None
    rank: int


def spaced(text: str) -> tuple[str, list[int]]:
    """Lower-cased, a run of white space as one space; and each character's place in the text, with the text's end last."""
    out, at = [], []
    for i, c in enumerate(text):
        c = " " if c.isspace() else c.lower() if len(c.lower()) == 1 else c
        if c != " " or not out or out[-1] != " ":
            out.append(c)
            at.append(i)
    return "".join(out), [*at, len(text)]


def parts(text: str) -> tuple[str, list[int]]:
    """Latin letters and digits in lower case, one mark for whatever stands between them, before and after."""
    out, at = [BREAK], [0]
    for i, c in enumerate(text):
        if c.isascii() and c.isalnum():
            out.append(c.lower())
            at.append(i)
        elif out[-1] != BREAK:
            out.append(BREAK)
            at.append(i)
    if out[-1] != BREAK:
        out.append(BREAK)
        at.append(len(text))
    return "".join(out), [*at, len(text)]


def compatible(text: str) -> tuple[str, list[int]]:
    """NFKC; places are those in this form."""
    made = unicodedata.normalize("NFKC", text)
    return made, list(range(len(made) + 1))


VIEWS: dict[str, Callable[[str], tuple[str, list[int]]]] = {"spaced": spaced, "parts": parts, "compatible": compatible, "hangul": compatible}


def _alone(view: str, text: str, start: int, end: int) -> bool:
    """Whether an occurrence stands where its view lets a term stand."""
    if view == "spaced":
        outer = text[start - 1 : start] + text[end : end + 1]
        return not any(c.isascii() and c.isalnum() for c in outer)
    return view != "hangul" or not start or not HANGUL[0] <= text[start - 1] <= HANGUL[1]


def key_of(term: str, view: str) -> str:
    made = VIEWS[view](term.strip())[0]
    return "" if view == "parts" and made == BREAK else made


class Terms:
    """Terms in a view, ready to be found. A rank orders them: longer ones first, then as they sort."""

    def __init__(self, terms: list[tuple[str, str | None, int]], view: str):
        self.view, self.known = view, {}
        for term, target, rank in terms:
            if key := key_of(term, view):
                self.known.setdefault(key, []).append((term, target, rank))
        self.automaton = ahocorasick.Automaton()
        for key in self.known:
            self.automaton.add_word(key, key)
        self.automaton.make_automaton()

    def found(self, text: str | None) -> list[Found]:
        if not text or not self.known:
            return []
        seen, at = VIEWS[self.view](text)
        out = []
        inner = self.view == "parts"  # the marks around a term aren't its own
        for last, key in self.automaton.iter(seen):
            start, end = last + 1 - len(key), last + 1
            if _alone(self.view, seen, start, end):
                lo, hi = (at[start + 1], at[end - 2] + 1) if inner else (at[start], at[end - 1] + 1)
                out += [Found(lo, hi, term, target, rank) for term, target, rank in self.known[key]]
        return out


Pick = Callable[[list[Found]], list[Found]]


def longest_first(found: list[Found]) -> list[Found]:
    """Occurrences that overlap none of a term of lower rank; one term's own follow each other without overlap."""
    taken: list[tuple[int, int]] = []  # in order, without overlap
    out = []
    by_term: dict[tuple[int, str], list[Found]] = {}
    for f in sorted(found, key=lambda f: (f.rank, f.start)):
        by_term.setdefault((f.rank, f.term), []).append(f)
    for own in by_term.values():
        upto = 0
        for f in own:
            if f.start < upto:
                continue
            upto = f.end
            k = bisect_left(taken, (f.start, f.end))
            if (k == 0 or taken[k - 1][1] <= f.start) and (k == len(taken) or taken[k][0] >= f.end):
                taken.insert(k, (f.start, f.end))
                out.append(f)
    return out


def leftmost_longest(found: list[Found]) -> list[Found]:
    """From left to right the longest occurrence, of several the lowest rank, then on behind it."""
    out: list[Found] = []
    for f in sorted(found, key=lambda f: (f.start, f.start - f.end, f.rank)):
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def outside_longer(found: list[Found]) -> list[Found]:
    """Occurrences of terms that no longer term found in the text contains; one term's own without overlap."""
    out: list[Found] = []
    held: list[str] = []
    by_term: dict[tuple[int, str], list[Found]] = {}
    for f in sorted(found, key=lambda f: (f.rank, f.start)):
        by_term.setdefault((f.rank, f.term), []).append(f)
    for (_, term), own in by_term.items():
        if any(term in longer for longer in held):
            continue
        held.append(term)
        upto = 0
        for f in own:
            if f.start >= upto:
                out.append(f)
                upto = f.end
    return out


def frames_of(made: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as they are made, in frames of MOST_ROWS at most."""
    for some in batched(made, MOST_ROWS):
        yield pd.DataFrame(some, columns=names)


def ranked(terms: DataFrame) -> DataFrame:
    """(term, target) -> term, target, rank: rank ascends with falling length; of one length and term, targets sort."""
    clean = terms.where(F.trim("term") != "").select("term", F.col("target").cast("string").alias("target")).groupBy("term").agg(F.min("target").alias("target"))
    return clean.withColumn("rank", F.lit(1 << 20) - F.least(F.length("term"), F.lit((1 << 20) - 1)))


def occurrences(rows: DataFrame, ids: list[str], terms: DataFrame, view: str, pick: Pick, most_bytes: int = MOST_BYTES) -> DataFrame:
    """ids, start, end, term, target of the occurrences that `pick` leaves of a text's. rows: ids, unique together, and text."""
    known = ranked(terms)
    size = known.agg(F.sum(F.octet_length("term") + F.coalesce(F.octet_length("target"), F.lit(0)) + 64)).first()[0] or 0
    texts = rows.select(*ids, F.col("text").cast("string").alias("text"))
    id_schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids)
    schema = f"{id_schema}, start int, end int, term string, target string"
    names = [*ids, "start", "end", "term", "target"]

    if size <= most_bytes:
        held = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])  # most_bytes at most

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Terms(held.value, view)
            for frame in frames:
                yield from frames_of(((*r[:-1], f.start, f.end, f.term, f.target) for r in frame.itertuples(index=False, name=None) for f in pick(own.found(r[-1]))), names)

        return texts.mapInPandas(run, schema)
    return _dealt(texts, ids, known, view, pick, -(-size // most_bytes), schema, id_schema)


def _heads(key: str) -> set[str]:
    return {key[i : i + 2] for i in range(len(key) - 1)} | set(key)


def _dealt(texts: DataFrame, ids: list[str], known: DataFrame, view: str, pick: Pick, groups: int, schema: str, id_schema: str) -> DataFrame:
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-n // groups))
    names = [*ids, "text", "head"]

    def with_heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from frames_of(((*r, h) for r in frame.itertuples(index=False, name=None) if r[-1] for h in _heads(VIEWS[view](r[-1])[0])), names)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = [key_of(t, view) for t in frame["term"]]
            yield frame.assign(head=[k[:2] for k in keys])[[bool(k) for k in keys]]

    group = F.pmod(F.xxhash64("head"), F.lit(groups)).cast("int").alias("group")
    own = known.mapInPandas(keyed, "term string, target string, rank int, head string").withColumn("group", group)
    heads = own.select("head", "group").distinct()
    sent = texts.mapInPandas(with_heads, f"{id_schema}, text string, head string").join(heads, "head").drop("head").distinct()
    salted = sent.withColumn("salt", F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int")).withColumn("kind", F.lit(1))
    told = own.drop("head").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("kind", F.lit(0))
    met = told.unionByName(salted, allowMissingColumns=True).select("group", "salt", "kind", "term", "target", "rank", *ids, "text")
    met = met.repartition(n, "group", "salt").sortWithinPartitions("group", "salt", "kind")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple]:
            at, terms, own_terms = None, [], None
            for frame in frames:
                for r in frame.itertuples(index=False, name=None):
                    if r[:2] != at:
                        at, terms, own_terms = r[:2], [], None
                    if r[2] == 0:
                        terms.append((r[3], r[4], int(r[5])))
                        continue
                    own_terms = own_terms or Terms(terms, view)
                    yield from ((*r[6:-1], f.start, f.end, f.term, f.target, f.rank) for f in own_terms.found(r[-1]))

        yield from frames_of(each(), [*ids, "start", "end", "term", "target", "rank"])

    every = met.mapInPandas(search, f"{id_schema}, start int, end int, term string, target string, rank int")

    def resolve(own: pd.DataFrame) -> pd.DataFrame:
        key = tuple(own[ids].iloc[0])
        kept = pick([Found(int(s), int(e), t, g, int(k)) for s, e, t, g, k in own[["start", "end", "term", "target", "rank"]].itertuples(index=False)])
        return pd.DataFrame([(*key, f.start, f.end, f.term, f.target) for f in kept], columns=[*ids, "start", "end", "term", "target"])

    return every.groupBy(*ids).applyInPandas(resolve, schema)


def replaced(rows: DataFrame, ids: list[str], spans: DataFrame) -> DataFrame:
    """rows with each text's spans (ids, start, end, target), which don't overlap, put as their targets say; in built-in functions."""
    own = spans.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("start", "end", "target"))).alias("__spans"))  # a text's own
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit("").alias("made"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["made"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["target"]).alias("made"), s["end"].alias("at"))
    done = F.aggregate("__spans", start, step)
    whole = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(done["made"], F.substring(text, done["at"] + 1, F.length(text))))
    return rows.join(own, ids, "left").withColumn("text", whole).drop("__spans")
