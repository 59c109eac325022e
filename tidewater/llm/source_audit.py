"""How sources of a language diverge in their words: a byte-level tokenizer, exact counts, chi-square-like divergences.

Tasks lay the texts of a batch end to end as UTF-8 bytes. A table of 256 bytes lower-cases A-Z and marks what belongs to
no term, so that its boundaries are those of the marks; xxhash groups the slices, and slices of one hash are compared
byte by byte (those that differ from their group's first are grouped by their bytes). Each task sends one row for a
language, source and term, with occurrences and documents; Spark sums them by term.

A term is kept in a language if at least `least` of its documents hold it. With N occurrences of kept terms in a group
(a language's source, or the language), V kept terms in the language and a count c, a term's rate is
p = 1 + floor(SCALE * (c + 1) / (N + V)), and the divergence of rate p from rate q is floor((p - q) * (p - q) / q).

- part `pair`: for each group, each other source of the language, with divergences summed over all kept terms;
- part `term`: for each group, the kept terms that occur in it with a rate above the language's, up to rank `top`.

Pairs are summed in blocks of terms: tasks get the kept counts of whole terms and every group's N, build a matrix of
sources by terms in CSR form, and np.add.reduceat sums each other source's entries. Terms that a source lacks have one
rate, so only entries are walked, and a histogram of the group's rates settles the rest.

All arithmetic is on 64-bit integers and exact while counts stay below 9e13 and a language keeps fewer than 1e9 terms.

Defined results: null texts, languages and sources are ''. Groups whose texts hold no term take part, with N = 0. A
language without kept terms has pairs of value 0. Repeated rows count as often as they come. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, table, text_bytes, text_or_empty

SCALE = 1_000_000_000
#: Distinct terms, and counts, that a task holds before it sends them.
HELD_TERMS, HELD_COUNTS = 400_000, 2_000_000
#: Entries of a block of the matrix; a term is never divided.
BLOCK = 1 << 19


def _byte_table() -> np.ndarray:
    """For each byte its lower-cased form, 0 where it ends a term."""
    of = np.zeros(256, np.uint8)
    of[0x80:] = np.arange(0x80, 0x100)
    of[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    of[ord("A") : ord("Z") + 1] = of[ord("a") : ord("z") + 1]
    return of


BYTES = _byte_table()


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The terms of texts laid end to end, and the text each stands in."""
    if not len(data):
        return [], np.zeros(0, np.int64)
    low = BYTES[data]
    inside = low != 0
    first = np.zeros(len(data) + 1, np.bool_)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    flat = low.tobytes()
    return [flat[s:e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)], np.searchsorted(offsets, starts, "right") - 1


def grouped(words: list[bytes], hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray]:
    """Distinct words and each word's place among them: by hash, and exactly so."""
    if not words:
        return [], np.zeros(0, np.int64)
    _, at, place = np.unique(np.fromiter(map(hashed, words), np.uint64, len(words)), return_index=True, return_inverse=True)
    own = np.empty(len(words), object)
    own[:] = words
    distinct = own[at]
    odd = np.flatnonzero(own != distinct[place])
    found = distinct.tolist()
    if len(odd):  # another word of the same hash
        extra = {w: i for i, w in enumerate(dict.fromkeys(own[odd].tolist()), len(found))}
        found += extra
        place[odd] = [extra[w] for w in own[odd].tolist()]
    return found, place


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, source, text -> lang, source, term, occurrences, documents; a triple may come again."""
    groups: dict[tuple[str, str], int] = {}
    known: dict[bytes, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, docs = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)

    def sent() -> Iterator[pa.RecordBatch]:
        keys, n, docs = summed()
        names, words = list(groups), pa.array(list(known), pa.binary())
        langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        for lo in range(0, len(keys), 100_000):
            group, word = np.divmod(keys[lo : lo + 100_000], 1 << 32)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), words.take(pa.array(word)), pa.array(n[lo : lo + 100_000]), pa.array(docs[lo : lo + 100_000])], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for some in slices(batch, "text"):
            words, doc = terms(*text_bytes(some.column(2)))
            if not words:
                continue
            distinct, place = grouped(words)
            word = np.array([known.setdefault(w, len(known)) for w in distinct], np.int64)
            group = np.array([groups.setdefault(x, len(groups)) for x in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)], np.int64)
            each, n = np.unique((doc << 32) + place, return_counts=True)  # a text's word, and how often it comes there
            keys = (group[each >> 32] << 32) + word[each & 0xFFFFFFFF]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held.append((keys[first], np.add.reduceat(n[order], first), np.diff(np.append(first, len(keys)))))
            size += len(first)
            if size > HELD_COUNTS:
                held = [summed()]
                size = len(held[0][0])
            if len(known) > HELD_TERMS or size > HELD_COUNTS // 2:
                yield from sent()
                groups, known, held, size = {}, {}, [], 0
    if held:
        yield from sent()


def kept_counts(docs: DataFrame, least: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, lang_n and one (1 in one row of each term of a language, else 0), of kept terms."""
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    parts = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    counts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    whole = counts.select("lang", "source", F.col("term").cast("string").alias("term"), "n", F.sum("n").over(same).alias("lang_n"), F.sum("docs").over(same).alias("docs"), (F.min("source").over(same) == F.col("source")).cast("int").alias("one"))
    return whole.where(F.col("docs") >= least).drop("docs")


def group_sizes(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, total (N of the group), lang_total, lang_terms (V): a row for each group that occurs."""
    groups = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("one").alias("ones"))
    joined = groups.join(own, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("ones", F.lit(0)).alias("ones"))
    by_lang = Window.partitionBy("lang")
    return joined.select("lang", "source", "total", F.sum("total").over(by_lang).alias("lang_total"), F.sum("ones").over(by_lang).alias("lang_terms"))


def _rate(count: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), as a long division in two steps of 1e5 and 1e4."""
    whole = total + terms_
    scaled = (count + 1) * 100_000
    return 1 + F.call_function("div", scaled, whole) * 10_000 + F.call_function("div", (scaled % whole) * 10_000, whole)


def term_part(kept: DataFrame, sizes: DataFrame, top: int = 200) -> DataFrame:
    rated = kept.join(sizes, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _rate(F.col("n"), F.col("total"), F.col("lang_terms")).alias("p"), _rate(F.col("lang_n"), F.col("lang_total"), F.col("lang_terms")).alias("q"))
    above = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    return above.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def rates(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """As _rate(), whole being N + V."""
    scaled = (counts + 1) * 100_000
    return 1 + scaled // whole * 10_000 + scaled % whole * 10_000 // whole


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def pair_sums(term: np.ndarray, source: np.ndarray, count: np.ndarray, whole: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source g, the divergences of its rates from those of every source, summed over a block's terms.

    term: numbers from 0 without gaps; one entry for each term and source with a count; whole: N + V of each source."""
    n, width = len(whole), int(term.max()) + 1 if len(term) else 0
    order = np.lexsort((term, source))
    col, count, row = term[order], count[order], source[order]
    starts = np.searchsorted(row, np.arange(n + 1))
    full = np.flatnonzero(np.diff(starts))  # reduceat has no empty segments
    rate, lacking = rates(count, whole[row]), rates(np.zeros(n, np.int64), whole) if width else np.ones(n, np.int64)
    spread = lacking[row]
    for g in range(n):
        own = np.full(width, lacking[g])
        own[col[starts[g] : starts[g + 1]]] = rate[starts[g] : starts[g + 1]]
        levels, times = np.unique(own, return_counts=True)
        sums = np.array([int((divergences(levels, q) * times).sum()) for q in lacking], np.int64)
        if len(full):
            at = own[col]
            sums[full] += np.add.reduceat(divergences(at, rate) - divergences(at, spread), starts[full])
        yield g, sums


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, kind, term, source, n, whole) in the order of lang, kind and term; kind 0 tells a group's N + V."""
    lang: str | None = None
    names: list[str] = []
    wholes: list[int] = []
    place: dict[str, int] = {}
    rows: list[tuple[list[str], list[str], np.ndarray]] = []
    size = 0

    def block(last: bool) -> Iterator[pa.RecordBatch]:
        """Sums over the whole terms among the rows held; the last term stays unless it is complete."""
        nonlocal rows, size
        words = [w for r in rows for w in r[0]]
        code, seen = np.zeros(len(words), np.int64), -1
        before = None
        for i, w in enumerate(words):
            if w != before:
                seen, before = seen + 1, w
            code[i] = seen
        sources = np.array([place[s] for r in rows for s in r[1]], np.int64)
        counts = np.concatenate([np.zeros(0, np.int64), *(r[2] for r in rows)])
        upto = len(words) if last else int(np.searchsorted(code, seen))
        if not upto and not last:
            return
        for g, sums in pair_sums(code[:upto], sources[:upto], counts[:upto], np.array(wholes, np.int64)):
            other = np.delete(np.arange(len(names)), g)
            for lo in range(0, len(other), 50_000):
                some = other[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([names[g]] * len(some), pa.string()), pa.array([names[h] for h in some], pa.string()), pa.array(sums[some])], ["lang", "source", "item", "value"])
        left = [(words[upto:], [names[s] for s in sources[upto:]], counts[upto:])] if upto < len(words) else []
        rows, size = left, len(words) - upto

    for batch in batches:
        langs = batch.column(0).to_pylist()
        edges = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)] if langs else []
        for lo, hi in zip(edges, edges[1:]):
            if langs[lo] != lang:
                if lang is not None:
                    yield from block(True)
                lang, names, wholes, place, rows, size = langs[lo], [], [], {}, [], 0
            own = batch.slice(lo, hi - lo)
            heads = int(np.searchsorted(np.asarray(own.column(1)), 1))
            for name, whole in zip(own.column(3).slice(0, heads).to_pylist(), own.column(5).slice(0, heads).to_pylist(), strict=True):
                place[name] = len(names)
                names.append(name)
                wholes.append(whole)
            if heads < len(own):
                rest = own.slice(heads)
                rows.append((rest.column(2).to_pylist(), rest.column(3).to_pylist(), np.asarray(rest.column(4), np.int64)))
                size += len(rest)
            if size > BLOCK:
                yield from block(False)
    if lang is not None:
        yield from block(True)


def pair_part(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    n = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = kept.select("lang", F.lit(1).alias("kind"), "term", "source", "n", F.lit(None).cast("long").alias("whole"), F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("block"))
    heads = sizes.select("lang", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("term"), "source", F.lit(0).cast("long").alias("n"), (F.col("total") + F.col("lang_terms")).alias("whole"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    dealt = entries.unionByName(heads).repartitionById(n, F.col("block")).sortWithinPartitions("lang", "kind", "term").drop("block")
    sums = dealt.mapInArrow(_pairs, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))


def audit(docs: DataFrame, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = table(kept_counts(docs, least, text_col, lang_col, source_col), "audit-counts")
    sizes = table(group_sizes(docs, kept, lang_col, source_col), "audit-sizes")
    return pair_part(kept, sizes).unionByName(term_part(kept, sizes, top))
