"""Near-duplicates by b-bit MinHash over word shingles.

1. One pass over the texts: set of shingles (64-bit hashes of its words), its digest, and forty bands of six minima,
   which give bucket keys. For classes that share a bucket, a second pass keeps the set and, of 2048 minima, the low
   bit each, packed into 32 longs.
2. Equal sets become one class (partial aggregation, so any number of copies is cheap).
3. Classes that share a bucket are candidates. First each meets its bucket's hub, the class that shares buckets with the
   most others; what those links connect is a part. Then, in buckets that still hold several parts, classes of different
   parts meet. Links inside a part add nothing and are never listed, so a bucket of n alike texts costs n pairs, not n * n.
4. Bit counts of the packed signatures estimate each candidate's similarity, corrected for chance agreement of
   bits (1/2); what lies more than six deviations under the threshold goes, and so do sets too unlike in size.
5. The rest is confirmed exactly on full sets, and links become connected components.

A pair at the threshold shares no bucket with probability (1 - 0.85 ** 6) ** 40, about 6e-9 (at 0.8: 5e-6). A pair that
shares several buckets is listed in the first of them.

Defined results: a null or blank text has an empty set and is linked with nothing. Texts with fewer words than a shingle
have one element, the whole sequence. Null ids take part but name no component: component_id is the smallest id that
isn't null, null where there is none. Rows that repeat an id and text share their result in decide(), where kept marks
every row that has its component's id, so several texts where an id repeats or all are null; survivors() keeps one row of
each component, of the smallest id and then row key, nulls last. An empty table gives an empty result.
Other columns are not read; survivors() returns exactly the input's columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, free, mix64, row_key, slices, text_bytes, text_or_empty

MINIMA, ROWS, BANDS, LOW_BITS = 2048, 6, 40, 1
LONGS = MINIMA * LOW_BITS // 64
_A = ((mix64(np.arange(MINIMA, dtype=np.uint64) + np.uint64(0xABCDEF)) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x5151))
_PLACE = mix64(np.arange(64, dtype=np.uint64) + np.uint64(0x777)) | np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another, and n + 1 offsets of the texts' words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[(offsets < len(data))]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.arange(len(data))
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(at[inside].max()) + 1, 0x9E3779B97F4A7C15, np.uint64))])
    value = np.where(inside, _BYTE[_LOWER[data]] * power[np.where(inside, at, 0)], np.uint64(0))
    return mix64(np.add.reduceat(value, starts)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, ends = word_hashes(data, offsets)
    n = max(len(h) - words + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += h[k : k + n] * _PLACE[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            salt = np.array([b - a], np.uint64) * np.uint64(0xA0761D6478BD642F)
            out.append(mix64((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + salt))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray, count: int = MINIMA) -> np.ndarray:
    """Minima of the first `count` permutations (odd multipliers modulo 2 ** 32 over scrambled hashes), each scrambled again so that its low bits are even."""
    low, x = np.full(count, 0xFFFFFFFF, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    space = np.empty((32, count), np.uint32)
    for lo in range(0, len(x), 32):
        some = np.multiply(x[lo : lo + 32], _A[:count], out=space[: len(x) - lo])
        low = np.minimum(low, some.min(axis=0))
    return mix64(low.astype(np.uint64))


def packed(low: np.ndarray) -> list[int]:
    """The low bit of each minimum, 64 to a long."""
    bits = (low & np.uint64(1)).reshape(LONGS, 64) << np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64).tolist()


def buckets(low: np.ndarray) -> list[int]:
    rows = low.reshape(BANDS, ROWS)
    return mix64((rows * _PLACE[None, :ROWS]).sum(axis=1, dtype=np.uint64) + _PLACE[16 : 16 + BANDS] * np.uint64(3)).view(np.int64).tolist()


def _sketch(words: int):
    """(id, key, text) to id, key, the set's size and digest, and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                sets = shingle_sets(*text_bytes(part.column(2)), words)
                columns = [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([buckets(minima(s, BANDS * ROWS)) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "key", "n", "set", "buckets"])

    return run


def _sets(words: int):
    """(c, buckets, text) to c, buckets, the set itself and its packed signature; of rows that repeat c one after another, the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(np.diff(c, prepend=last) != 0))
            last = c[-1] if len(c) else last
            for part in slices(batch, "text", 1 << 18):
                sets = shingle_sets(*text_bytes(part.column(2)), words)
                ends = np.cumsum([0, *(len(s) for s in sets)])
                held = pa.LargeListArray.from_arrays(ends, np.concatenate(sets).view(np.int64)).cast(pa.list_(pa.int64()))
                columns = [held, pa.array([packed(minima(s)) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["c", "buckets", "shingles", "sig"])

    return run


def similarity(a: str, b: str) -> Column:
    """Collision-corrected estimate from two columns that hold packed signatures."""
    apart = None
    for k in range(LONGS):
        n = F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}")))
        apart = n if apart is None else apart + n
    chance = 0.5**LOW_BITS
    return ((MINIMA - apart) / MINIMA - chance) / (1 - chance)


def first_shared(a: str, b: str) -> Column:
    """Upper half of the first bucket key that two columns of marks share: in that bucket alone their pair is listed."""
    found = []
    for k in range(BANDS // 2):
        x, y = F.col(f"{a}.m{k}"), F.col(f"{b}.m{k}")
        odd = x.bitwiseXOR(y)
        found += [F.when(F.shiftright(odd, 32) == 0, F.shiftright(x, 32)), F.when(F.shiftleft(odd, 32) == 0, F.shiftright(F.shiftleft(x, 32), 32))]
    return F.coalesce(*found)


def slack(percent: int) -> float:
    """Six standard deviations of the estimate at the threshold."""
    j, chance = percent / 100, 0.5**LOW_BITS
    p = j + (1 - j) * chance
    return 6 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def may_be_alike(a: str, b: str, percent: int) -> Column:
    """Whether two columns of signatures allow the threshold: by their sets' sizes (a proof) and by the estimate."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (similarity(a, b) >= percent / 100 - slack(percent))


def linked(classes: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Components of the classes: c and component, a class of c's component; classes that stay as they are may be absent.

    classes: c (long), key, buckets; texts: key, text.
    """
    spread = classes.select("c", F.explode("buckets").alias("bucket"))
    # half of each bucket key, two to a long: enough to tell which bucket is the first that two classes share
    marks = F.struct(*[F.shiftleft(F.shiftright(F.col("buckets")[2 * k], 32), 32).bitwiseOR(F.shiftrightunsigned(F.col("buckets")[2 * k + 1], 32)).alias(f"m{k}") for k in range(BANDS // 2)]).alias("marks")
    meeting = cut(spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    # a class has BANDS buckets, so its list is short
    shared = spread.join(meeting.hint("merge"), "bucket").groupBy("c").agg(F.sum("size").alias("company"), F.collect_list("bucket").alias("own"))
    shared = cut(shared.join(classes.select("c", "key", "buckets").hint("merge"), "c"))
    # the class that meets the most others, as an original does among its variants, is its buckets' hub
    members = shared.select("c", "company", F.explode("own").alias("bucket"))
    hubs = cut(members.groupBy("bucket").agg(F.max(F.struct("company", "c")).alias("hub")).select("bucket", F.col("hub.c").alias("hub")))
    stars = members.join(hubs.hint("merge"), "bucket").where("c <> hub").select(F.greatest("c", "hub").alias("u"), F.least("c", "hub").alias("v")).distinct()
    found = texts.join(shared.select("c", "key", "buckets").hint("merge"), "key").select("c", "buckets", "text")
    sets = cut(found.mapInArrow(_sets(words), "c long, buckets array<long>, shingles array<long>, sig array<long>"))
    signed = sets.select("c", F.struct(*[F.col("sig")[k].alias(f"s{k}") for k in range(LONGS)], F.size("shingles").alias("size")).alias("sig"), marks)

    def confirm(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("c").alias("u"), F.col("shingles").alias("x")).hint("merge"), "u").join(sets.select(F.col("c").alias("v"), F.col("shingles").alias("y")).hint("merge"), "v")
        both = F.size(F.array_intersect("x", "y"))
        return full.where((100 + percent) * both >= percent * (F.size("x") + F.size("y"))).drop("x", "y")

    rated = stars.join(signed.select(F.col("c").alias("u"), F.col("sig").alias("a")).hint("merge"), "u").join(signed.select(F.col("c").alias("v"), F.col("sig").alias("b")).hint("merge"), "v")
    parts = cut(components(confirm(rated.where(may_be_alike("a", "b", percent)).select("u", "v"))))
    placed = shared.select("c", "own").join(parts.select(F.col("u").alias("c"), F.col("component").alias("part")).hint("merge"), "c", "left").select("c", F.coalesce("part", "c").alias("part"), F.explode("own").alias("bucket"))
    mixed = cut(placed.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket"))
    if mixed.isEmpty():
        return parts.select(F.col("u").alias("c"), "component")
    left = cut(placed.join(mixed.hint("merge"), "bucket").join(signed.hint("merge"), "c"))
    # the larger set of a pair meets the smaller one: in its own band of sizes, or in the one below if its least partner lies there
    size = F.col("sig.size")
    of = (lambda least: F.floor((F.log(size.cast("double")) + least * (1 + 1e-9)) / (-2 * math.log(percent / 100))).cast("long")) if percent < 100 else (lambda least: size.cast("long"))
    a = left.select("bucket", of(0.0).alias("band"), *[F.col(c).alias(c + "a") for c in ("c", "part", "sig", "marks")])
    b = left.select(F.col("bucket").alias("other"), F.explode(F.array_distinct(F.array(of(0.0), of(math.log(percent / 100))))).alias("near"), *[F.col(c).alias(c + "b") for c in ("c", "part", "sig", "marks")])
    larger = (F.col("siga.size") < F.col("sigb.size")) | ((F.col("siga.size") == F.col("sigb.size")) & (F.col("parta") < F.col("partb")))
    alike = (F.col("bucket") == F.col("other")) & (F.col("band") == F.col("near")) & (F.col("parta") != F.col("partb")) & larger & may_be_alike("siga", "sigb", percent) & (F.shiftright("bucket", 32) == first_shared("marksa", "marksb"))
    across = cut(a.hint("merge").join(b, alike).select(F.col("ca").alias("u"), F.col("cb").alias("v"), "parta", "partb").distinct())
    if across.isEmpty():
        return parts.select(F.col("u").alias("c"), "component")
    joined = cut(components(confirm(across).select(F.col("parta").alias("u"), F.col("partb").alias("v")))).withColumnRenamed("component", "whole").withColumnRenamed("u", "part")
    whole = parts.select(F.col("u").alias("c"), F.col("component").alias("part")).join(joined.hint("merge"), "part", "left").select("c", F.coalesce("whole", "part").alias("component"))
    # a part's own smallest class isn't among parts
    return whole.unionByName(joined.select(F.col("part").alias("c"), F.col("whole").alias("component")))


def _parts(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, n, set, buckets), and of each set that isn't empty its smallest id and its component's class (set, id, part)."""
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    sketch = cut(keyed.mapInArrow(_sketch(words), "id long, key binary, n long, set binary, buckets array<long>"))
    by_set = sketch.where("set is not null").groupBy("set").agg(F.min("id").alias("id"), F.min(F.struct("key", "buckets")).alias("own"))
    classes = cut(by_set.select(F.monotonically_increasing_id().alias("c"), "set", "id", "own.key", "own.buckets"))
    found = linked(classes, keyed.select("key", "text"), percent, words)
    return sketch, classes.select("set", "c", "id").join(found.hint("merge"), "c", "left").select("set", "id", F.coalesce("component", "c").alias("part"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row: id, n_shingles, component_id, kept, and row_key, the binary key of id and text."""
    sketch, part = _parts(docs, id_col, text_col, words, percent)
    part = cut(part)
    least = cut(part.groupBy("part").agg(F.min("id").alias("component_id")))
    named = part.select("set", "part").join(least.hint("merge"), "part").select("set", "component_id")
    rows = sketch.select("id", "key", "n", "set").join(named.hint("merge"), "set", "left")
    component = F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.col("key").alias("row_key"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows of which one stays for each component, with all columns of the input."""
    sketch, part = _parts(docs, id_col, text_col, words, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    firsts = sketch.where("set is not null").groupBy("set").agg(first)
    own = free("__row_key", docs.columns)
    one = part.select("set", "part").join(firsts.hint("merge"), "set").groupBy("part").agg(F.min("first").alias("first")).select(F.col("first.key").alias(own))
    kept = one.unionByName(sketch.where("set is null").select(F.col("key").alias(own)).distinct())
    return docs.withColumn(own, row_key(id_col, text_col)).join(kept, own, "left_semi").dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in docs.columns])
