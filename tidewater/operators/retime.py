"""Cues of one transcript at the times of another: alignment of their words, times from it, repair where it fails.

Words that both tracks say once are anchors; the longest chain of them that ascends in both tracks holds. Between two
neighbouring anchors lies a gap with words of either side, and every gap is a group of its own: there the same is done
with words that the gap's sides have once, and where none is left, the longest common runs match (as in Ratcliff and
Obershelp's measure). A track's anchors are words it says once, so their number is bounded by its vocabulary; the gaps,
the bulk of the words, are spread over tasks.

A cue takes the times of its largest cluster of matched words if enough of them match and they lie near enough; long
cues behind a retimed one follow it; over-long ones are cut; overlaps are pushed on. Those three passes are one walk
that carries its state from chunk to chunk (carry.py).

Cues are (track, pos, start_ms, end_ms, text), positions are unique in a track. A null text has no words; null times
count as 0; rows without a track are left out. Tracks without words on either side keep their times, apart from the repair.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import Rows, carried, settled
from .intervals import timed_tokens

#: Positions of one bucket and of one chunk of a track.
BUCKET, CHUNK = 256, 4096
LONG_MS, LEAST_MS, MOST_MS = 10_000, 800, 8_000


def ascending(values: list) -> list[int]:
    """Places of a longest strictly ascending subsequence."""
    tails, ends, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [v], [i]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def aligned_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, ascending in both: a chain of words both have once, and the same between them; common runs where there is none."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        at_b = {w: y for y, w in enumerate(b[k:m], k) if once_b[w] == 1 and once_a[w] == 1}
        pairs = [(x, at_b[w]) for x, w in enumerate(a[i:j], i) if w in at_b]
        if pairs:
            chain = [pairs[p] for p in ascending([y for _, y in pairs])]
            found += chain
            edges = [(i - 1, k - 1), *chain, (j, m)]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:]) if x + 1 < x2 and y + 1 < y2]
        else:
            blocks = SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_matching_blocks()
            found += [(i + s.a + n, k + s.b + n) for s in blocks for n in range(s.size)]
    return sorted(found)


def _last_before(rows: DataFrame, value: Column, name: str, order: list[str], backwards: bool = False) -> DataFrame:
    """rows with `name`: the last value that isn't null at or before each row in its track's order (at or after it, backwards); by buckets, so that no task sorts a track."""
    held = rows.withColumn("__value", value)
    inside = Window.partitionBy("track", "bucket").orderBy(*[F.col(c).desc() if backwards else F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.min_by if backwards else F.max_by
    ends = held.groupBy("track", "bucket").agg(pick("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__end"))
    over = Window.partitionBy("track").orderBy(F.col("bucket").desc() if backwards else F.col("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    came = ends.select("track", "bucket", F.last("__end", ignorenulls=True).over(over).alias("__in"))
    return held.withColumn("__own", F.last("__value", ignorenulls=True).over(inside)).join(came, ["track", "bucket"]).withColumn(name, F.coalesce("__own", "__in")).drop("__value", "__own", "__in")


def matched_words(source: DataFrame, reference: DataFrame) -> DataFrame:
    """(track, pos, n, word) and the same with start_ms and end_ms -> track, pos, n, start_ms, end_ms: the source's matched words with the reference's times."""
    once = lambda df: df.groupBy("track", "word").agg(F.count("*").alias("c"), F.min(F.struct("pos", "n")).alias("at")).where("c = 1").drop("c")
    pairs = once(source).join(once(reference).withColumnRenamed("at", "to"), ["track", "word"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "n"], ignore_index=True)
        held = rows.iloc[ascending(list(zip(rows["r_pos"], rows["r_n"])))]
        return held[["track", "pos", "n", "r_pos", "r_n"]].assign(k=range(1, len(held) + 1))

    key = source.schema["track"].dataType.simpleString()
    anchors = settled(pairs.select("track", "at.pos", "at.n", F.col("to.pos").alias("r_pos"), F.col("to.n").alias("r_n")).groupBy("track").applyInPandas(chain, f"track {key}, pos long, n int, r_pos long, r_n int, k int"))

    def gaps(words: DataFrame, marks: DataFrame) -> DataFrame:
        rows = words.join(marks, ["track", "pos", "n"], "left").withColumn("bucket", F.floor(F.col("pos") / BUCKET))
        return _last_before(rows, F.col("k"), "gap", ["pos", "n"]).withColumn("gap", F.coalesce("gap", F.lit(0)))

    left = gaps(source, anchors.select("track", "pos", "n", "k"))
    right = gaps(reference, anchors.select("track", F.col("r_pos").alias("pos"), F.col("r_n").alias("n"), "k"))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for frame in frames for r in frame.itertuples(index=False, name=None))
        made: list[tuple] = []
        for (track, _), words in groupby(rows, key=lambda r: r[:2]):
            sides: tuple[list, list] = ([], [])
            for r in words:
                sides[r[2]].append(r)
            if all(sides):
                met = aligned_words(*([r[5] for r in side] for side in sides))
                made += [(track, *sides[0][x][3:5], *sides[1][y][6:]) for x, y in met]
            if len(made) >= 5000:
                yield pd.DataFrame(made, columns=names)
                made = []
        yield pd.DataFrame(made, columns=names)

    names = ["track", "pos", "n", "start_ms", "end_ms"]
    no_time = F.lit(None).cast("long")
    open_words = left.where("k is null").select("track", "gap", F.lit(0).alias("side"), "pos", "n", "word", no_time.alias("start_ms"), no_time.alias("end_ms")).unionByName(
        right.where("k is null").select("track", "gap", F.lit(1).alias("side"), "pos", "n", "word", "start_ms", "end_ms"))
    dealt = open_words.where("track IS NOT NULL").repartition("track", "gap").sortWithinPartitions("track", "gap", "side", "pos", "n")
    filled = dealt.mapInPandas(fill, f"track {key}, pos long, n int, start_ms long, end_ms long")
    direct = anchors.select("track", "pos", "n", F.col("r_pos"), F.col("r_n")).join(reference.select("track", F.col("pos").alias("r_pos"), F.col("n").alias("r_n"), "start_ms", "end_ms"), ["track", "r_pos", "r_n"])
    return direct.select("track", "pos", "n", "start_ms", "end_ms").unionByName(filled)


def spoken_spans(matched: DataFrame, gap_ms: int = 2500) -> DataFrame:
    """track, pos, words, start_ms, end_ms of each cue's largest cluster of matched words: of several the shortest in time, then the first."""
    order = Window.partitionBy("track", "pos").orderBy("n")
    opens = F.when(F.col("start_ms") - F.lag("end_ms").over(order) > gap_ms, 1).otherwise(0)
    runs = matched.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order)).groupBy("track", "pos", "run").agg(F.count("*").alias("words"), F.min_by("start_ms", "n").alias("start_ms"), F.max_by("end_ms", "n").alias("end_ms"))
    best = F.max_by(F.struct("words", "start_ms", "end_ms"), F.struct("words", F.col("start_ms") - F.col("end_ms"), -F.col("run")))
    return runs.groupBy("track", "pos").agg(best.alias("b")).select("track", "pos", "b.*")


def _estimate(words: int, a_second: float) -> int:
    return min(MOST_MS, max(LEAST_MS, round(words / a_second * 1000)))


def repair(rows: Rows, state: str) -> tuple[list[tuple], str]:
    """A walk over cues with their aligned times: (pos, start_ms, end_ms, words, to_start, to_end, used, next_start, last) -> pos, start_ms, end_ms.

    A cue is given out once the next one's start is known; the state holds the waiting one."""
    # of the cue that waits: pos, own end, used, start and end so far, words; and the end of the cue before it
    wait, floor = json.loads(state)
    out: list[tuple[int, int, int]] = []

    def give(next_start: int | None) -> None:
        nonlocal floor
        pos, _, _, start, end, words = wait
        if end - start >= LONG_MS:
            end = start + _estimate(words, 2.5)
            if next_start is not None and next_start > start:
                end = min(end, next_start)
        if floor is not None and start < floor:
            if end <= floor:
                end = floor + _estimate(words, 2.5)
            start = floor
        out.append((pos, start, end))
        floor = end

    for r in rows.itertuples(index=False):
        start, end, used = (int(r.to_start), int(r.to_end), True) if r.used else (int(r.start_ms), int(r.end_ms), False)
        if not used and wait and wait[2] and r.end_ms - r.start_ms >= LONG_MS and r.start_ms - wait[1] <= 3_000:
            begin = wait[4]
            close = begin + _estimate(r.words, 3)
            if not pd.isna(r.next_start) and r.next_start > begin:
                close = min(close, int(r.next_start))
            if close > begin:
                start, end, used = begin, close, True
        if wait:
            give(start)
        wait = [int(r.pos), int(r.end_ms), used, start, end, int(r.words)]
        if r.last:
            give(None)
            wait = None
    return out, json.dumps([wait, floor])


def retimed(source: DataFrame, reference: DataFrame, least_share: float = 0.35, most_shift_ms: int = 8_000, chunk: int = CHUNK) -> DataFrame:
    """source's cues (track, pos, text) with start_ms and end_ms of the reference's speech, and used: whether a cue's own words gave its times."""
    timed = lambda df: df.select("track", F.col("pos").cast("long").alias("pos"), "text", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("start_ms", "end_ms")])
    # both sides are read a dozen times below: kept once, not derived anew each time
    cues, heard = settled(timed(source)), settled(timed(reference))
    words = timed_tokens(cues).select("track", "pos", "n", "word")
    counts = words.groupBy("track", "pos").agg(F.count("*").cast("int").alias("words"))
    spans = spoken_spans(matched_words(words, timed_tokens(heard)))
    n = F.coalesce("words", F.lit(0))
    needed = F.greatest(F.when(n < 4, 1).otherwise(2), F.ceil(n * F.lit(least_share)))
    fits = (F.col("found") >= needed) & (F.col("to_end") > F.col("to_start")) & (F.abs(F.col("to_start") - F.col("start_ms")) <= most_shift_ms)
    named = spans.select("track", "pos", F.col("words").alias("found"), F.col("start_ms").alias("to_start"), F.col("end_ms").alias("to_end"))
    ends = cues.groupBy("track").agg(F.max("pos").alias("last_pos"))
    joined = cues.join(counts, ["track", "pos"], "left").join(named, ["track", "pos"], "left").join(ends, "track").select(
        "track", "pos", "start_ms", "end_ms", n.alias("words"), F.coalesce("to_start", F.lit(0)).alias("to_start"), F.coalesce("to_end", F.lit(0)).alias("to_end"), F.coalesce(fits, F.lit(False)).alias("used"), (F.col("pos") == F.col("last_pos")).alias("last"), F.floor(F.col("pos") / BUCKET).alias("bucket"), F.floor(F.col("pos") / chunk).alias("chunk"))
    ready = settled(_last_before(joined, F.when(F.col("used"), F.col("to_start")), "next_start", ["pos"], backwards=True).drop("bucket"))
    walked = carried(ready, repair, "pos long, start_ms long, end_ms long", json.dumps([None, None]), ["pos"])
    return walked.join(ready.select("track", "pos", "used"), ["track", "pos"]).join(cues.select("track", "pos", "text"), ["track", "pos"]).select("track", "pos", "start_ms", "end_ms", "text", "used")


# --- recognised words to cues, and cues of overlapping recordings to one track

ENDINGS = (".", "!", "?", "。", "！", "？", "…")  # fixed values: what ends a cue
PAUSE_MS, SPAN_MS = 750, 6_000


def word_walk(joiner: str):
    """A walk over recognised words (pos, start_ms, end_ms, text, last) that makes cues of them: split at pauses, at length, after an ending."""
    def walk(rows: Rows, state: str) -> tuple[list[tuple], str]:
        held, before = json.loads(state)  # words (pos, start, end, text) of the open cue; the end of the last word
        out = []

        def flush() -> None:
            nonlocal held
            text = joiner.join(w[3] for w in held).strip()
            if text:
                out.append((held[0][0], held[0][1], held[-1][2], text))
            held = []

        for r in rows.itertuples(index=False):
            text = (r.text or "").strip()
            if held and (r.start_ms - before >= PAUSE_MS or r.end_ms - held[0][1] >= SPAN_MS):
                flush()
            held.append((int(r.pos), int(r.start_ms), int(r.end_ms), text))
            before = int(r.end_ms)
            if text.endswith(ENDINGS) or r.last:
                flush()
        return out, json.dumps([held, before if held else 0])  # without an open cue the end of the last word decides nothing

    return walk


def _ordered(rows: DataFrame, chunk: Column) -> DataFrame:
    """Rows with chunk and last, which marks a track's last row in the order of start_ms and pos."""
    order = F.struct("start_ms", "pos")
    ends = rows.groupBy("track").agg(F.max(order).alias("__end"))
    return settled(rows.join(ends, "track").withColumn("last", order == F.col("__end")).withColumn("chunk", chunk).drop("__end"))


def cues_of_words(words: DataFrame, joiner: str = " ", chunk_ms: int = 600_000) -> DataFrame:
    """(track, pos, start_ms, end_ms, text) of single words, in the order of their times -> cues, each with its first word's pos."""
    rows = words.select("track", F.col("pos").cast("long").alias("pos"), "start_ms", "end_ms", "text")
    return carried(_ordered(rows, F.floor(F.col("start_ms") / chunk_ms)), word_walk(joiner), "pos long, start_ms long, end_ms long, text string", json.dumps([[], 0]), ["start_ms", "pos"])


def likeness(a: str, b: str) -> float:
    """Share of the longer text that the other one holds whole, else that a common opening of 6 to 40 characters takes; letters and digits alone count."""
    a, b = ("".join(c for c in t.lower() if c.isalnum()) for t in (a, b))
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if short in long:
        return len(short) / len(long)
    sizes = range(min(len(short), 40), 5, -1)
    return next((k for k in sizes if short[:k] in long or long[:k] in short), 0) / len(long)


def overlap_walk(rows: Rows, state: str) -> tuple[list[tuple], str]:
    """A walk over cues in the order of their starts: one that begins over half a second before the last one's end and says much the same joins it."""
    last = json.loads(state)
    out = []
    for r in rows.itertuples(index=False):
        text = r.text or ""
        if last and r.start_ms < last[2] - 500 and likeness(last[3], text) >= 0.7:
            last = [last[0], last[1], max(last[2], int(r.end_ms)), text if len(text) > len(last[3]) else last[3]]
        else:
            if last:
                out.append(tuple(last))
            last = [int(r.pos), int(r.start_ms), int(r.end_ms), text]
        if r.last:
            out.append(tuple(last))
            last = None
    return out, json.dumps(last)


def without_overlaps(cues: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Cues of recordings that overlap, as one track: what both recordings hold stands once, the longer wording, until the later end."""
    rows = cues.select("track", F.col("pos").cast("long").alias("pos"), "start_ms", "end_ms", "text")
    return carried(_ordered(rows, F.floor(F.col("start_ms") / chunk_ms)), overlap_walk, "pos long, start_ms long, end_ms long, text string", json.dumps(None), ["start_ms", "pos"])


def recording_windows(lengths: DataFrame, window: int, overlap: int) -> DataFrame:
    """(track, length) -> track, k, start, end: windows that overlap and cover the length; none where it isn't positive. overlap is below window."""
    step = window - overlap
    count = F.when(F.col("length") > window, F.ceil((F.col("length") - window) / F.lit(step))).otherwise(F.lit(0)).cast("int")
    rows = lengths.where("length > 0").select("track", "length", F.explode(F.sequence(F.lit(0), count)).alias("k"))
    return rows.select("track", "k", (F.col("k") * step).cast("long").alias("start"), F.least((F.col("k") * step + window).cast("long"), F.col("length").cast("long")).alias("end"))
