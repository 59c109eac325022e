"""Retiming against a plain matcher over whole tracks; walks that carry their state against one walk, for every cut."""

import json
import random
from difflib import SequenceMatcher
from math import ceil

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import carry, retime
from tidewater.plans import retime_queries as Q

SMALL = "/root/testdata/sf0.001"
CUE = "track string, pos long, start_ms long, end_ms long, text string"


def tokens(text):
    import re

    return re.findall("[a-z0-9]+(?:'[a-z0-9]+)?", (text or "").lower())


def plain(source, reference):
    """One track, step by step as the operator is described: [(pos, start, end, text)] twice -> {pos: (start, end, used)}. Words are matched by one global matcher."""
    spoken, times = [], []
    for _, s, e, text in reference:
        w = tokens(text)
        if w:
            length = max(len(w) * 120, min(max(e - s, len(w)), max(800, len(w) * 800)))
            spoken += w
            times += [(s + round(length * i / len(w)), s + round(length * (i + 1) / len(w))) for i in range(len(w))]
    own = [(i, w) for i, c in enumerate(source) for w in tokens(c[3])]
    size = [len(tokens(c[3])) for c in source]
    hit = {i: [] for i in range(len(source))}
    if own and spoken:
        for a, b, n in SequenceMatcher(None, [w for _, w in own], spoken, autojunk=False).get_matching_blocks():
            for k in range(n):
                hit[own[a + k][0]].append(b + k)
    now = [[s, e, False] for _, s, e, _ in source]
    for i, (_, s, _, _) in enumerate(source):
        runs = []
        for k in hit[i]:
            if runs and times[k][0] - times[runs[-1][-1]][1] <= 2500:
                runs[-1].append(k)
            else:
                runs.append([k])
        best = max(runs, key=lambda r: (len(r), times[r[0]][0] - times[r[-1]][1]), default=[])
        if best and len(best) >= max(1 if size[i] < 4 else 2, ceil(size[i] * 0.35)):
            s2, e2 = times[best[0]][0], times[best[-1]][1]
            if e2 > s2 and abs(s2 - s) <= 8000:
                now[i] = [s2, e2, True]
    if not own or not spoken:
        return {c[0]: (c[1], c[2], False) for c in source}
    own_words = [x[2] for x in now]
    for i in range(1, len(source)):
        if now[i][2] or not now[i - 1][2] or source[i][2] - source[i][1] < 10_000 or source[i][1] - source[i - 1][2] > 3000:
            continue
        s = now[i - 1][1]
        e = s + min(8000, max(800, round(size[i] / 3 * 1000)))
        after = next((now[k][0] for k in range(i + 1, len(source)) if now[k][2]), None)
        if after is not None and after > s:
            e = min(e, after)
        if e > s:
            now[i] = [s, e, True]
    spare = lambda i: min(8000, max(800, round(size[i] / 2.5 * 1000)))
    for i in range(len(now)):
        if now[i][1] - now[i][0] >= 10_000:
            now[i][1] = now[i][0] + spare(i)
            if i + 1 < len(now) and now[i + 1][0] > now[i][0]:
                now[i][1] = min(now[i][1], now[i + 1][0])
    for i in range(1, len(now)):
        if now[i][0] < now[i - 1][1]:
            now[i][0] = now[i - 1][1]
            if now[i][1] <= now[i - 1][1]:
                now[i][1] = now[i - 1][1] + spare(i)
    return {c[0]: (*now[i][:2], own_words[i]) for i, c in enumerate(source)}


def by_track(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


def test_retimed_cues_against_a_global_matcher(spark):
    source, heard = ([tuple(r) for r in x.select("track", "pos", "start_ms", "end_ms", "text").collect()] for x in Q.transcripts(spark, SMALL))
    got = {(r.track, r.pos): (r.start_ms, r.end_ms, r.used) for r in Q.retimed_cues(spark, SMALL).collect()}
    assert len(got) == len(source)
    heard, same, used = by_track(heard), 0, 0
    for track, own in by_track(source).items():
        for pos, want in plain(own, heard.get(track, [])).items():
            same += got[track, pos] == want
            used += want[2]
    assert used > 0.8 * len(source) and same > 0.97 * len(source)


def test_unique_words_align_as_a_global_matcher_does(spark):
    rng = random.Random(5)
    source, heard = [], []
    for track in ("a", "b", None, "d"):
        words = [f"w{i}" for i in range(400)]
        at = 0
        for pos in range(60):
            n = rng.randint(0, 9)
            start = at * 300 + rng.randint(-400, 400)
            source.append((track, pos, max(0, start), max(0, start) + rng.choice((900, 2600, 12_000, 0)), " ".join(words[at : at + n]) if rng.random() > 0.05 else None))
            at += n
        spoken = [w for w in words if rng.random() > 0.3]
        spoken[50:50] = [words[k] for k in range(390, 399)]
        for pos, k in enumerate(range(0, len(spoken), 7)):
            heard.append((track, pos, k * 400 + (9000 if pos % 13 == 5 else 0), k * 400 + 2500, " ".join(spoken[k : k + 7])))
    source, heard = [r for r in source if r[0]], [r for r in heard if r[0] != "d"]
    a, b = spark.createDataFrame(source, CUE), spark.createDataFrame(heard, CUE)
    other = by_track(heard)
    want = {(t, p): v for t, own in by_track(source).items() for p, v in (plain(own, other.get(t, [])) if t in other else plain_repair(own)).items()}
    for chunk in (16, 4096):
        got = {(r.track, r.pos): (r.start_ms, r.end_ms, r.used) for r in retime.retimed(a, b, chunk=chunk).collect()}
        assert got == want
    assert sum(v[2] for v in want.values()) > 60 and retime.retimed(a.limit(0), b).count() == 0


def plain_repair(own):
    """A track without a reference is repaired all the same."""
    return {p: (s, e, u) for p, (s, e, u) in plain(own, [(0, 10**9, 10**9 + 1000, "nothing alike")]).items()}


def test_stated_cases(spark):
    source = [("t", 10, 38_549, 42_549, "that represents her before. I know the sort of feel of it."), ("t", 11, 42_549, 63_525, "This feels like it could be epic. Is it going to be disturbing?"), ("t", 12, 68_550, 79_030, "We are in the key of F minor.")]
    heard = [("t", 1, 34_500, 39_420, source[0][4]), ("t", 2, 59_539, 59_979, "This feels"), ("t", 3, 65_540, 69_980, source[2][4])]
    got = {r.pos: r for r in retime.retimed(spark.createDataFrame(source, CUE), spark.createDataFrame(heard, CUE)).collect()}
    assert got[10].end_ms == got[11].start_ms == 39_420 and got[11].end_ms < 45_000 and got[12].start_ms == 65_540 and got[11].text == source[1][4]


def test_words_align_within_gaps():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(rng.randint(0, 40))]
        b = [w for w in a if rng.random() > 0.2] + ["aa"] * rng.randint(0, 2)
        found = retime.aligned_words(a, b)
        assert all(a[x] == b[y] for x, y in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        assert len(found) >= 0.8 * sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert retime.ascending([3, 1, 2, 2, 5, 4]) in ([1, 2, 5], [1, 3, 5], [1, 2, 4], [1, 3, 4])


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_carried_walks_equal_one_walk(spark, cut):
    rng = random.Random(cut)
    rows = [(t, p, rng.randint(0, 9)) for t in ("a", "b", None) for p in range(rng.randint(1, 7))]

    def walk(own: pd.DataFrame, state: str):
        total, out = json.loads(state), []
        for r in own.itertuples(index=False):
            total = 0 if r.v == 7 else (total * 3 + r.v) % 1009
            out.append((r.pos, total))
        return pd.DataFrame(out, columns=["pos", "total"]), json.dumps(total)

    df = spark.createDataFrame(rows, "track string, pos long, v int").withColumn("chunk", F.floor(F.col("pos") / cut))
    for backwards in (False, True):
        got = sorted((str(r.track), r.pos, r.total) for r in carry.carried(df, walk, "pos long, total long", "5", ["pos"], backwards=backwards).collect())
        want = []
        for t in ("a", "b", None):
            own = sorted((r[1:] for r in rows if r[0] == t), reverse=backwards)
            made, _ = walk(pd.DataFrame(own, columns=["pos", "v"]), "5")
            want += [(str(t), p, n) for p, n in made.itertuples(index=False)]
        assert got == sorted(want)


def plain_words(words):
    cues, held = [], []
    for w in words:
        if held and (w[1] - held[-1][2] >= 750 or w[2] - held[0][1] >= 6000):
            cues.append(held)
            held = []
        held.append(w)
        if w[3].strip().endswith((".", "!", "?", "。", "！", "？", "…")):
            cues.append(held)
            held = []
    return [(c[0][0], c[0][1], c[-1][2], " ".join(w[3].strip() for w in c).strip()) for c in [*cues, held] if " ".join(w[3].strip() for w in c).strip()]


@pytest.mark.parametrize("chunk_ms", [9000, 10**9])
def test_word_cues_for_every_cut(spark, chunk_ms):
    rows = [tuple(r) for r in Q.recognised(spark, SMALL).where("track < 4").collect()] + [("x", 1, 0, 10, None), ("x", 2, 20, 30, " "), ("x", 3, 9000, 9100, "late")]
    rows = [(str(r[0]), *r[1:]) for r in rows]
    got = by_track(retime.cues_of_words(spark.createDataFrame(rows, CUE), chunk_ms=chunk_ms).collect())
    want = {t: plain_words([(p, s, e, x or "") for p, s, e, x in sorted(own, key=lambda w: (w[1], w[0]))]) for t, own in by_track(rows).items()}
    assert got == {t: sorted(c) for t, c in want.items() if c}


def test_joined_recordings_against_a_list(spark):
    def like(a, b):
        a, b = ("".join(c for c in t.lower() if c.isalnum()) for t in (a, b))
        if not a or not b:
            return 0
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if short in long:
            return len(short) / len(long)
        return max((k for k in range(6, min(len(short), 40) + 1) if short[:k] in long or long[:k] in short), default=0) / max(len(a), len(b))

    got = by_track(Q.joined_recordings(spark, SMALL).collect())
    rows, joins = by_track([tuple(r) for r in Q.recordings(spark, SMALL).collect()]), 0
    for track, own in rows.items():
        out = []
        for p, s, e, text in sorted(own, key=lambda r: (r[1], r[0])):
            if out and s < out[-1][2] - 500 and like(out[-1][3], text) >= 0.7:
                out[-1] = [*out[-1][:2], max(out[-1][2], e), text if len(text) > len(out[-1][3]) else out[-1][3]]
                joins += 1
            else:
                out.append([p, s, e, text])
        assert got[track] == sorted(map(tuple, out))
    assert joins > 20
    assert sorted(retime.without_overlaps(Q.recordings(spark, SMALL), chunk_ms=9000).collect()) == sorted(Q.joined_recordings(spark, SMALL).collect())


def test_chunks_are_walked_one_after_another():
    """A task goes over many chunks in plain rows, over the edges of batches; a closed cue leaves the state in which tracks begin."""
    table = pa.table({"track": pa.array([None, None, 1, 1, 1, 2], pa.int64()), "chunk": [0, 0, 0, 0, 1, 0], "v": [1, 2, 3, None, 5, 6]})
    got = [(key, [r.v for r in own]) for key, own in carry.groups_of(table.to_batches(2), ["track", "chunk"])]
    assert got == [((None, 0), [1, 2]), ((1, 0), [3, None]), ((1, 1), [5]), ((2, 0), [6])]
    words = pd.DataFrame([(1, 0, 10, "one", False), (2, 20, 30, "two.", False)], columns=["pos", "start_ms", "end_ms", "text", "last"])
    made, state = retime.word_walk(" ")(words, "[[], 0]")
    assert list(made) == [(1, 0, 30, "one two.")] and state == "[[], 0]"


def test_sides_are_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        seen.add(1)
        return text

    cues = spark.createDataFrame([("t", i, i * 1000, i * 1000 + 900, f"w{i} x{i}") for i in range(20)], CUE)
    assert retime.retimed(cues.withColumn("text", noted("text")), cues).count() == 20
    assert seen.value <= 40
