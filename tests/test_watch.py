"""Live job logs over several micro-batches against a replay."""

import datetime as dt
import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidewater.plans import entity_queries as Q
from tidewater.streaming import watch

SMALL = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def replay(rows):
    """What rows (job, seq, ts, generation, status, stage, progress, alive, message) of a job tell, in the order of their numbers; timers aside."""
    out, held = [], defaultdict(lambda: [None, None, None, None, False])  # seq, generation, status, progress, ended
    for job, seq, _, gen, status, stage, progress, _, message in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        h = held[job]
        if h[0] is not None and seq <= h[0]:
            continue
        if h[4]:
            if gen <= h[1]:
                continue
            h[2] = h[3] = None
            h[4] = False
        h[0], h[1] = seq, gen
        out.append((job, seq, "log", message))
        if status != h[2]:
            h[2] = status
            out.append((job, seq, "status", status))
        if progress != h[3]:
            h[3] = progress
            out.append((job, seq, "progress", progress))
        if status in watch.ENDED:
            h[4] = True
            out.append((job, seq, "done", status))
    return out


def told(rows):
    pick = {"log": "message", "status": "status", "progress": "progress", "done": "status", "warned": "silent_minutes", "reset": "silent_minutes"}
    return sorted((r.job, r.seq, r.event, r[pick[r.event]]) for r in rows)


def run(spark, folder, batches, **bounds):
    """Each batch of rows as a micro-batch of its own; what was told, and the rows that state still holds."""
    watch.prepare(spark)
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, watch.ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(watch.ROW).parquet(f"{folder}/in")
        query = watch.tail(stream, **bounds).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        held = query.lastProgress
    left = json.loads(held.json)["stateOperators"][0]["numRowsTotal"] if held else None
    return spark.read.parquet(f"{folder}/out").collect(), left


def test_tail_over_micro_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for job in ("a", "b", "c"):
        seq = 0
        for i in range(40):
            seq += rng.choice((1, 1, 2))
            rows.append((job, seq, T0 + dt.timedelta(seconds=10 * i), i // 15, rng.choice(["running"] * 8 + ["queued", "completed"]), "s", float(rng.randint(0, 3)), True, f"m{i}"))
    rows.sort(key=lambda r: r[2])
    batches = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    batches[2] += batches[0][:9] + [(*batches[1][0][:1], 3, *batches[1][0][2:])]  # repeated and late
    batches[1] += [(None, 1, T0, 0, "running", "s", 0.0, True, "x"), ("a", None, T0, 0, "running", "s", 0.0, True, "x")]
    got, _ = run(spark, str(tmp_path), batches)
    assert told(got) == sorted(replay(rows))


def test_silence_is_told_once_a_generation_and_state_expires(spark, tmp_path):
    row = lambda job, seq, minute, gen=0, status="running", alive=True: (job, seq, T0 + dt.timedelta(minutes=minute), gen, status, "s", 1.0, alive, "m")
    first = [row("alive", 1, 0), row("gone", 1, 0, alive=False), row("waits", 1, 0, status="queued"), row("done", 1, 0, status="completed"), row("busy", 1, 0)]
    later = [[row("busy", 2, 25), row("busy", 3, 50)], [row("busy", 4, 75), row("gone", 2, 76, gen=0)], [row("gone", 3, 90, gen=2), row("busy", 5, 100)], [row("busy", 6, 4000)], [row("end", 1, 9000)], [row("end", 2, 9001)]]
    got, left = run(spark, str(tmp_path), [first, *later], silent_ms=30 * 60_000, keep_ms=48 * 3_600_000, late="1 minute")
    silence = sorted((r.job, r.event, r.seq) for r in got if r.event in ("warned", "reset"))
    # busy is silent after its fifth and its sixth row, of one generation; gone comes back in a higher one
    assert silence == sorted([("alive", "warned", 1), ("gone", "reset", 1), ("busy", "warned", 5), ("gone", "warned", 3)])
    assert [r.seq for r in got if r.job == "gone" and r.event == "log"] == [1, 3]
    assert left is not None and left < 6


def test_changes_against_a_replay(spark):
    rows = Q.jobs_of(spark.read.parquet(f"{SMALL}/events.parquet")).orderBy("job", "seq")
    held, want = {}, []
    seen = {}
    for r in rows.collect():
        if r.seq <= seen.get(r.job, -(10**9)):
            continue
        seen[r.job] = r.seq
        now = None if r.seq % 13 == 0 else (r.status, r.stage, r.progress, r.generation)
        before = held.get(r.job)
        if now != before:
            want.append((r.job, r.seq, "job_added" if before is None else "job_deleted" if now is None else "job_updated"))
        held[r.job] = now
    got = [(r.job, r.version, r.type) for r in Q.job_changes(spark, SMALL).collect()]
    # rows of one number may come in either order
    numbers = rows.groupBy("job", "seq").agg(F.count("*").alias("n")).where("n > 1").count()
    assert len(got) == len(set(got)) and len(set(got) ^ set(want)) <= 4 * numbers and len(want) > 500


def test_watch_of_a_table(spark):
    rows = [tuple(r) for r in Q.jobs_of(spark.read.parquet(f"{SMALL}/events.parquet")).collect()]
    got = Q.job_watch(spark, SMALL).collect()
    want = [(r[0], r[1], r[2]) for r in replay(rows) if r[2] in ("status", "done")]
    found = [(r.job, r.seq, r.event) for r in got if r.event in ("status", "done")]
    repeats = len(rows) - len({(r[0], r[1]) for r in rows})
    assert abs(len(want) - len(found)) <= 4 * repeats and {r.event for r in got} >= {"log", "status", "progress", "done", "warned", "reset"}
