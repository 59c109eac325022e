"""Live job logs: a state and timers a job, kept by Spark between micro-batches.

tail() follows every job's log: rows with a higher number than any before, changes of status and progress, the end; and a
timer tells when a job has been silent too long: it is reset if its worker has gone, else warned of once a generation.
changes() is a change feed of job records: added, updated, deleted, by a digest of what a record says.

Rows are (job, seq, ts, generation, status, stage, progress, alive, message). Rows of one number, or of one lower than
the job's last, are repeated or late and tell nothing; numbers may be missing. Null jobs, numbers and times are left out.
A job that has ended tells nothing more until a row of a higher generation. A job's state goes `keep` after its last row.

Both need a state store with column families (RocksDB): prepare() sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed values: how a job may end or pause, and when it is active
ENDED = ("waiting_capcut", "ready_for_translation", "paused", "completed", "failed", "cancelled")
ACTIVE = ("running", "queued")
SILENT_MS = 30 * 60 * 1000

ROW = "job string, seq long, ts timestamp, generation int, status string, stage string, progress double, alive boolean, message string"
TOLD = "job string, seq long, event string, status string, stage string, progress double, message string, silent_minutes long"
STATE = "seq long, generation int, status string, stage string, progress double, alive boolean, last_ms long, ended boolean, warned int"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _milliseconds(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class Watch(StatefulProcessor):
    """What a job's rows and its silence tell."""

    def __init__(self, silent_ms: int, keep_ms: int):
        self.silent_ms, self.keep_ms = silent_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _timers(self, at: int, active: bool) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if active:
            self.handle.registerTimer(at + self.silent_ms)
        self.handle.registerTimer(at + self.keep_ms)

    def _silence(self, at: int, status, alive, last, ended, warned, generation) -> str | None:
        """What a silence up to `at` calls for: reset, warned, or nothing."""
        if ended or status not in ACTIVE or at < last + self.silent_ms or (status == "queued" and alive):
            return None
        return "reset" if not alive else "warned" if warned != generation else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        seq, generation, status, stage, progress, alive, last, ended, warned = known or (None, None, None, None, None, None, 0, False, None)
        out = []
        # a task gets a job's rows of one micro-batch
        for r in pd.concat(list(rows)).sort_values(["seq", "ts"], kind="stable").itertuples(index=False):
            if seq is not None and r.seq <= seq:
                continue
            own = 0 if pd.isna(r.generation) else int(r.generation)
            if ended:
                if own <= generation:
                    continue
                status = progress = warned = None
                ended = False
            now_ms = _milliseconds(r.ts)
            # silence that no timer has told yet, as its end came in the same micro-batch
            if kind := self._silence(now_ms, status, alive, last, ended, warned, generation):
                out.append((key[0], seq, kind, "failed" if kind == "reset" else status, stage, None, None, self.silent_ms // 60_000))
                warned = generation
                if kind == "reset":
                    generation, status, ended = generation + 1, "failed", True
                    if own <= generation:
                        continue
                    status = progress = warned = None
                    ended = False
            seq, generation, stage, alive, last = int(r.seq), own, r.stage, bool(r.alive), max(last, now_ms)
            out.append((key[0], seq, "log", r.status, stage, None, r.message, None))
            if r.status != status:
                status = r.status
                out.append((key[0], seq, "status", status, stage, None, None, None))
            now = None if pd.isna(r.progress) else float(r.progress)
            if now != progress:
                progress = now
                out.append((key[0], seq, "progress", None, stage, progress, None, None))
            if status in ENDED:
                ended = True
                out.append((key[0], seq, "done", status, None, None, None, None))
        if out:
            self.state.update((seq, generation, status, stage, progress, alive, last, ended, warned))
            self._timers(last, not ended and status in ACTIVE)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, generation, status, stage, progress, alive, last, ended, warned = self.state.get()
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if at >= last + self.keep_ms:
            self.state.clear()
        elif kind := self._silence(at, status, alive, last, ended, warned, generation):
            reset = kind == "reset"
            out.append((key[0], seq, kind, "failed" if reset else status, stage, None, None, self.silent_ms // 60_000))
            self.state.update((seq, generation + reset, "failed" if reset else status, stage, progress, alive, last, reset, generation))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])

    def close(self) -> None:
        pass


def tail(rows: DataFrame, silent_ms: int = SILENT_MS, keep_ms: int = 24 * 60 * 60 * 1000, late: str = "1 hour") -> DataFrame:
    """job, seq, event (log, status, progress, done, warned, reset) and what each says, from a stream of rows."""
    watched = rows.where("job IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return watched.groupBy("job").transformWithStateInPandas(statefulProcessor=Watch(silent_ms, keep_ms), outputStructType=TOLD, outputMode="Append", timeMode="EventTime")


FIELDS = ("status", "stage", "progress", "generation", "updated_at", "next_event_seq", "archived")  # fixed values: what a revision covers


def revision(**fields: Column) -> Column:
    """16 hexadecimal digits of a digest of a record's fields, each under its name; nulls count."""
    return F.left(F.sha2(F.to_json(F.struct(*[F.coalesce(fields[f].cast("string"), F.lit("")).alias(f) for f in sorted(FIELDS)])), 256), F.lit(16))


CHANGE = "job string, version long, type string, generation int, updated_at string"


class Changes(StatefulProcessor):
    """Records of one job, in the order of their versions, against the last revision known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("revision", "version long, revision string, generation int, updated_at string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, known, generation, updated = self.state.get() if self.state.exists() else (None, None, 0, "")
        out = []
        for r in pd.concat(list(rows)).sort_values("version", kind="stable").itertuples(index=False):
            if version is not None and r.version <= version:
                continue
            version = int(r.version)
            now = None if r.deleted else r.revision
            if now != known:
                kind = "job_added" if known is None else "job_deleted" if now is None else "job_updated"
                if now is not None:
                    generation, updated = (0 if pd.isna(r.generation) else int(r.generation)), r.updated_at or ""
                out.append((key[0], version, kind, generation, updated))
                known = now
        # a deleted job's version stays, so that its late records stay without effect
        self.state.update((version, known, generation, updated))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def changes(records: DataFrame) -> DataFrame:
    """(job, version, deleted, generation, updated_at, revision) -> job, version, type, generation, updated_at of every change."""
    usable = records.where("job IS NOT NULL AND version IS NOT NULL").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return usable.groupBy("job").transformWithStateInPandas(statefulProcessor=Changes(), outputStructType=CHANGE, outputMode="Append", timeMode="None")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what there is now, into a Parquet table under the folder, and reads that."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
