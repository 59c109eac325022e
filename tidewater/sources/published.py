"""A table that is published whole: readers see the last commit or the one before, never a part of one.

A commit writes the groups that have changed, under a fresh folder, then a manifest of all groups (a group's folder, rows
and digest), and last an empty file with the commit's number, made only if it isn't there: that one step publishes. A
write that dies before leaves folders that no manifest names. Two writers who start from one commit can't both publish;
the later one fails and changes nothing. Groups whose rows are as before are not written again.

Throttled collects updates of groups and commits after every eighth, after half a minute, or at once for a failure.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "`group` string, folder string, rows long, digest string"


class Published:
    def __init__(self, spark: SparkSession, folder: str, schema: str, by: str):
        self.spark, self.folder, self.schema, self.by = spark, folder.rstrip("/"), schema, by

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        fs, at = self._fs(), self._path("commits")
        return max([0, *(int(f.getPath().getName()) for f in fs.listStatus(at))]) if fs.exists(at) else 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """group, folder, rows, digest of a commit (the last)."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifests/{self._manifest_of(version)}") if version else self.spark.createDataFrame([], MANIFEST)

    def _manifest_of(self, version: int) -> str:
        stream = self._fs().open(self._path("commits", str(version)))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a commit (the last)."""
        live = self.manifest(version)
        folders = [r["folder"] for r in live.select("folder").distinct().collect()]  # folders that hold a live group
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, __folder string").parquet(*[f"{self.folder}/data/{f}" for f in folders])
        named = live.select(F.col("group").alias("__group"), F.col("folder").alias("__folder"))
        return rows.withColumn("__group", F.col(self.by).cast("string")).join(named, ["__group", "__folder"], "left_semi").drop("__group", "__folder")

    def _digests(self, rows: DataFrame) -> DataFrame:
        """Rows and a digest of each group, whatever its rows' order: sums of two hashes of each row."""
        row = F.struct(*[F.col(c) for c in sorted(rows.columns)])
        each = rows.select(F.col(self.by).cast("string").alias("group"), F.xxhash64(F.to_json(row)).alias("a"), F.xxhash64(F.lit("2"), F.to_json(row)).alias("b"))
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string")
        return each.groupBy("group").agg(F.count("*").alias("rows"), F.concat_ws(":", total("a"), total("b")).alias("digest"))

    def publish(self, rows: DataFrame, start: int | None = None) -> int:
        """Publishes rows as the whole table; gives the commit's number, the old one where nothing has changed. start: the commit that rows follow from (the last).

        Rows without a group are left out."""
        start = self.version() if start is None else start
        rows = rows.select(*[c.split()[0] for c in self.schema.split(", ")]).where(F.col(self.by).isNotNull())
        now, before, folder = self._digests(rows), self.manifest(start).withColumnRenamed("folder", "old"), uuid.uuid4().hex
        met = now.join(before.select("group", "rows", "digest", "old"), ["group", "rows", "digest"], "left")
        fresh = met.where("old IS NULL").select(F.col("group").alias("__group"))
        data = rows.withColumn("__group", F.col(self.by).cast("string")).join(fresh, "__group", "left_semi").drop("__group").withColumn("__folder", F.lit(folder))
        data.write.parquet(f"{self.folder}/data/{folder}")
        # what was written is what is named, should rows have come out otherwise this time
        written = self._digests(self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{folder}")).withColumn("folder", F.lit(folder))
        kept = met.where("old IS NOT NULL").select("group", F.col("old").alias("folder"), "rows", "digest")
        whole = kept.unionByName(written)
        if not written.count() and kept.count() == before.count():
            return start
        name = uuid.uuid4().hex
        whole.write.json(f"{self.folder}/manifests/{name}")
        stream = self._fs().create(self._path("commits", str(start + 1)), False)  # fails where it is there
        stream.writeUTF(name)
        stream.close()
        return start + 1


class Throttled:
    """Updates of whole groups, committed together."""

    def __init__(self, store: Published, every: int = 8, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.store, self.every, self.seconds, self.clock = store, every, seconds, clock
        self.waiting: list[DataFrame] = []
        self.last = clock()

    def put(self, rows: DataFrame, state: str = "success") -> bool:
        """Takes a batch's rows in, each group of them whole; True if that committed. Failed and pending batches commit at once."""
        self.waiting.append(rows)
        if state in ("failed", "pending") or len(self.waiting) >= self.every or self.clock() - self.last >= self.seconds:
            self.flush()
            return True
        return False

    def flush(self) -> int:
        """Commits what waits; of a group that came several times the last rows count."""
        self.last = self.clock()
        if not self.waiting:
            return self.store.version()
        start, by = self.store.version(), self.store.by
        every = self.store.read(start).withColumn("__turn", F.lit(0))
        for turn, rows in enumerate(self.waiting, 1):
            every = every.unionByName(rows.withColumn("__turn", F.lit(turn)))
        last = every.groupBy(F.col(by).alias("__by")).agg(F.max("__turn").alias("__last"))
        kept = every.join(last, (F.col(by) == F.col("__by")) & (F.col("__turn") == F.col("__last")), "left_semi").drop("__turn")
        done = self.store.publish(kept, start)
        self.waiting = []
        return done
