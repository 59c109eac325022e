"""Forward and backward walks over sequences that are longer than a task should hold.

A sequence is dealt in chunks, and a walk goes over one chunk from a state that the chunk before it left. All chunks are
walked at once, first from the state in which a sequence begins; a chunk whose predecessor left another state is walked
again from that, until every chunk began where its predecessor ended. Every round settles at least one more chunk of each
sequence, so the result is that of one walk over the whole; states that are soon forgotten settle in a round or two.

Rounds but the last keep states only: a short string a chunk, written in the shared folder. A chunk is held by one task,
which goes over its chunks one after another: many short ones cost little more than few long ones.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

@dataclass(frozen=True)
class Rows:
    """A chunk's rows as named tuples, which are gone over as those of a frame; many chunks are short, and a frame for each costs more than its walk."""

    own: list[tuple]

    def itertuples(self, index: bool = False) -> Iterator[tuple]:
        return iter(self.own)


#: A walk over a chunk's rows, in order, from a state: the rows it makes (tuples, or a frame; or None) and the state it leaves.
Walk = Callable[[Rows, str], tuple[list[tuple] | pd.DataFrame | None, str]]


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode without one, a folder of our own; else an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = at or tempfile.mkdtemp(prefix="tidewater-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(at)
    return at


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that a task hands on at once, and Arrow types of what walks make.
MOST_ROWS = 8192
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that are sorted by keys, by their values; nulls equal each other, and so do values that are no numbers."""

    def named() -> Iterator[tuple[tuple, tuple]]:
        row = None
        for batch in batches:
            row = row or namedtuple("Row", batch.schema.names, rename=True)
            columns = [c.to_pylist() for c in batch.columns]
            own = zip(*([v if v == v else "NaN" for v in columns[batch.schema.names.index(k)]] for k in keys), strict=True)
            yield from zip(own, map(row, *columns), strict=True)

    for key, rows in groupby(named(), key=lambda r: r[0]):
        yield key, [r for _, r in rows]


def carried(rows: DataFrame, walk: Walk, schema: str, start: str, order: list[str], by: str = "track", chunk: str = "chunk", backwards: bool = False) -> DataFrame:
    """What `walk` makes of all rows: `by` and the columns of `schema`.

    chunk: a column that ascends with the order of the rows in their sequence; rows of one value are held by one task.
    order: the columns that order a chunk's rows. backwards: chunks and their rows are walked from the last to the first."""
    keys, ascending = [by, chunk], not backwards
    kind = rows.schema[by].dataType.simpleString()
    chunk_kind = rows.schema[chunk].dataType.simpleString()
    rows = rows.where(F.col(chunk).isNotNull())
    made_kinds = {f.name: ARROW[f.dataType.simpleString()] for f in StructType.fromDDL(schema)}
    in_order = [F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c) for c in order]

    def walking(df: DataFrame, make: Callable[[list[tuple]], list[tuple]], columns: dict[str, pa.DataType | None], kinds: str) -> DataFrame:
        """What `make` makes of each chunk's rows in order; columns without a type are the rows' own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types: list[pa.DataType] = []

            def noted() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    types[:] = [batch.schema.field(c).type if t is None else t for c, t in columns.items()]
                    yield batch

            def batch_of(out: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(columns))

            out: list[tuple] = []
            for _, own in groups_of(noted(), keys):
                out += make(own)
                if len(out) >= MOST_ROWS:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        return df.repartition(*keys).sortWithinPartitions(*keys, *in_order).mapInArrow(run, kinds)

    def ends(own: list[tuple]) -> list[tuple]:
        first = own[0]
        return [(*(getattr(first, k) for k in keys), first.came, walk(Rows(own), first.came)[1])]

    def made(own: list[tuple]) -> list[tuple]:
        key, (out, _) = getattr(own[0], by), walk(Rows(own), own[0].came)
        rows = out[list(made_kinds)].itertuples(index=False, name=None) if isinstance(out, pd.DataFrame) else out or []
        return [(key, *r) for r in rows]

    def renamed(states: DataFrame, **columns: str) -> DataFrame:
        return states.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(name) for name, c in columns.items()])

    def at(other: DataFrame, states: DataFrame, how: str = "inner") -> DataFrame:
        same = F.col(by).eqNullSafe(F.col(f"__{by}")) & (F.col(chunk) == F.col(f"__{chunk}"))
        return other.join(states, same, how).drop(*[f"__{k}" for k in keys])

    def walked(from_states: DataFrame) -> DataFrame:
        """The states that chunks leave; from_states: rows with the state from which their chunk begins, came."""
        return settled(walking(from_states, ends, {by: None, chunk: None, "came": pa.string(), "left_state": pa.string()}, f"{by} {kind}, {chunk} {chunk_kind}, came string, left_state string"))

    known = walked(rows.withColumn("came", F.lit(start)))
    before = Window.partitionBy(by).orderBy(F.col(chunk).desc() if backwards else F.col(chunk))
    while True:
        due = settled(known.withColumn("due", F.coalesce(F.lag("left_state").over(before), F.lit(start))))
        stale = due.where("due <> came").select(*keys, F.col("due").alias("came"))
        if stale.isEmpty():
            break
        joined = at(due, renamed(walked(at(rows, renamed(stale, came="came"))), came_again="came", left_again="left_state"), "left")
        known = settled(joined.select(*keys, F.coalesce("came_again", "came").alias("came"), F.coalesce("left_again", "left_state").alias("left_state")))
    return walking(at(rows, renamed(known, came="came")), made, {by: None, **made_kinds}, f"{by} {kind}, {schema}")
