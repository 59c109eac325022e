"""Connected components of an edge list by contraction.

Each round deals the edges evenly over as many tasks as they need, whatever their nodes. A task joins chunks of its edges by union-find over
arrays and names for each node of a chunk the smallest node that it reaches there, its root. A node that is no chunk's root
is settled: it hangs on the smallest of its roots. The other roots of a node are connected with its smallest one, and these
edges are the next round's. A node has at most one root a chunk, so no group grows with a node's edges; the largest node of
any edge list is never a root, so each round has fewer nodes. Edges of one task have final roots. Labels then go back down,
from the last round to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Edges that a task joins at once, which bounds its arrays (some 100 MB).
CHUNK = 1 << 20
#: Edges that a task is dealt, about; few edges in many tasks take more rounds, and files, than work.
SHARE = 1 << 18


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges a-b connect it with."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) to (x, root) for each node of a chunk; roots name themselves."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1)]
        nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
        label = smallest_reached(len(nodes), *np.split(place, 2))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["x", "root"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield joined(held)
            held, n = [], 0
    if n:
        yield joined(held)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (long). Result: u and component, the smallest node of u's component, for every node but those smallest ones.

    Edges with a null end and edges of a node with itself connect nothing; edges may repeat. Without edges the result is empty.
    """
    now, settled = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"), []
    for _ in range(most_rounds):
        now = cut(now)
        n = now.count()
        tasks = -(-n // SHARE)
        rooted = (now.repartition(tasks) if tasks > 1 else now.coalesce(1)).mapInArrow(_roots, "x long, root long")
        if tasks <= 1 and n < CHUNK:
            settled.append(rooted.where("x <> root").select(F.col("x").alias("u"), F.col("root").alias("component")))
            break
        grouped = cut(rooted.groupBy("x").agg(F.collect_set("root").alias("roots")))
        settled.append(grouped.where(~F.array_contains("roots", F.col("x"))).select(F.col("x").alias("u"), F.array_min("roots").alias("component")))
        now = grouped.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.array_min("roots").alias("v")).where("u <> v")
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    labels = settled.pop()
    while settled:
        below, above = settled.pop(), cut(labels).select(F.col("u").alias("up"), F.col("component").alias("top"))
        labels = below.join(above.hint("merge"), below["component"] == above["up"], "left").select("u", F.coalesce("top", "component").alias("component")).unionByName(labels)
    return labels
