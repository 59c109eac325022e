"""Mixing sources to target weights by Pfair scheduling.

Every source's rows stand in the order of md5(id), in blocks of block_size. With integer weights w of sum W, block j
(from 1) of a source is released at slot floor((j - 1) * W / w) and due by slot ceil(j * W / w); earliest deadline first
over those windows gives each source, up to any slot t, t * w / W blocks within less than one. The schedule repeats
after W slots, so one period of W slots (a parameter's size, not the data's) tells every block's slot in closed form and
all rows find theirs in parallel. A source that has run out leaves its slots empty; the others keep their order, and no
row is lost. The deviation holds up to the first slot that stays empty.

Numbering inside a source takes no window over the source: its rows fall into 4096 cells by the leading bits of md5(id),
are numbered within the cell, and start after the cells before it. That table of sources times cells
joins rows that the numbering has dealt and sorted by cell already, so they move once.

Defined results: sources without a weight and null sources are one pool of weight `other`. Null ids count as the empty
string in md5; rows with equal ids follow each other in the order of their texts' digests, equal rows in any order.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free

CELLS = 4096
MOST_SLOTS = 1 << 16
POOL = "*"


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks in one period of sum(weights) slots."""
    total = sum(weights.values())
    if any(w < 1 for w in weights.values()) or not 0 < total <= MOST_SLOTS:
        raise ValueError(f"weights are positive integers with a sum of {MOST_SLOTS} at most")
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []  # (deadline, source)
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        due, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline is missed")
        slots[s].append(t)
        if len(slots[s]) < weights[s]:
            heapq.heappush(waiting, (len(slots[s]) * total // weights[s], s))
    return slots


def arrange(docs: DataFrame, weights: dict[str, int], other: int = 1, block_size: int = 64, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", prefix: str = "") -> DataFrame:
    """All rows and columns, with prefix + block, slot and place: a row's block in its source, that block's slot, its place in the block."""
    shares = {**weights, POOL: other}
    slots, total = period(shares), sum(shares.values())
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    group = F.when(F.col(f"`{source_col}`").isin(list(weights)), F.col(f"`{source_col}`")).otherwise(F.lit(POOL))
    cell = F.conv(F.substring(F.md5(ident), 1, 3), 16, 10).cast("int")
    group_, cell_, order_, n_, start_ = (free(c, docs.columns) for c in ("__group", "__cell", "__order", "__n", "__start"))
    rows = docs.withColumns({group_: group, cell_: cell, order_: F.md5(ident)})
    counts = rows.groupBy(group_, cell_).agg(F.count("*").alias(n_))
    before = Window.partitionBy(group_).orderBy(cell_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group_, cell_, F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(start_))  # (weights + 1) * CELLS rows at most
    inside = Window.partitionBy(group_, cell_).orderBy(order_, F.col(f"`{id_col}`"), F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    numbered = rows.withColumn(n_, F.row_number().over(inside)).join(starts.hint("merge"), [group_, cell_])
    table = F.create_map(*[x for s in sorted(slots) for x in (F.lit(s), F.array(*[F.lit(t) for t in slots[s]]))])
    share = F.create_map(*[x for s in sorted(shares) for x in (F.lit(s), F.lit(shares[s]))])
    number = F.col(start_) + F.col(n_) - 1
    block = F.floor(number / block_size)
    w = share[F.col(group_)]
    slot = F.floor(block / w) * total + F.get(table[F.col(group_)], F.pmod(block, w).cast("int"))
    made = {"block": block, "slot": slot, "place": F.pmod(number, F.lit(block_size))}
    return numbered.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(free(prefix + k, docs.columns)) for k, v in made.items()])


def in_order(docs: DataFrame, weights: dict[str, int], other: int = 1, block_size: int = 64, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, range-partitioned and sorted so that files written from them follow the schedule."""
    placed = arrange(docs, weights, other, block_size, id_col, source_col, text_col, prefix="__mix_")
    by = [free("__mix_slot", docs.columns), free("__mix_place", docs.columns)]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])
