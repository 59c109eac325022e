"""Exact top-k by inner product over integer vectors, with an impact-ordered score-at-a-time index.

Vectors are quantised to floor(scale * x) and packed into blocks of rows, written to the shared folder as the index. A
block holds its vectors and its postings: the places of all components but zeros, in segments of descending quantised
impact (the bits of the component's size). A query block reads a block's segments in that order and adds them to its
accumulators. What is still unread of a row can add no more than the product of the query's length and the unread part's
length (Cauchy-Schwarz); once every row outside a query's possible members is proven below its k-th lower bound, or below
the k-th score found in earlier blocks, the rest of the postings stays unread and the possible members are scored again,
exactly, from the vectors. A block that earlier scores exclude as a whole has none of its postings read.

Query blocks, written likewise so that a task run again sees the same rows, meet candidate blocks in an equi-join on the
candidates' block group; each pair of blocks yields at most k rows a query, of which a window keeps k.

Defined results: vectors that are null or hold null, NaN or infinite components take no part. Vectors of different
lengths have no inner product and don't meet. A candidate with the query's own id is not among its results; a candidate
with a null id is, after others of its score. A query row that repeats an id is answered by itself. Empty tables give an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

CANDIDATE_ROWS, QUERY_ROWS = 4096, 1024
#: Components of a block: longer vectors come in blocks of fewer rows.
MOST_PLACES = 1 << 22
_LAST = np.iinfo(np.int64).max  # stands for a null id


#: Shares of the squared lengths left unread at which accumulated segments are tried for a proof.
TRIES = (0.06, 0.015, 0.004, 0.001)


@dataclass
class Block:
    """Rows of the index. postings: places (row * dims + dimension) in segments of descending impact that stop at ends."""

    ids: np.ndarray
    vectors: np.ndarray
    postings: np.ndarray
    ends: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray) -> Block:
    flat = np.abs(vectors.reshape(-1).astype(np.float64))
    bits = np.frexp(flat)[1]  # 0 for zeros only, as others are integers
    order = np.argsort(-bits, kind="stable")[: int((flat > 0).sum())]
    ends = np.append(np.flatnonzero(np.diff(bits[order])) + 1, len(order)) if len(order) else np.zeros(0, np.int64)
    return Block(ids, vectors, order, ends)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Little-endian integers of the least width that holds them."""
    most = int(np.abs(values).max(initial=0))
    return values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _pack(most: int, indexed: bool):
    """(id, vector) to blocks: block, dims, ids, vectors and, if asked for, postings and ends (binary, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            ids, rows = held.pop(dims)
            made += 1
            ids, vectors = np.array(ids, "<i8"), np.array(rows, "<i8").reshape(len(ids), dims)
            data = [ids, _narrow(vectors)]
            if indexed:
                b = build(ids, vectors)
                data += [b.postings.astype("<u4"), b.ends.astype("<i8")]
            columns = [pa.array([(part << 32) + made]), pa.array([dims], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in data]]
            return pa.RecordBatch.from_arrays(columns, ["block", "dims", "ids", "vectors", *["postings", "ends"] * indexed])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(_LAST if i is None else i)
                rows.append(v)
                if len(ids) >= max(1, min(most, MOST_PLACES // max(len(v), 1))):
                    yield block(len(v))
        for dims in list(held):
            yield block(dims)

    return run


def search_block(q_ids: np.ndarray, q: np.ndarray, block: Block, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query rows, candidate rows and exact scores of each query's k best here (fewer where `known`, a k-th score each, excludes them), and the postings read."""
    ids, v = block.ids, block.vectors
    n, m, dims = len(q), len(v), v.shape[1]
    nothing = np.zeros(0, np.int64)
    if not n or not m:
        return nothing, nothing, nothing, 0
    biggest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dims, 1)
    kind = np.float32 if biggest < 1 << 23 else np.float64 if biggest < 1 << 52 else np.int64
    order = np.argsort(ids, kind="stable")
    lo, hi = np.searchsorted(ids[order], q_ids), np.searchsorted(ids[order], q_ids, side="right")
    own_q = np.repeat(np.arange(n), hi - lo)
    own_v = order[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)] or [nothing]).astype(np.int64)]
    length, left = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), (v.astype(np.float64) ** 2).sum(axis=1)
    if (length * np.sqrt(left.max(initial=0)) * 1.0001 + 1 < known).all():
        return nothing, nothing, nothing, 0
    qk, acc, part, whole = q.astype(kind), np.zeros((n, m), kind), np.zeros((m, dims), kind), max(left.sum(), 1.0)
    tries, at, possible = list(TRIES), 0, None
    for end in [*block.ends.tolist()] or [0]:
        place = block.postings[at:end]
        impact = v.reshape(-1)[place]
        part.reshape(-1)[place] = impact
        left -= np.bincount(place // max(dims, 1), impact.astype(np.float64) ** 2, m)
        at, done = end, end == len(block.postings)
        if not done and (not tries or left.sum() > tries[0] * whole):
            continue
        tries = [t for t in tries if left.sum() > t * whole]
        acc += qk @ part.T
        part[:] = 0
        slack = np.zeros((1, 1), np.float32) if done else np.outer(length, np.sqrt(np.maximum(left, 0))).astype(np.float32) * np.float32(1.0001) + np.float32(1)
        low = (acc - slack).astype(np.float64 if kind is not np.int64 else np.int64, copy=False)
        low[own_q, own_v] = -(1 << 62)
        kth = np.partition(low, m - k, axis=1)[:, m - k] if m > k else np.full(n, -(1 << 62), low.dtype)
        kth = np.maximum(kth, known)
        possible = acc + slack >= kth[:, None]
        possible[own_q, own_v] = False
        if possible.sum() <= 8 * k * n:  # few enough to score again; all others are proven out
            break
    at_q, at_v = np.nonzero(possible)
    if at == len(block.postings):
        scores = acc[at_q, at_v].astype(np.int64)
    else:
        scores = np.concatenate([np.einsum("ij,ij->i", q[at_q[a : a + 65536]], v[at_v[a : a + 65536]].astype(np.int64)) for a in range(0, len(at_q), 65536)] or [nothing])
    best = np.lexsort((ids[at_v], -scores, at_q))
    at_q, at_v, scores = at_q[best], at_v[best], scores[best]
    first = np.searchsorted(at_q, at_q)
    keep = np.arange(len(at_q)) - first < k
    return at_q[keep], at_v[keep], scores[keep], at


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # of the latest query blocks: the k-th best score so far
        for batch in batches:
            for row in range(batch.num_rows):
                block, dims, *data = (batch.column(c)[row] for c in range(8))
                dims, block = dims.as_py(), block.as_py()
                q_ids, qv, ids, vv, postings, ends = (x.as_buffer() for x in data)
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                wide = lambda x, n: np.frombuffer(x, f"<i{x.size // (n * dims)}").reshape(n, dims) if dims else np.zeros((n, 0), "<i8")
                q, here = wide(qv, len(q_ids)).astype(np.int64), Block(ids, wide(vv, len(ids)), np.frombuffer(postings, "<u4").astype(np.int64), np.frombuffer(ends, "<i8"))
                floor = known.get(block, np.full(len(q), -(1 << 62), np.int64))
                at_q, at_v, scores, _ = search_block(q_ids, q, here, k, floor)
                full = np.bincount(at_q, minlength=len(q)) >= k
                last = np.full(len(q), -(1 << 62), np.int64)
                last[at_q] = scores  # the last of each query is its smallest
                if len(known) > 256:
                    known.clear()
                known[block] = np.where(full, np.maximum(floor, last), floor)
                vec = pa.array(ids[at_v], pa.int64(), mask=ids[at_v] == _LAST)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at_q), block)), pa.array(at_q), pa.array(q_ids[at_q]), vec, pa.array(scores)], ["block", "row", "query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of each usable vector."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(usable).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("vector"))


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """queries: condition on the rows that ask. Result: query_id, rank, vec_id, score."""
    every = quantised(vectors, id_col, vector_col, scale)
    asking = quantised(vectors.where(queries).where(F.col(f"`{id_col}`").isNotNull()), id_col, vector_col, scale)
    n, n_q = vectors.count(), vectors.where(queries).count()
    groups = max(1, -(-n // CANDIDATE_ROWS))
    shape = "block long, dims int, ids binary, vectors binary"
    index = table(every.repartition(groups).mapInArrow(_pack(CANDIDATE_ROWS, True), shape + ", postings binary, ends binary"), "impact-index")
    blocks = index.select(F.shiftright("block", 32).alias("g"), "dims", "ids", "vectors", "postings", "ends")
    packed = table(asking.repartition(max(1, -(-n_q // QUERY_ROWS))).mapInArrow(_pack(QUERY_ROWS, False), shape), "impact-queries")
    asks = packed.select("block", F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    pairs = asks.hint("merge").join(blocks, (asks["g"] == blocks["g"]) & (F.col("q_dims") == F.col("dims"))).select("block", "dims", "q_ids", "q_vectors", "ids", "vectors", "postings", "ends")
    found = pairs.mapInArrow(_meet(k), "block long, row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
