"""Quality scores: ridge regression over random Fourier features of document statistics, calibrated isotonically.

A document's statistics (STATISTICS) are shares of kinds of characters, words and lines, lengths, and how much repeats. A
task computes them for whole texts laid end to end as bytes; the table of them, some hundred bytes a document, serves
both the fit and the scores, so texts are read once.

Statistics are standardised by the training rows' mean and deviation and bounded to +-BOUND deviations. WIDTH random
Fourier features cos(x W + b) approximate a Gaussian kernel of bandwidth BANDWIDTH over them (W and b follow from a
seed). Each partition sums its rows' products into normal equations of WIDTH + 1 rows; these are summed row by row
across partitions, and the driver solves the one system of that size. All labelled training rows take part: four of
five in the equations, the fifth (by a hash of the id) in the calibration: counts of rows and of label 1 in 3000 bins of
the raw score, from which pool-adjacent-violators gives a monotone curve. Between the centres of its steps the curve is
linear; a millionth of the raw score orders what it leaves equal.

Defined results: a null or empty text has statistics of 0 and is scored like any other. Rows whose label or id is null
are not learned from; of several labels for an id the largest counts. Without both classes among the training rows,
and in both parts of them, every score is the share of label 1 (0 without labelled rows). Repeated rows are scored
alike. Only id and text are read. A text is held whole in one task, in slices of a few arrays of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, mix64, slices, table, text_bytes, text_or_empty

WIDTH, BANDWIDTH, BOUND, RIDGE, SEED = 384, 4.0, 4.0, 1e-3, 20
BINS, LOW, HIGH = 3000, -1.0, 2.0
#: Characters by kind; the first of each group of names that fits.
KINDS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t\r\f\v", "newline": "\n", "stop": ".", "comma": ",;:", "mark": "!?", "quote": "'\"`", "bar": "|", "symbol": "#$%&*@^~", "bracket": "()[]{}<>", "dash": "-_=+/\\"}
SHARES = ("upper", "digit", "space", "newline", "stop", "comma", "mark", "quote", "bar", "symbol", "bracket", "dash", "other")
STATISTICS = (*(f"share_{k}" for k in SHARES), "log_bytes", "log_words", "word_length", "word_spread", "one_letter", "short", "capital", "all_capital", "odd_end", "log_line", "closed_lines", "distinct_words", "distinct_lines")
_KIND = {k: i for i, k in enumerate([*KINDS, "other"])}


def _kinds() -> np.ndarray:
    of = np.full(256, _KIND["other"], np.uint8)
    for k, characters in KINDS.items():
        of[np.frombuffer(characters.encode(), np.uint8)] = _KIND[k]
    return of


KIND_OF = _kinds()
#: A random 64-bit number a byte, for sums that stand for a word or a line.
_NUMBER = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


def _runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a text's first byte begins a new one."""
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    ends[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each slice that depends on its bytes and their order."""
    length = ends - starts
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)  # place in the slice
    values = mix64(_NUMBER[data[at + np.repeat(starts, length)]] + at.astype(np.uint64))
    return np.add.reduceat(values, np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64)


def _distinct(doc: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
    """Different marks of each document."""
    order = np.lexsort((marks, doc))
    d, m = doc[order], marks[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (m[1:] != m[:-1])]) if len(d) else np.zeros(0, np.bool_)
    return np.bincount(d[new], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; texts lie end to end."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = dict.fromkeys(STATISTICS, np.zeros(n))
    if not len(data):
        return np.zeros((n, len(STATISTICS)))
    kind, doc = KIND_OF[data], np.repeat(np.arange(n), size)
    first = np.zeros(len(data), np.bool_)
    first[offsets[:-1][size > 0]] = True
    counts = np.bincount(doc * 16 + kind, minlength=16 * n).reshape(n, 16)
    per = lambda x, y: x / np.maximum(y, 1)
    for k in SHARES:
        out[f"share_{k}"] = per(counts[:, _KIND[k]], size)
    starts, ends = _runs((kind != _KIND["space"]) & (kind != _KIND["newline"]), first)
    own, length = doc[starts] if len(starts) else np.zeros(0, np.int64), ends - starts
    words = np.bincount(own, minlength=n)
    tally = lambda mask: per(np.bincount(own[mask], minlength=n), words)
    upper = np.concatenate([[0], np.cumsum(kind == _KIND["upper"])])
    lower = np.concatenate([[0], np.cumsum((kind == _KIND["lower"]) | (kind == _KIND["other"]))])
    uppers, lowers = upper[ends] - upper[starts], lower[ends] - lower[starts]
    last = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    mean = per(np.bincount(own, length, n), words)
    out |= {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "word_length": np.log1p(mean),
        "word_spread": np.log1p(np.sqrt(np.maximum(per(np.bincount(own, length.astype(float) ** 2, n), words) - mean**2, 0))),
        "one_letter": tally(length == 1), "short": tally(length <= 3), "capital": tally(kind[starts] == _KIND["upper"]) if len(starts) else np.zeros(n), "all_capital": tally((uppers > 1) & (lowers == 0)),
        "odd_end": tally(np.isin(last, [_KIND[k] for k in ("symbol", "bar", "mark", "dash", "bracket", "quote")])),
        "distinct_words": per(_distinct(own, _marks(data, starts, ends), n), words ** 0.8),
    }
    starts, ends = _runs(kind != _KIND["newline"], first)
    own = doc[starts] if len(starts) else np.zeros(0, np.int64)
    lines = np.bincount(own, minlength=n)
    last = kind[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out |= {
        "log_line": np.log1p(per(np.bincount(own, ends - starts, n), lines)), "closed_lines": per(np.bincount(own[(last == _KIND["stop"]) | (last == _KIND["mark"])], minlength=n), lines),
        "distinct_lines": per(_distinct(own, _marks(data, starts, ends), n), lines),
    }
    return np.stack([out[k] for k in STATISTICS], axis=1).astype(np.float64)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and stats (binary: 64-bit floats, little-endian) of every row."""
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    schema = kept.drop("text").withColumn("stats", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                rows = statistics(*text_bytes(some.column(1))).astype("<f8")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "stats"])

    return kept.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), len(STATISTICS))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the WIDTH features and, last, the intercept
    raw: np.ndarray  # centres of the calibration's steps, ascending
    value: np.ndarray  # and their shares of label 1
    share: float = 0.0  # every score, where there are no weights

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w, b = rng.standard_normal((len(STATISTICS), WIDTH)) / BANDWIDTH, rng.uniform(0, 2 * np.pi, WIDTH)
        x = np.clip((stats - self.centre) / self.scale, -BOUND, BOUND)
        return np.hstack([np.sqrt(2 / WIDTH) * np.cos(x @ w + b), np.ones((len(x), 1))])

    def plain(self, stats: np.ndarray) -> np.ndarray:
        """Raw scores, within the calibration's bins."""
        return np.clip(self.features(stats) @ self.weights, LOW, HIGH)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.share)
        raw = self.plain(stats)
        return np.clip((1 - 1e-6) * np.interp(raw, self.raw, self.value) + 1e-6 * (raw - LOW) / (HIGH - LOW), 0, 1)


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points x (ascending) with n rows of which `ones` have label 1: centres and values of the steps."""
    steps: list[list[float]] = []  # rows, ones, rows * x
    for a, rows, good in zip(x.tolist(), n.tolist(), ones.tolist(), strict=True):
        steps.append([rows, good, rows * a])
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last, strict=True)]
    made = np.array(steps).reshape(-1, 3)
    return made[:, 2] / made[:, 0], made[:, 1] / made[:, 0]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, len(STATISTICS)))
    rows = 0
    for batch in batches:
        x = _matrix(batch.column(0))
        sums += [x.sum(axis=0), (x * x).sum(axis=0)]
        rows += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(STATISTICS))), pa.array([float(rows)] * len(STATISTICS)), pa.array(sums[0]), pa.array(sums[1])], ["k", "n", "s", "ss"])


def _products(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = np.zeros((WIDTH + 1, WIDTH + 2)), TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                some = batch.slice(lo, 2048)
                z = model.features(_matrix(some.column(0)))
                sums[:, :-1] += z.T @ z
                sums[:, -1] += z.T @ np.asarray(some.column(1), np.float64)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array([part] * (WIDTH + 1)), pa.array([r.astype("<f8").tobytes() for r in sums], pa.binary())], ["row", "part", "products"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, part, products) in that order -> one row a row of the equations."""
    at, sums = None, np.zeros(0)
    out: list[tuple[int, bytes]] = []
    for batch in batches:
        for row, products in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if row != at:
                if at is not None:
                    out.append((at, sums.tobytes()))
                at, sums = row, np.zeros(WIDTH + 2)
            sums = sums + np.frombuffer(products, "<f8")
    if at is not None:
        out.append((at, sums.tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["row", "products"])


def _binned(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones, x = np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1, np.int64), np.zeros(BINS + 1)
        for batch in batches:
            raw = model.plain(_matrix(batch.column(0)))
            at, y = ((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), np.asarray(batch.column(1), np.int64)
            n += np.bincount(at, minlength=BINS + 1)
            ones += np.bincount(at, y, BINS + 1).astype(np.int64)
            x += np.bincount(at, raw, BINS + 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(ones[at]), pa.array(x[at])], ["bin", "n", "ones", "x"])

    return run


def fit(stats: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """stats: from measured(). learn_from: a condition on the labels' id; only such rows are learned from."""
    none = np.zeros(0)
    marked = labels.where(learn_from).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), F.lit(5)) == 0
    rows = table(stats.join(marked, "id").select("stats", "y", part.alias("tells")), "quality-rows")
    totals = {(r["tells"], r["y"]): r["n"] for r in rows.groupBy("tells", "y").agg(F.count("*").alias("n")).collect()}  # four rows at most
    if len(totals) < 4:
        whole = sum(totals.values())
        return Model(none, none, none, none, none, sum(n for (_, y), n in totals.items() if y) / whole if whole else 0.0)
    learned, told = rows.where("not tells").select("stats", "y"), rows.where("tells").select("stats", "y")
    sums = learned.mapInArrow(_moments, "k long, n double, s double, ss double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).orderBy("k").toPandas()  # a row a statistic
    centre = (sums["s"] / sums["n"]).to_numpy()
    spread = np.sqrt(np.maximum((sums["ss"] / sums["n"]).to_numpy() - centre**2, 0))
    model = Model(centre, np.where(spread > 1e-9, spread, 1.0), none, none, none)
    n = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    equations = learned.mapInArrow(_products(model), "row long, part long, products binary").repartition(n, "row").sortWithinPartitions("row", "part").mapInArrow(_added, "row long, products binary")
    held = np.stack([np.frombuffer(r["products"], "<f8") for r in sorted(equations.collect())])  # WIDTH + 1 rows
    weight = RIDGE * held[-1, -2]  # grows with the number of rows
    model.weights = np.linalg.solve(held[:, :-1] + np.diag(np.append(np.full(WIDTH, weight), 0.0)), held[:, -1])
    bins = told.mapInArrow(_binned(model), "bin long, n long, ones long, x double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.sum("x").alias("x")).orderBy("bin").toPandas()  # BINS + 1 rows at most
    model.raw, model.value = isotonic((bins["x"] / bins["n"]).to_numpy(), bins["n"].to_numpy(np.float64), bins["ones"].to_numpy(np.float64))
    return model


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id and score (0 to 1) of every row of measured()."""
    name = free("score", [id_col])
    schema = stats.select(F.col("id").alias(id_col), F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=[id_col, name])

    return stats.mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Fits on the labelled rows and scores every row: id and score."""
    stats = table(measured(docs, id_col, text_col), "quality-stats")
    return score(stats, fit(stats, labels, learn_from, id_col, label_col), id_col)
