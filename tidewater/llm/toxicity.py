"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Presence of hashed 3- to 5-grams of the lower-cased, space-folded text. Every n-gram's value is its smoothed log-count
ratio between toxic and clean training rows; a logistic regression over all of them, with weights shrunk towards zero
and the classes weighted alike, gives the classifier.

fit() reads labelled rows only, of them a sample bounded by `per_class` rows of each class in expectation, which is
written once as n-grams. Counts, and every step's loss and gradient, are sums over its partitions; the driver holds
vectors of one number for each hashed n-gram. score() reads every whole text and needs no shuffle.

Defined results: a null or empty text has no n-grams and gets the intercept's score. Rows whose label or id is null are
not learned from; of several labels for an id the largest counts. Without both classes among the training rows the
model has no features and scores the share of toxic rows (0 without any). Repeated rows are scored alike. Only id and
text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix64, slices, table

BITS = 18
SIZES = (3, 4, 5)
#: Bound of the training sample: so many rows of each class in expectation.
PER_CLASS = 4000
#: Rows that every n-gram is taken to have besides those counted, in the classes as all n-grams are.
SMOOTH = 200.0
#: Weight of the squared weights beside the loss, steps of the fit, and the norm of the gradient at which it ends.
DECAY, STEPS, FLAT = 1e-4, 20, 1e-5
#: Partitions of the sample: so many gradients reach the driver each step.
PARTS = 8


def hashes(text: str | None) -> np.ndarray:
    """Hashed n-grams of a text, repeats included."""
    folded = " ".join((text or "").lower().split())
    if not folded:
        return np.zeros(0, np.uint64)
    a = mix64(np.frombuffer(f" {folded} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    found, h = [], a
    for n in range(2, SIZES[-1] + 1):
        if len(a) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[n - 1 :]
        if n in SIZES:
            found.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def ngrams(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a text."""
    seen = np.zeros(1 << BITS, np.bool_)
    seen[hashes(text)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray  # float32, one for each n-gram hash
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.weights[ngrams(t)].sum(dtype=np.float64) for t in texts], np.float64) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: N-grams of a block of rows in the fit.
BLOCK = 1 << 18


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngrams(t).astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["grams", "toxic"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows at a time: all their n-grams, the row of each, the rows' labels."""
    for batch in batches:
        grams, labels = [np.frombuffer(x, "<i4") for x in batch.column(0).to_pylist()], np.asarray(batch.column(1), np.float64)
        ends = np.cumsum([0, *map(len, grams)])
        edges = sorted({0, len(grams), *np.searchsorted(ends, np.arange(BLOCK, int(ends[-1]), BLOCK)).tolist()})
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield np.concatenate([np.zeros(0, np.int32), *grams[lo:hi]]), np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), labels[lo:hi]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, 1 << BITS), np.int64)
    for grams, row, labels in _blocks(batches):
        for k in (0, 1):
            seen[k] += np.bincount(grams[labels[row] == k], minlength=1 << BITS)
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["gram", "clean", "toxic"])


def _slope(value: np.ndarray, bias: float, share: tuple[float, float]):
    """Summed loss and gradient of a partition for weights already times ratios."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, loss, over = np.zeros(1 << BITS), 0.0, 0.0
        for grams, row, labels in _blocks(batches):
            z = np.bincount(row, value[grams], len(labels)) + bias
            each = np.where(labels == 1, share[1], share[0])
            err = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
            loss += float((each * (np.logaddexp(0, z) - labels * z)).sum())
            over += float(err.sum())
            g += np.bincount(grams, err[row], 1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([over]), pa.array([g.tobytes()], pa.binary())], ["loss", "bias", "slope"])

    return run


def ratios(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-count ratios of n-grams (presences a class), smoothed; 0 for those that neither class has."""
    share = toxic.sum() / (toxic.sum() + clean.sum())
    return np.log((toxic + SMOOTH * share) / toxic.sum()) - np.log((clean + SMOOTH * (1 - share)) / clean.sum())


def least(slope, size: int, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """Where a smooth convex function is least, from zero, by limited-memory quasi-Newton steps; slope gives its value and gradient."""
    x = np.zeros(size)
    f, g = slope(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.sqrt(g @ g) < FLAT:
            break
        d, kept = g.copy(), []
        for s, y in reversed(past):
            kept.append((s @ d) / (s @ y))
            d -= kept[-1] * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.sqrt(g @ g))
        for (s, y), k in zip(past, reversed(kept), strict=True):
            d += s * (k - (y @ d) / (s @ y))
        t, fall = 1.0, g @ d
        while True:
            there, slope_there = slope(x - t * d)
            if there <= f - 1e-4 * t * fall or t < 1e-8:
                break
            t /= 4
        if t < 1e-8:
            break
        s, y = -t * d, slope_there - g
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        x, f, g = x + s, there, slope_there
    return x


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """learn_from: a condition on the labels' id; only such rows are learned from."""
    marked = labels.where(learn_from).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(1 << BITS, np.float32)
    if len(totals) < 2:
        return Model(none, 40.0 if 1 in totals else -40.0)
    share = F.when(F.col("toxic") == 1, per_class / totals[1]).otherwise(per_class / totals[0])
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / (1 << 30)
    sample = F.broadcast(marked.where(drawn < share))  # about 2 * per_class rows of two numbers
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(sample, "id").select("text", "toxic")
    made = rows.mapInArrow(_rows, "grams binary, toxic int")
    held = table(made.repartition(PARTS, "grams").sortWithinPartitions("grams", "toxic"), "toxicity").coalesce(PARTS)  # as many gradients, however the table is cut
    counts = held.mapInArrow(_count, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # 2 ** BITS rows at most
    own = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(own) < 2 or not counts["clean"].any() or not counts["toxic"].any():
        return Model(none, float(np.log(totals[1] / totals[0])))
    seen = np.zeros((2, 1 << BITS))
    seen[:, counts["gram"].to_numpy()] = counts[["clean", "toxic"]].to_numpy().T
    ratio = ratios(*seen)
    weight = [0.5 / own[k] for k in (0, 1)]  # either class has half of the loss

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        parts = held.mapInArrow(_slope(x[:-1] * ratio, float(x[-1]), tuple(weight)), "loss double, bias double, slope binary").toArrow().to_pylist()  # PARTS vectors or so
        parts = sorted((r["loss"], r["bias"], r["slope"]) for r in parts)  # sums in one order
        g = np.sum([np.frombuffer(r[2], np.float64) for r in parts], axis=0) * ratio + DECAY * x[:-1]
        return sum(r[0] for r in parts) + DECAY / 2 * float(x[:-1] @ x[:-1]), np.append(g, sum(r[1] for r in parts))

    x = least(slope, (1 << BITS) + 1)
    return Model((x[:-1] * ratio).astype(np.float32), float(x[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the carried columns, and score (0 to 1) of every row."""
    names = [id_col, *carry]
    kept = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = kept.drop("__text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.score(batch.column(len(names)).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], scores], names=[*names, "score"])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", most: float = 0.7) -> DataFrame:
    """The rows that score below `most`, with all their columns; a task turns few texts into strings at a time."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.filter(pa.array(model.score(texts) < most))

    return docs.mapInArrow(run, schema)
