"""Quality scores: statistics against plain loops, the fit against a dense one, held-out labels, edge cases."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewater.llm import quality, queries
from tidewater.llm.shared import table

MID, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
TEXTS = ["", None, "a", "\n", "The cat sat.\nTHE cat SAT!\n\nThe cat sat.", "über Äpfel | 12,5 %% $$$ (x)\t-- \"q\" 'r' a1B2", "x" * 200_000, "word " * 50_000, "the the the", "A\nA\nB\n", "ßß ÉÉ かな", "a\x00b\x7f c\x0b\x0cd"]
ROWS = [(i if i != 3 else None, t, "s", 0.5) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, 1.0)]


def plain(text: str | None) -> dict[str, float]:
    raw = (text or "").encode()
    kind = lambda b: next((k for k, c in quality.KINDS.items() if b < 128 and chr(b) in c), "other")
    share = lambda n, of: n / max(of, 1)
    words, lines = [w for w in re.split(rb"[ \t\r\f\v\n]+", raw) if w], [x for x in raw.split(b"\n") if x]
    kinds = [[kind(b) for b in w] for w in words]
    size = [len(w) for w in words]
    mean = share(sum(size), len(words))
    out = {f"share_{k}": share(sum(kind(b) == k for b in raw), len(raw)) for k in quality.SHARES}
    return out | {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "word_length": np.log1p(mean), "word_spread": np.log1p(np.sqrt(max(share(sum(n * n for n in size), len(words)) - mean**2, 0))),
        "one_letter": share(size.count(1), len(words)), "short": share(sum(n <= 3 for n in size), len(words)), "capital": share(sum(k[0] == "upper" for k in kinds), len(words)),
        "all_capital": share(sum(k.count("upper") > 1 and not {"lower", "other"} & set(k) for k in kinds), len(words)), "odd_end": share(sum(k[-1] in ("symbol", "bar", "mark", "dash", "bracket", "quote") for k in kinds), len(words)),
        "log_line": np.log1p(share(sum(map(len, lines)), len(lines))), "closed_lines": share(sum(kind(x[-1]) in ("stop", "mark") for x in lines), len(lines)),
        "distinct_words": len(set(words)) / max(len(words) ** 0.8, 1), "distinct_lines": share(len(set(lines)), len(lines)),
    }


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS) if t is None or len(t) < 60_000], "doc_id long, text string, stats int")
    for r in quality.measured(docs.repartition(2)).collect():
        want = plain(TEXTS[r.id])
        np.testing.assert_allclose(np.frombuffer(r.stats, "<f8"), [want[k] for k in quality.STATISTICS], rtol=1e-9, atol=1e-9, err_msg=str(TEXTS[r.id]))
    rows = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = {r.id: np.frombuffer(r.stats, "<f8") for r in quality.measured(rows).collect()}
    for r in rows.limit(8).collect():
        np.testing.assert_allclose(got[r.doc_id], [plain(r.text)[k] for k in quality.STATISTICS], rtol=1e-9, atol=1e-9)


def test_fit_is_the_dense_one(spark):
    """Weights and curve from partition sums equal those of one matrix with all rows."""
    docs, labels = queries.table(spark, MID, "documents"), queries.table(spark, MID, "labels")
    stats = table(quality.measured(docs), "stats")
    model = quality.fit(stats.repartition(7), labels, queries.fold("doc_id", 5) != 0)
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("quality")), F.lit(5)) == 0
    rows = stats.join(labels.where(queries.fold("doc_id", 5) != 0).withColumnRenamed("doc_id", "id"), "id").select("stats", "quality", part.alias("tells")).toPandas()
    x, y, tells = np.stack([np.frombuffer(s, "<f8") for s in rows["stats"]]), rows["quality"].to_numpy(float), rows["tells"].to_numpy()
    own = x[~tells]
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.standard_normal((x.shape[1], quality.WIDTH)) / quality.BANDWIDTH, rng.uniform(0, 2 * np.pi, quality.WIDTH)
    spread = own.std(axis=0)
    z = np.hstack([np.sqrt(2 / quality.WIDTH) * np.cos(np.clip((x - own.mean(axis=0)) / np.where(spread > 1e-9, spread, 1), -quality.BOUND, quality.BOUND) @ w + b), np.ones((len(x), 1))])
    a = np.vstack([z[~tells], np.sqrt(quality.RIDGE * len(own)) * np.eye(quality.WIDTH + 1)[:-1]])
    weights = np.linalg.lstsq(a, np.concatenate([y[~tells], np.zeros(quality.WIDTH)]), rcond=None)[0]
    np.testing.assert_allclose(z @ model.weights, z @ weights, atol=1e-6)
    approx = z[:50, :-1] @ z[:50, :-1].T
    scaled = np.clip((x[:50] - own.mean(axis=0)) / np.where(spread > 1e-9, spread, 1), -quality.BOUND, quality.BOUND)
    kernel = np.exp(-((scaled[:, None] - scaled[None]) ** 2).sum(axis=2) / (2 * quality.BANDWIDTH**2))
    assert np.abs(approx - kernel).mean() < 0.06
    raw = np.clip(z[tells] @ model.weights, quality.LOW, quality.HIGH)
    assert len(model.value) and (np.diff(model.value) > 0).all() and (np.diff(model.raw) > 0).all()
    bins = pd.DataFrame({"bin": ((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), "raw": raw, "y": y[tells]}).groupby("bin").agg(n=("y", "size"), ones=("y", "sum"), raw=("raw", "mean"))
    n, ones = bins["n"].to_numpy(float), bins["ones"].to_numpy(float)
    # least squares under monotony, by its min-max form
    best = [max(min(ones[i : k + 1].sum() / n[i : k + 1].sum() for k in range(j, len(n))) for i in range(j + 1)) for j in range(len(n))]
    steps = sorted(set(np.round(best, 12)))
    np.testing.assert_allclose(model.value, steps, atol=1e-9)


def test_held_out_labels(spark):
    labels = queries.table(spark, LARGE, "labels")
    r = queries.op11_quality(spark, LARGE).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = r[r.quality == 1], r[r.quality == 0]
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean() > 0.99
    assert (good.predicted == 1).mean() > 0.995 and (bad.predicted == 0).mean() > 0.85
    whole = queries.op11_quality(spark, LARGE)
    assert whole.count() == queries.table(spark, LARGE, "documents").count() and whole.where("score between 0 and 1").count() == whole.count()


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, stats string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    for learn in (F.lit(True), F.col("doc_id") < 5, F.col("doc_id") < 0):
        got = quality.scores(docs, labels, learn).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert {r.score for r in quality.scores(docs, labels, F.col("doc_id") < 0).collect()} == {0.0}
    assert {r.score for r in quality.scores(docs, labels, F.col("doc_id") == 1).collect()} == {1.0}
    assert quality.scores(docs.limit(0), labels, F.lit(True)).count() == 0
