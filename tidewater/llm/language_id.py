"""Language identification in two steps: first the language family, then, within the family, one-versus-one linear
support vector machines between its languages.

Features: counts of hashed character 1- to 4-grams of the letters (other characters fold to one space), square-rooted
and scaled to length 1. Families come from a table of language codes; a code the table lacks is a family of its own.

fit() draws about `per_language` rows of each language (a bound in expectation, documented as the sample's parameter);
predict() reads every whole text without a shuffle.

Defined results: null texts and texts without a letter are `und` with score 0. Without a training row everything is
`und`. Rows with null text, id or language are not learned from. A tie of votes goes to the larger summed margin, then
to the alphabetically first language. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix64

BITS = 12
#: Bound of the training sample: so many rows of each language in expectation.
PER_LANGUAGE = 1200
# fixed values: ISO 639-1 codes by family
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sd si ur",
    "semitic": "am ar he mt ti",
    "austronesian": "id jv mg ms su tl",
    "sinitic": "yue zh",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def features(text: str) -> np.ndarray:
    """Vector of length 1 (or zeros)."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    letter[1:] |= letter[:-1]  # of other characters, the first after a letter stays, as a space
    own = _letters()[points]
    folded = np.where(own, points, np.uint32(32))[letter | (np.arange(len(points)) == 0)]
    a = mix64(folded.astype(np.uint64) + np.uint64(7))
    found, h = [], a
    for n in range(1, 5):
        if n > 1:
            if len(a) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[n - 1 :]
        found.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << BITS)
    v = np.sqrt(counts)
    return (v / max(np.sqrt(counts.sum()), 1e-9)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights and, last, the intercept of a linear SVM (squared hinge, classes balanced) for y of -1 and 1, by accelerated gradient steps."""
    a = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * cost
    step = 1 / (1 + 4 * share.sum())  # rows have length sqrt(2): the gradient's Lipschitz constant is at most 1 + 2 * 2 * sum
    w = z = np.zeros(a.shape[1], np.float32)
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (a @ z))
        g = z - 2 * a.T @ (share * slack * y)
        g[-1] -= z[-1]  # the intercept isn't shrunk
        new = z - step * g
        z, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    first: np.ndarray | None = None  # a column for each family, one against the rest
    pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray]] = field(default_factory=dict)  # a column for each pair of languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if self.families and has_letter(t)]
        for lo in range(0, len(at), 256):
            some = at[lo : lo + 256]
            x = np.hstack([np.array([features(texts[i]) for i in some], np.float32), np.ones((len(some), 1), np.float32)])
            z = x @ self.first
            fam = z.argmax(axis=1)
            e = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
            p_family = (e / e.sum(axis=1, keepdims=True)).max(axis=1)
            for f, name in enumerate(self.families):
                mine = np.flatnonzero(fam == f)
                who, own = self.members[name], np.ones(len(mine))
                pick = np.zeros(len(mine), np.int64)
                if len(who) > 1 and len(mine):
                    duels, w = self.pairs[name]
                    margin = x[mine] @ w
                    votes, sums, sure = (np.zeros((len(mine), len(who))) for _ in range(3))
                    for k, (i, j) in enumerate(duels):
                        m = margin[:, k]
                        votes[:, i] += m >= 0
                        votes[:, j] += m < 0
                        sums[:, i] += m
                        sums[:, j] -= m
                        p = 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
                        sure[:, i] += p / (len(who) - 1)
                        sure[:, j] += (1 - p) / (len(who) - 1)
                    pick = (votes * 1e6 + np.clip(sums, -1e4, 1e4)).argmax(axis=1)
                    own = sure[np.arange(len(mine)), pick]
                for k, r in enumerate(mine):
                    langs[some[r]], scores[some[r]] = who[pick[k]], float(np.clip(p_family[r] * own[k], 0, 1))
        return langs, scores


def train(x: np.ndarray, langs: np.ndarray, family: dict[str, str] = FAMILY) -> Model:
    if not len(x):
        return Model()
    own = {lang: family.get(lang, lang) for lang in sorted(set(langs))}
    families = sorted(set(own.values()))
    members = {f: [k for k in own if own[k] == f] for f in families}
    fam = np.array([own[k] for k in langs])
    one = np.zeros((x.shape[1] + 1, 1), np.float32)
    first = np.stack([linear_svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in families], axis=1) if len(families) > 1 else one
    pairs = {}
    for f in families:
        duels = list(combinations(range(len(members[f])), 2))
        w = []
        for i, j in duels:
            mine = (langs == members[f][i]) | (langs == members[f][j])
            w.append(linear_svm(x[mine], np.where(langs[mine] == members[f][i], 1, -1).astype(np.float32)))
        pairs[f] = (duels, np.stack(w, axis=1) if w else one)
    return Model(families, members, first, pairs)


def fit(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, family: dict[str, str] = FAMILY) -> Model:
    """learn_from: a condition on the documents' columns; only such rows are learned from."""
    usable = docs.where(learn_from).where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    totals = {r["lang"]: r["n"] for r in usable.groupBy(F.col(f"`{lang_col}`").alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    if not totals:
        return Model()
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in totals.items() for v in (k, per_language / n)]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    rows = usable.select(drawn.alias("drawn"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("drawn") < share).select("lang", "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = batch[[has_letter(t) for t in batch["text"]]]
            yield pd.DataFrame({"lang": keep["lang"], "v": [features(t).astype(np.float16).tobytes() for t in keep["text"]]})

    held = rows.mapInPandas(vectors, "lang string, v binary").toPandas().sort_values(["lang", "v"])
    x = np.array([np.frombuffer(v, np.float16) for v in held["v"]], np.float32).reshape(len(held), 1 << BITS)
    return train(x, held["lang"].to_numpy(), family)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    kept = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = kept.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
