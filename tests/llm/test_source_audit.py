"""The divergence audit: SQL over sf0.001 is in test_llm; here its parts, a plain computation and edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import source_audit

ROWS = [
    (1, "Apfel apfel APFEL ÄB äb", "de", "a"), (2, "apfel, birne äB", "de", "a"), (3, "apfel birne1birne ÄB", "de", "b"), (4, "birne", "de", "b"), (4, "birne", "de", "b"), (5, None, "de", "c"), (6, "", None, None),
    (7, "x y z", None, "a"), (8, "12 34 -- ", "xx", "q"), (9, "one two", "xx", "r"), (None, "apfel é", "de", None), (10, "wort " * 70_000 + "apfel", "de", "d"), (11, "wort wort", "de", "d"), (12, "wort", "de", ""),
    (13, "かな_かな 全角[かな", "ja", "a"), (14, "かな", "ja", "b"), (15, "かな 全角\x7f", "ja", "b"),
]
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, top=200):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(lower) for w in TERM.findall(text or "")]
        groups.add((lang, source))
        held[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        own = {s: held[lang, s] for k, s in groups if k == lang}
        whole = sum(own.values(), Counter())
        rate = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}  # noqa: E731, B023
        p, q = {s: rate(c) for s, c in own.items()}, rate(whole)
        for s in own:
            parts = {"pair": [(x, sum((p[s][w] - p[x][w]) ** 2 // p[x][w] for w in kept)) for x in own if x != s], "term": [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if own[s][w] and p[s][w] > q[w]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, n) for n, (i, v) in enumerate(ranked, 1) if part == "pair" or n <= top}
    return out


def test_audit_edge_cases(spark, monkeypatch):
    clash = spark.createDataFrame([(*r, 1, "t") for r in ROWS], "doc_id long, text string, lang string, source string, n long, term string")
    for parts, top in ((1, 200), (6, 2)):
        got = source_audit.audit(clash.repartition(parts), top=top).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(ROWS, top=top)
    assert {r.lang for r in got} == {"de", "", "xx", "ja"} and all(r.value == 0 for r in got if r.lang == "xx")
    assert source_audit.audit(clash.limit(0)).count() == 0


def test_audit_in_small_blocks(spark, monkeypatch):
    """Tasks that send their counts early, and blocks of the matrix of a few whole terms."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.zipf(1.5, 60) % 300), "en" if i % 3 else "de", f"s{i % 7}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = {tuple(r) for r in source_audit.audit(docs).collect()}
    assert whole == brute(rows)
    parts = docs.select("lang", "source", "text").repartition(2).mapInArrow(lambda b: source_audit._count(b), "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).collect()
    for name, value in (("HELD_TERMS", 20), ("HELD_COUNTS", 90)):
        monkeypatch.setattr(source_audit, name, value)
    import pyarrow as pa

    table = pa.table({"lang": [r[2] for r in rows], "source": [r[3] for r in rows], "text": [r[1] for r in rows]})
    again, batches = Counter(), 0
    for out in source_audit._count(iter(table.to_batches(10))):
        batches += 1
        for lang, source, term, n in zip(*(c.to_pylist() for c in out.columns[:4])):
            again[lang, source, term] += n
    assert batches > 5 and again == {(r.lang, r.source, bytes(r.term)): r.n for r in parts}
    monkeypatch.setattr(source_audit, "BLOCK", 7)
    entries = [("en", 0, None, s, 0, 20) for s in "abc"] + [("en", 1, w, s, 1 + i, None) for i, w in enumerate("pqrstuvw") for s in "ab"]
    sums = []
    for size in (3, 100):
        batch = pa.table(dict(zip(("lang", "kind", "term", "source", "n", "whole"), zip(*entries)))).to_batches(size)
        total = Counter()
        for out in source_audit._pairs(iter(batch)):
            for lang, g, h, v in zip(*(c.to_pylist() for c in out.columns)):
                total[lang, g, h] += v
        sums.append(total)
    assert sums[0] == sums[1] and len(sums[0]) == 6


def test_words_of_one_hash_are_told_apart():
    words = [b"aa", b"bb", b"aa", b"ccc", b"bb", b"ddd", b"\xc3\xa4"]
    for hashed in (len, lambda w: 0):
        distinct, place = source_audit.grouped(words, hashed)
        assert [distinct[i] for i in place] == words and len(distinct) == len(set(distinct)) == 5
    assert source_audit.grouped([])[0] == []


def test_rates_of_large_counts_are_exact():
    counts = [0, 1, 7, 10**9, 10**12 + 3, 8 * 10**13]
    whole = np.array([9 * 10**13 + 17] * len(counts))
    assert source_audit.rates(np.array(counts), whole).tolist() == [1 + 10**9 * (c + 1) // (9 * 10**13 + 17) for c in counts]
