"""Similarity joins against all pairs."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import neighbours, similar, stretches
from tidewater.plans import entity_queries as Q

SMALL = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_no_near_pair_is_lost(spark):
    rng = random.Random(1)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    a, b = spark.createDataFrame([(w,) for w in words[:150]] + [("",), (None,)], "word string"), spark.createDataFrame([(w,) for w in words[100:]] + [("",), (None,)], "name string")
    for most in (1, 2):
        got = {(r.word, r.name) for r in similar.near_pairs(a, b, F.greatest(F.lit(1), F.length("word") + 1 - 2 * most)).collect()}
        near = {(x, y) for x in words[:150] for y in words[100:] if edits(x, y) <= most and len(x) + 1 - 2 * most >= 1}
        assert near <= got and len(near) > 50
    assert similar.near_pairs(a.limit(0), b, F.lit(1)).count() == similar.near_pairs(a, b.limit(0), F.lit(1)).count() == 0


def test_audited_in_other_scripts(spark):
    rows = [("f1", "カタカナ テスト ガール"), ("f2", "カタカナとテスト、ガール"), ("f3", "カタカナ ガール"), ("f3", None), (None, "ガール"), ("f1", "テスト")]
    known = spark.createDataFrame([("カタカム",), ("テスト",), ("ガ・ー・ルズ",)], "term string")
    got = {r.word: tuple(r)[1:] for r in similar.audited(spark.createDataFrame(rows, "track string, text string"), known, "ja").collect()}
    assert got == {"カタカナ": (3, "カタカム", 0.75, "high"), "ガール": (4, "ガルズ", None, "low")} or got["カタカナ"] == (3, "カタカム", 0.75, "high")


def names_for(text, names):
    """Names that one or two words of a text are nearly, name by name."""
    out = set()

    def best(surface, fits):
        low = re.sub("[^a-z0-9]", "", surface.lower())
        ranked = []
        for n in names:
            o = n.lower()
            d, r = edits(low, o), SequenceMatcher(None, low, o).ratio()
            if fits(low, o, d, r):
                ranked.append((r, -d, n))
        ranked.sort(reverse=True)
        if ranked and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= 0.08):
            out.add((surface, ranked[0][2]))

    for s in set(re.findall(r"(?<![A-Za-z])[A-Za-z]{5,}(?![A-Za-z])", text)):
        if s[0].isupper():
            best(s, lambda low, o, d, r: low != o and d <= 2 and r >= 0.82)
    for s in set(re.findall(r"(?<![A-Za-z])[A-Za-z]+[ -][A-Za-z]+(?![A-Za-z])", text)):
        halves = s.split()
        if all(len(re.sub("[^A-Za-z]", "", h)) >= 2 and h.lower() not in similar.FUNCTION_WORDS for h in halves) and len(re.sub("[^a-z0-9]", "", s.lower())) >= 4:
            best(s, lambda low, o, d, r: d <= 3 and abs(len(low) - len(o)) <= 2 and (r >= 0.72 or d <= 2))
    return out


def test_heard_names_against_every_name(spark):
    names = [r.term for r in Q.names(spark, SMALL).collect()][:]
    texts = {(r.track, r.pos): r.text for r in Q.misspelt(spark, SMALL).where("track < 2").collect()}
    got = {}
    for r in Q.heard_names(spark, SMALL).where("track < 2").collect():
        got.setdefault((r.track, r.pos), set()).add((r.surface, r.term))
    want = {k: found for k, t in texts.items() if (found := names_for(t, names))}
    assert got == want and sum(map(len, want.values())) > 5


def test_near_terms_against_every_window(spark):
    rows, terms = Q._foreign(spark, SMALL, "ja")
    terms = [(r.term, r.target) for r in terms.where("length(term) BETWEEN 3 AND 7").collect()]
    terms = sorted(set(terms))[::9]
    texts = [(r.track, r.pos, r.text[:90]) for r in rows.where("track < 7").collect()] + [(99, 1, None), (99, 2, ""), (99, 3, "アエ"), (99, 4, "ア ・イ-エ")]
    got = {(r.track, r.pos, r.term, r.target, r.surface, r.confidence) for r in similar.nearly_in(spark.createDataFrame(texts, "track long, pos long, text string"), ["track", "pos"], spark.createDataFrame([*terms, ("アイエ", "x"), ("アカエ", "y"), ("ab", "z"), (None, "z"), ("アイウ", "")], "term string, target string")).collect()}
    want, known = set(), {}
    for term, target in [*terms, ("アイエ", "x"), ("アカエ", "y")]:
        known.setdefault((similar.compact(term), target), term)
    for track, pos, text in texts:
        body = similar.compact(text)
        for (name, target), term in known.items():
            if name in body:
                continue
            best, most = "", 0.0
            for width in range(max(2, len(name) - 1), min(len(body), len(name) + 1) + 1):
                for i in range(len(body) - width + 1):
                    r = SequenceMatcher(None, body[i : i + width], name).ratio()
                    if r > most:
                        best, most = body[i : i + width], r
            if most >= 0.78:
                want.add((track, pos, term, target, best, round(most, 3)))
    assert got == want and len(want) > 3
    assert similar.nearly_in(spark.createDataFrame(texts, "track long, pos long, text string").limit(0), ["track", "pos"], spark.createDataFrame(terms, "term string, target string")).count() == 0


def test_near_terms_by_groups_and_without_pairs_of_texts(spark):
    """Texts go through one task each, whatever the terms, and meet no table of their pairs of letters; many terms are dealt in groups."""
    terms = spark.createDataFrame([("アカエオ", "x"), ("イウエオカキク", "y"), ("サシスセソ", "z"), ("アカエオ", "w")], "term string, target string")
    rows = spark.createDataFrame([(1, "アエオ"), (2, "イウオカキクサシセソ"), (3, "アカエオ"), (4, None), (5, "アアカキエオイウエオカキケク")], "id long, text string")
    one, many = similar.nearly_in(rows, ["id"], terms), similar.nearly_in(rows, ["id"], terms, most_bytes=100)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and {(1, "x"), (2, "z"), (5, "y")} <= {(r.id, r.target) for r in one.collect()}


def nearest(texts, names, least):
    """Each text's stretch that is most like a name, window by window."""
    out = set()
    for k, text in enumerate(texts):
        for name in names:
            ways = [(-SequenceMatcher(None, text[i : i + w], name).ratio(), w, i) for w in range(max(2, len(name) - 1), len(name) + 2) for i in range(len(text) - w + 1)]
            if name not in text and ways and -min(ways)[0] >= least:
                ratio, w, i = min(ways)
                out.add((k, name, text[i : i + w], -ratio))
    return out


def found_by(index, texts):
    return {(int(t), index.names[k], s, 2.0 * m / n) for which, name, surface, share, both in index.best(texts) for t, k, s, m, n in zip(which, name, surface.to_pylist(), share, both, strict=True)}


def test_stretches_against_every_window(monkeypatch):
    """Names that letters are left out of, those that go through texts bit by bit and those of more than 64 letters, in one part or many, with tables that overflow."""
    rng = random.Random(3)
    made = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    names = sorted({made(n, "アイウé𠮷") for n in (1, 2, 3, 3, 4, 5, 6, 7, 8, 8, 9, 10, 10, 11, 12, 13, 14, 17, 24, 64, 66)})
    slip = lambda t: "".join(rng.choice(["", "x", c + "ア"]) if rng.random() < 0.1 else c for c in t)
    texts = ["".join(slip(rng.choice(names)) + made(rng.randint(0, 3), "アイx") for _ in range(rng.randint(0, 6))) for _ in range(40)]
    texts += ["", "ア", names[0], made(700, "アイウé𠮷x"), texts[3], texts[3]]
    want = nearest(texts, names, 0.78)
    assert {len(n) for _, n, _, _ in want} >= {3, 6, 8, 10, 11, 12, 14, 17}
    assert found_by(stretches.Stretches(names, 0.78), texts) == want
    for small in ({"RUN": 50, "STEP": 7}, {"KEPT": 16, "LANES": 8}, {"NEAR": 20, "PLACES": 1}, {"WAYS": 1}):
        with monkeypatch.context() as m:
            for name, value in small.items():
                m.setattr(stretches, name, value)
            assert found_by(stretches.Stretches(names, 0.78), texts) == want
    assert found_by(stretches.Stretches([], 0.78), texts) == found_by(stretches.Stretches(names, 0.78), []) == set()
    for least in (0.2, 0.5):
        some = [n for n in names if len(n) > 1][:6]
        assert found_by(stretches.Stretches(some, least), texts[:9]) == nearest(texts[:9], some, least)


def test_stretches_that_come_again_are_not_measured_again(monkeypatch):
    counted, measure = [], stretches.matched
    monkeypatch.setattr(stretches, "matched", lambda a, b: (counted.append(len(a)), measure(a, b))[1])
    index = stretches.Stretches(["アイウエオ", "カキクケコサ"], 0.78)
    texts = ["アイウオとカキケコサ", "アアイウオ", "イウエオキクケコサ"] * 20
    first = found_by(index, texts)
    once = sum(counted)
    assert found_by(index, texts) == first and len(first) > 60 and sum(counted) == once < 40


def test_blocks_as_the_matcher_counts_them():
    rng = random.Random(5)
    for w, n in ((3, 4), (8, 7), (12, 12), (101, 3)):
        left, right = (["".join(rng.choice("abcd") for _ in range(k)) for _ in range(200)] for k in (w, n))
        made = neighbours.matched(*(np.stack([neighbours.codes(t) for t in side]) for side in (left, right)))
        assert [2.0 * int(m) / (w + n) for m in made] == [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)]


def test_near_names_against_all_pairs_both_ways(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(120)})
    names = sorted({w[:2] + w[3:] + rng.choice("abé") for w in words[::2] if len(w) > 3} | {"x"})
    asked = spark.createDataFrame([(k, w) for w in words for k in "pq"] + [("p", ""), ("p", None)], "kind string, word string")
    known = spark.createDataFrame([("p", n) for n in names] + [("q", n) for n in names[::2]] + [("q", "")], "kind string, name string")
    rules = {"p": (lambda n, w: max(n, w) - 2, 2), "q": (lambda n, w: neighbours.least_shared(n, w, 0.8), 1)}
    want = set()
    for kind, own in (("p", names), ("q", names[::2])):
        for w in words:
            for n in own:
                alike = SequenceMatcher(None, w, n).ratio()
                if (edits(w, n) <= 2 and min(len(w), len(n)) > 2) if kind == "p" else (abs(len(w) - len(n)) <= 1 and alike >= 0.8):
                    want.add((kind, w, n, alike))
    one, many = ({tuple(r) for r in similar.near_names(asked, known, rules, m).collect()} for m in (8 << 20, 2000))
    assert one == many and want <= one and len(want) > 60
