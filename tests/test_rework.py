"""Fixed cases of kept work, rebuilds, change plans, reports, misheard names and shown cues; those without SQL also over whole tables."""

import re
from difflib import SequenceMatcher
from itertools import groupby
from math import ceil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import display, names, reports, rework
from tidewater.operators.folds import Cue
from tidewater.operators.similar import near_pairs
from tidewater.plans import rework_queries as q

SF = "/root/testdata/sf0.01"


def test_kept_results(spark):
    fresh = spark.createDataFrame([(1, 1, 0, 10, "a"), (1, 2, 20, 30, "b"), (1, 3, 40, 50, "c"), (1, 4, 60, 70, "d"), (1, 5, 80, 90, None)], "track int, id int, start_ms int, end_ms int, text string")
    entries = spark.createDataFrame([(1, 9, 0, 10, "a"), (1, 2, 21, 30, "b"), (1, 3, 41, 50, "[music] c"), (1, 5, 80, 90, None)], "track int, id int, start_ms int, end_ms int, original string")
    results = spark.createDataFrame([(1, 1, 9, "a", "A"), (1, 2, 9, "a", "A2"), (1, 3, 2, "b", "B"), (1, 4, 2, "b", " "), (1, 5, 3, "[music] c", "C"), (1, 6, 4, "other", "D"), (1, 7, 5, None, "E")], "track int, seq int, id int, original string, translated string")
    got = {r.id: (r.kept, r.by) for r in rework.kept_results(fresh, results, entries).collect()}
    assert got == {1: ("A2", "times"), 2: ("B", "id"), 3: ("C", "cleaned"), 4: (None, None), 5: ("E", "times")}
    assert rework.kept_results(fresh, results.limit(0), entries.limit(0)).where("kept IS NULL").count() == 5


def test_kept_answers(spark):
    active = spark.createDataFrame([(1, 1, "k", "en"), (1, 2, "k", "ja"), (1, 3, None, None), (1, 4, "x", "en")], "track int, id int, key string, language string")
    entries = spark.createDataFrame([(1, 1, "k"), (1, 2, "k"), (1, 3, ""), (1, 4, "y")], "track int, id int, key string")
    results = spark.createDataFrame([(1, i, i, d, " t ", None) for i, d in ((1, "KEEP"), (2, "keep"), (3, None), (4, "keep"))], "track int, seq int, id int, decision string, translated string, confidence double")
    rows = lambda **k: sorted(tuple(r)[1:] for r in rework.kept_answers(active, entries, results, **k).collect())
    assert rows() == [(1, "keep", "t", 0.0), (2, "keep", "t", 0.0), (3, "review", "t", 0.0)] and [r[0] for r in rows(legacy=True)] == [1, 3]


def test_rebuilds(spark):
    kind = "track int, pos int, start_ms int, end_ms int, d string, c boolean, f double, u array<string>"
    rows = [(1, 1, 30, 40, "unresolved", False, 0.9, None), (1, 2, 0, 9, "primary", True, 0.4, ["x"]), (1, 3, 10, 20, "primary", True, 0.45, []), (1, 4, 10, 20, None, None, None, ["x"]), (2, 1, 0, 1, "unresolved", None, None, None)]
    u = spark.createDataFrame(rows, kind).withColumn("reasons", rework.rebuild_reasons(F.col("d"), F.col("c"), F.col("f"), F.col("u")))
    got = {(r.track, r.pos): (r.reasons, r.called) for r in rework.rebuild_queue(u, 1).collect()}
    assert got == {(1, 1): (["source_unresolved"], False), (1, 2): (["low_confidence_conflict", "unknown_entity_conflict"], True), (2, 1): (["source_unresolved"], True)}
    near = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "", "b"), (1, 3, None, ""), (1, 4, "d", None)], "track int, pos int, canonical string, evidence string")
    assert [(r.before, r.after) for r in rework.neighbours(near).orderBy("pos").collect()] == [([], ["b"]), (["a"], ["d"]), (["a", "b"], ["d"]), (["b"], [])]
    said = spark.createDataFrame([(["unknown_entity:Foo"],), (["credit_line", "x:number_mismatch"],), ([],), (None,)], "r array<string>")
    assert [r.b for r in said.select(rework.blocks(F.col("r")).alias("b")).collect()] == [True, False, False, False]


def test_change_plan(spark):
    store = spark.createDataFrame([("a", "A", "c"), ("b", "B", "c"), ("d", "D", "c")], "term string, target string, category string")
    kind = "action int, operation string, old_term string, term string, target string, category string"
    doing = [(1, "add", None, "n", "N", "c"), (2, "add", None, "a", "A", "c"), (3, "add", None, "a", "A", "z"), (4, "replace", "b", "bb", "B", "c"), (5, "replace", "b", "a", "B", "c"), (6, "replace", "b", "bc", "X", "c"), (7, "replace", "no", "d", "D", "c"), (8, "replace", "no", "e", "E", "c")]
    plan = rework.change_plan(spark.createDataFrame(doing, kind), store)
    assert {r.action: r.why or r.state for r in plan.collect()} == {1: "change", 2: "applied", 3: "existing row conflicts", 4: "change", 5: "both rows exist", 6: "target differs", 7: "applied", 8: "old row is missing"}
    assert sorted(r.term for r in rework.apply_plan(store, plan).collect()) == ["a", "bb", "d", "n"]
    with pytest.raises(Exception, match="two changes to n"):
        rework.apply_plan(store, plan.unionByName(plan.where("action = 1"))).collect()


def test_reports(spark):
    kind = "g int, gold string, translation string, entities array<string>"
    rows = [(1, "不 3 1", " 不 1 3", ["1", "z"]), (1, "a?", "a", None), (1, "b", "__ERROR__ b", []), (1, "", "x", None), (1, None, "x", None), (1, "c", "c 안", ["c"])]
    (r,) = reports.translation_scores(spark.createDataFrame(rows, kind), "g").collect()
    assert tuple(r) == (1, 3, 0, 1, 1, 1.0, 1.0, 0.667, 0.667)
    assert reports.translation_scores(spark.createDataFrame(rows, kind).limit(0), "g").count() == 0
    cues = spark.createDataFrame([(1, 0, 500), (1, 500, 600)], "track int, start_ms int, end_ms int")
    assert sorted(map(tuple, reports.speech_coverage(cues, spark.createDataFrame([(1, 1000), (2, 10), (3, 0)], "track int, audio_ms int")).collect())) == [(1, 0.6), (2, 0.0), (3, None)]


def test_edits():
    assert [names.edits(a, b) for a, b in (("abcd", "acbd"), ("", "ab"), ("kitten", "sitting"), ("same", "same"), ("ca", "abc"), ("ab", ""))] == [1, 2, 3, 0, 3, 2]


def test_words_within_two_edits_meet(spark):
    """Every name that is one or two edits off a word, swaps of neighbours among them, is found for it."""
    pairs = [("jinhsi", "jihnsi"), ("jinhsi", "jnhsii"), ("abcdef", "badcef"), ("abcdef", "abxdyf"), ("rover", "rovers"), ("aaaa", "aaa"), ("abcdefgh", "cdefgh"), ("abcdefghijk", "cdefghijk"), ("abcdefghi", "abcdefghixy"), ("abcdefghijklm", "bacdefghijlkm"), ("abcd", "acbd")]
    known = spark.createDataFrame([(b.capitalize(), "t", "character") for _, b in pairs], "term string, target string, category string")
    rows = spark.createDataFrame([(i, a.capitalize()) for i, (a, _) in enumerate(pairs)], "id int, text string")
    asked = names.runs(rows, ["id"], [1])
    met = {(r.word, r.name) for r in near_pairs(asked, known.select(names.folded(F.col("term")).alias("name"), F.lit(1).alias("n")), names.shared_pairs(F.col("word"), F.col("cased")), same=("n",)).collect()}
    assert set(pairs) <= met


def test_misheard_cases(spark):
    rows = spark.createDataFrame([(1, "I met Jihnsi and Rovre, jiyann too"), (2, None), (3, "Jinhsi"), (4, ""), (5, "Carta")], "id int, text string")
    known = [("Jinhsi", "J", "character"), ("Rover", "R", "character"), ("Jiyan", "Y", "story_character"), ("Rovre (x)", "f", "character"), ("Rovre", "g", "place"), (None, "x", "character"), ("Carte", "one", "character"), ("Carto", "two", "character")]
    got = names.misheard(rows, ["id"], spark.createDataFrame(known, "term string, target string, category string"), spark.createDataFrame([(3, "Jinhsi")], "id int, term string")).collect()
    assert sorted((r.id, r.run, r.target) for r in got) == [(1, "Jihnsi", "J"), (1, "Rovre", "R"), (1, "jiyann", "Y")]


def test_misheard_over_whole_tables(spark):
    known = [(t, g, re.sub("[^a-z0-9]", "", t.lower()), len(re.findall("[A-Za-z]+", t))) for t, g, _ in q._names(spark, SF).collect()]
    judged = {}

    def judge(word, n, cased):
        ranked = []
        for term, target, name, size in known:
            if size != n or not name or abs(len(name) - len(word)) > (2 if cased else 1) or not (cased or word[0] == name[0]):
                continue
            short = max(len(name), len(word)) <= 5
            ratio = SequenceMatcher(None, word, name)
            least = (0.8 if short else 0.82) if cased else 0.85
            if ratio.quick_ratio() >= least and ratio.ratio() >= least and (d := names.edits(word, name)) <= (2 if cased and not short else 1):
                ranked.append((ratio.ratio(), -d, term, target))
        ranked.sort(reverse=True)
        if ranked and (len(ranked) == 1 or ranked[0][3] == ranked[1][3] or ranked[0][0] - ranked[1][0] >= 0.08):
            return ranked[0][2:]

    want = set()
    for track, pos, text in q._heard(spark, SF).where("track % 24 = 0").collect():  # a fixture of the test; the query reads all
        w, seen = re.findall("[A-Za-z][A-Za-z'’-]*", text), {re.sub("[^a-z0-9]", "", text.split(" ")[0].lower())}
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                word, cased = re.sub("[^a-z0-9]", "", "".join(w[i : i + n]).lower()), any(x[:1].isupper() for x in w[i : i + n])
                if word in seen or len(word) < (4 if cased else 6) or word in names.COMMON:
                    continue
                seen.add(word)
                if (word, n, cased) not in judged:
                    judged[word, n, cased] = judge(word, n, cased)
                if judged[word, n, cased]:
                    want.add((track, pos, " ".join(w[i : i + n]), *judged[word, n, cased]))
    got = q.misheard_names(spark, SF).where("track % 24 = 0").collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want) > 20


@pytest.mark.parametrize(
    ("text", "n", "want"),
    [
        ("短句", 1, ["短句"]),
        ("第一句话在这里，第二句话在那里。第三句话也有了！", 3, ["第一句话在这里，", "第二句话在那里。", "第三句话也有了！"]),
        ("好，第一句话在这里，第二句话。", 3, ["好，第一句话在这里，", "第二句话。"]),
        ("我们升级到了版本3.1剧情之后再说吧", 2, ["我们升级到了版本3.1剧情之后再说吧"]),  # two clauses part inside the number and become one again
        ("我们升级吧版本12.34剧情啊啊", 3, ["我们升级吧", "版本12.34", "剧情啊啊"]),
        ("one two three four five six", 2, ["one two three", "four five six"]),
        ("我们看到了斯特赖德之门外面有人", 2, ["我们看到了斯特赖德", "之门外面有人"]),
    ],
)
def test_pieces(text, n, want):
    assert display.pieces(text, n) == want


def test_spread():
    cue = lambda text, start=0, end=10_000: Cue(1, start, end, text)
    text = "第一句话在这里写得很长很长，第二句话在那里写得很长很长。"
    assert list(display.spread(cue(text), [(0, 4000), (4000, 10_000)])) == [(0, 4000, text[:14]), (4000, 10_000, text[14:])]
    assert list(display.spread(cue("短"), [])) == [(0, 10_000, "短")] and list(display.spread(cue(" "), [])) == []
    made = list(display.shown_cues(iter([Cue(1, 0, 1000, "a", (None,)), Cue(2, 900, 1100, "b", (None,)), Cue(3, 1050, 3000, "c", (None,))])))
    assert [(c.pos, c.start, c.end, c.text) for c in made] == [(1, 0, 1100, "a b"), (2, 1101, 3000, "c")]


def test_rhythm_over_whole_tables(spark):
    want = []
    for track, own in groupby(sorted(tuple(r) for r in q._long_cues(spark, SF).collect()), key=lambda r: r[0]):
        number = 0
        for _, pos, start, end, text in own:
            text, length = (text or "").strip(), max(1, end - start)
            size = display.seen(text)
            n = 1 if length <= 6000 or size < 36 else min(max(ceil(length / 6000), ceil(size / 18)), max(2, size // 6))
            parts = display.pieces(text, n)
            edges = [start, *[start + round(length * k / len(parts)) for k in range(1, len(parts))], end]
            for k, part in enumerate(parts):
                number += 1
                want.append((track, pos, k, edges[k], edges[k + 1], part, number))
    got = sorted(tuple(r) for r in q.reading_rhythm(spark, SF).select("track", "pos", "k", "start_ms", "end_ms", "text", "id").collect())
    assert got == sorted(want) and any(r[2] for r in got)


def test_shown_cues_over_whole_tables(spark):
    """Against a walk; all letters of a track stay in their order, and no cue begins before the end of the one before."""
    rows = q._long_cues(spark, SF)
    spans = {}
    for r in sorted(tuple(r) for r in q._spans(rows).collect()):
        spans.setdefault(r[:2], []).append(r[2:])
    want, said = [], {}
    for track, pos, start, end, text in sorted(tuple(r) for r in rows.collect()):
        said[track] = said.get(track, "") + re.sub(r"\s", "", text or "")
        for s, e, part in display.spread(Cue(pos, start, end, text or ""), spans.get((track, pos), [])):
            before = want[-1] if want and want[-1][0] == track else None
            s = max(s, before[3] + 1) if before else s
            e = max(s + 1, e)
            if before and e - s < 300:
                before[3:] = [e, f"{before[4]} {part}".strip()]
            else:
                want.append([track, before[1] + 1 if before else 1, s, e, part])
    got = sorted(tuple(r) for r in q.shown_cues(spark, SF).select("track", "pos", "start_ms", "end_ms", "text").collect())
    assert got == [tuple(w) for w in want]
    for track, own in groupby(got, key=lambda r: r[0]):
        own = list(own)
        assert all(a[3] < b[2] for a, b in zip(own, own[1:], strict=False)) and re.sub(r"\s", "", "".join(r[4] for r in own)) == said[track]


def test_pieces_of_few_texts_at_a_time():
    """The function stays in Arrow, whatever the number of texts; some are cut, some whole, none is lost at a slice's edge."""
    texts = [f"one two three, four five six {i}. seven eight nine" for i in range(2 * display.TEXTS + 1)]
    n = [1 + i % 4 for i in range(len(texts))]
    got = display.piece_lists.func(pa.array(texts), pa.array(n, pa.int64()))
    assert got.to_pylist() == [display.pieces(t, k) for t, k in zip(texts, n)]
    assert display.piece_lists.func(pa.array([], pa.string()), pa.array([], pa.int64())).to_pylist() == []
