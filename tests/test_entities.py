"""Terms, names and entities against plain walks over whole tables, and stated cases."""

import itertools
import re
import unicodedata

import pytest

from tidewater.operators import automaton, entities
from tidewater.plans import entity_queries as Q

SMALL = "/root/testdata/sf0.001"
ROW, TERM = "id long, text string", "term string, target string"


def rows_of(df, *columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def extract_en(text, terms):
    """Longest term first, spans exclusive, case aside, white space as it comes."""
    taken, out = [], {}
    for m in re.finditer(r"\b[A-Z][a-z]{2,}(?:[ -][A-Z][a-z]{2,})*\b", text):
        words = re.split("[ -]", m[0])
        before = text[max(0, m.start() - 48) : m.start()]
        if len(words) > 1 and len({w.lower() for w in words}) == 1 and re.search(r"(sponsored\s+by|sponsor|sponsored|thanks\s+to|check\s+out|visit|download|try|use|use\s+code|brought\s+to\s+you\s+by)[\s:,-]{0,12}$", before, re.I):
            taken += [x.span() for x in re.finditer(r"(?<![A-Za-z0-9])" + re.escape(m[0]).replace(r"\ ", r"\s+") + r"(?![A-Za-z0-9])", text, re.I)]
    for term in sorted(terms, key=len, reverse=True):
        for m in re.finditer(r"(?<![A-Za-z0-9])" + re.escape(term).replace(r"\ ", r"\s+") + r"(?![A-Za-z0-9])", text, re.I):
            if not any(m.start() < e and m.end() > s for s, e in taken):
                taken.append(m.span())
                out[term] = out.get(term, 0) + 1
    return out


def test_extract_against_regular_expressions(spark):
    terms = [r.term for r in Q._terms(spark, SMALL).collect()]
    cues = {(r.track, r.pos): r.text for r in Q.cues(spark, SMALL).where("track < 3").collect()}
    got = {}
    for r in Q.glossary_extract(spark, SMALL).where("track < 3").collect():
        got.setdefault((r.track, r.pos), {})[r.term] = r.times
    alike = [k for k, t in cues.items() if got.get(k, {}) == extract_en(t, terms)]
    # terms of one length that overlap may go either way
    assert len(alike) >= 0.9 * len(cues) and sum(map(len, got.values())) > 60
    for k in cues.keys() - set(alike):
        assert sum(len(t) * n for t, n in got[k].items()) > 0


EN = [("Tower of Adversity", "塔"), ("tower", "楼"), ("Buff", "增益"), ("DPS-up", "d"), ("of", None), ("  ", "x"), (None, "y"), ("Tower of Adversity", "塔"), ("ad", "a")]
TEXTS = [(1, "the TOWER  of\nadversity, tower-of ads; Buff"), (2, "Sponsored by Buff Buff and buff  buff, buff"), (3, None), (4, ""), (5, "dps-UP dpsup towers off"), (None, "tower"), (7, "x" * 50_000 + " tower " + "of " * 20_000)]


@pytest.mark.parametrize("most", [8 << 20, 200])
def test_extract_cases(spark, most):
    got = {(r.id, r.term): r.times for r in entities.extract(spark.createDataFrame(TEXTS, ROW), ["id"], spark.createDataFrame(EN, TERM), most_bytes=most).collect()}
    want = {(1, "Tower of Adversity"): 1, (1, "tower"): 1, (1, "of"): 1, (1, "Buff"): 1, (2, "Buff"): 1, (5, "DPS-up"): 1, (7, "tower"): 1, (7, "of"): 20_000}
    assert {k: v for k, v in got.items() if k[0] is not None} == want
    assert entities.extract(spark.createDataFrame(TEXTS, ROW).limit(0), ["id"], spark.createDataFrame(EN, TERM), most_bytes=most).count() == 0
    assert entities.extract(spark.createDataFrame(TEXTS, ROW), ["id"], spark.createDataFrame(EN, TERM).limit(0), most_bytes=most).count() == 0


@pytest.mark.parametrize("most", [8 << 20, 100])
def test_extract_in_other_scripts(spark, most):
    ja = [("明日香", "a"), ("明日", "b"), ("ﾊﾛｰ", "c"), ("香", "d")]
    rows = [(1, "昨日は明日香とハロー"), (2, "明日と香"), (3, "香香香"), (4, None)]
    got = rows_of(entities.extract(spark.createDataFrame(rows, ROW), ["id"], spark.createDataFrame(ja, TERM), "ja", most_bytes=most), "id", "term", "times")
    assert got == sorted([("1", "明日香", "1"), ("1", "ﾊﾛｰ", "1"), ("2", "明日", "1"), ("2", "香", "1"), ("3", "香", "3")])
    ko = [("스카", "a"), ("신", "b"), ("서울", "c")]
    rows = [(1, "스카는 왔다"), (2, "메카스카 당신이"), (3, "서울 신서울 서울서울"), (4, "ㄱ서울")]
    got = rows_of(entities.extract(spark.createDataFrame(rows, ROW), ["id"], spark.createDataFrame(ko, TERM), "ko", most_bytes=most), "id", "term", "times")
    assert got == sorted([("1", "스카", "1"), ("3", "서울", "2"), ("3", "신", "1"), ("4", "서울", "1")])


def test_both_ways_find_the_same(spark):
    rows, terms = Q._foreign(spark, SMALL, "ja")
    few, many = (automaton.occurrences(rows, Q.IDS, terms, "compatible", automaton.leftmost_longest, m).collect() for m in (8 << 20, 3000))
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) > 200
    known = {r.term for r in terms.collect()}
    texts = {(r.track, r.pos): unicodedata.normalize("NFKC", r.text) for r in rows.collect()}
    pattern = re.compile("|".join(sorted(map(re.escape, known), key=len, reverse=True)))
    assert sorted((r.track, r.pos, r.start, r.term) for r in few) == sorted((*k, m.start(), m[0]) for k, t in texts.items() for m in pattern.finditer(t))


def test_entity_candidates(spark):
    terms = [("Rover", "漂"), ("Tower of Adversity", "塔"), ("no", "x"), ("Empty", "")]
    rows = [(1, "Thanks to Buff Buff! We met Rulah near Tower of Adversity, and Rover."), (2, "see https://Rulah.example/Rover now"), (3, "Perhaps Rover-like Qing Xiao said HP Wow"), (4, None), (5, "rover ROVER"), (6, "Rulah Rulah, rulah")]
    got = rows_of(entities.candidates(spark.createDataFrame(rows, ROW), ["id"], spark.createDataFrame(terms, TERM), spark.createDataFrame([("perhaps",)], "word string")), "id", "start", "surface", "class")
    at = lambda i, s: str(dict(rows)[i].index(s))
    assert got == sorted([
        ("1", at(1, "Buff Buff"), "Buff Buff", "contextual_entity"), ("1", at(1, "Rulah"), "Rulah", "possible_entity"), ("1", at(1, "Tower"), "Tower of Adversity", "known_entity"), ("1", at(1, "Rover"), "Rover", "known_entity"), ("1", "0", "Thanks", "possible_entity"),
        ("3", at(3, "Rover"), "Rover", "known_entity"), ("3", at(3, "Qing"), "Qing Xiao", "possible_entity"), ("5", "0", "rover", "known_entity"), ("5", "6", "ROVER", "known_entity"), ("6", "0", "Rulah Rulah", "possible_entity"),
    ])


def test_entity_candidates_of_a_table(spark):
    """No candidate overlaps another; every known one is a term at a boundary; every title-case run is covered or excused."""
    texts = {(r.track, r.pos): entities.searchable(r.text) for r in Q.cased(spark, SMALL).collect()}
    terms = {r.term.lower() for r in Q.names(spark, SMALL).collect()}
    found = {}
    for r in Q.entity_candidates(spark, SMALL).collect():
        assert texts[r.track, r.pos][r.start : r.start + len(r.surface)] == r.surface
        found.setdefault((r.track, r.pos), []).append((r.start, r.start + len(r.surface), r.surface, r["class"]))
    kinds = [c[3] for own in found.values() for c in own]
    assert {"contextual_entity", "known_entity", "possible_entity"} == set(kinds)
    for k, own in found.items():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
        known = [(s, e) for s, e, _, c in own if c == "known_entity"]
        blocked = [(s, e) for s, e, _, c in own if c == "contextual_entity"]
        for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z]+(?![A-Za-z0-9])", texts[k]):
            if m[0].lower() in terms and not any(m.start() < e and m.end() > s for s, e in blocked):
                assert m.span() in known or any(m.start() < e and m.end() > s for s, e in known) or "contextual_entity" in [c[3] for c in own]


def test_names_put_right(spark):
    terms = spark.createDataFrame([("Jingran", "a"), ("Phrolova", "b"), ("Rover", "c"), ("Tower of Adversity", "d"), ("Qingxiao", "e"), ("Jiyan", "f")], TERM)
    aliases = spark.createDataFrame([("gin gran", "jingran"), ("gin", "nobody")], TERM)
    rows = [
        (1, "Then Gin Gran came"), (2, "the TOWER-of  adversity"), (3, "Roverss and ingran, full over"), (4, "I saw jin Gran and Froolova"), (5, "nothing here"), (6, None), (7, "Rover Rover's reRover XRover"), (8, "saw it. Qing Xiao came"), (9, "ROVER"),
    ]
    got = {r.id: (r.text, list(r.canonical), r.confidence, r.reasons) for r in entities.normalised(spark.createDataFrame(rows, ROW), ["id"], terms, aliases).collect()}
    assert got[1] == ("Then Jingran came", ["Jingran"], "high", "evidence-alias, exact")
    assert got[2] == ("the Tower of Adversity", ["Tower of Adversity"], "high", "punctuation-normalized")
    assert got[3] == ("Rover and Jingran, full over", ["Rover", "Jingran"], "high", "unique-affix-stripping")
    assert got[4][0].startswith("I saw Jingran and ") and got[4][2] == "high" and "unique-similarity-canonicalized" in got[4][3]
    assert got[5] == ("nothing here", [], "low", "unknown") and got[6][0] is None
    assert got[7][0] == "Rover Rover's Rover Rover" and got[8][0] == "saw it. Qingxiao came" and got[9] == ("Rover", ["Rover"], "high", "case-normalized")


def test_steps_of_names_put_right_run_once(spark):
    """What the searches found is kept: reading the result runs none of them, nor reads the texts, again."""
    rows, terms = spark.range(3).selectExpr("id", "'Then Gin Gran came' AS text"), spark.createDataFrame([("Jingran", "a")], TERM)
    out = entities.normalised(rows, ["id"], terms, spark.createDataFrame([("gin gran", "jingran")], TERM))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "Range" not in plan
    assert {(r.text, r.confidence) for r in out.collect()} == {("Then Jingran came", "high")}


def test_names_put_right_in_a_table(spark):
    """What is put is a name; texts without a change are as they were."""
    names = {r.term for r in Q.names(spark, SMALL).collect()}
    before = {(r.track, r.pos): r.text for r in Q.misspelt(spark, SMALL).collect()}
    rows = Q.names_put_right(spark, SMALL).collect()
    assert len(rows) == len(before) and sum(r.confidence == "high" for r in rows) > 10
    there = []
    for r in rows:
        own = set(filter(None, r.canonical.split("|")))
        assert own <= names and (own or r.text == before[r.track, r.pos])
        there.append(sum(n in r.text for n in own) / max(1, len(own)))  # a later step may take a name into another
    assert sum(there) > 0.8 * len(there)


def test_rows_are_made_in_bounded_frames(spark):
    """However many occurrences texts hold, a task makes few of them at a time."""
    assert len(next(automaton.frames_of(itertools.repeat((1, "a")), ["n", "term"]))) == automaton.MOST_ROWS
    assert list(automaton.frames_of([], ["n"])) == []
    n = 3 * entities.TEXTS + 1
    rows = spark.createDataFrame([(i, "Sponsored by Ash Ash " + "ash oak " * 300) for i in range(n)], "id long, text string").coalesce(1)
    terms = spark.createDataFrame([("ash", "a"), ("oak", "b")], "term string, target string")
    got = entities.extract(rows, ["id"], terms).groupBy("term", "times").count().collect()
    assert sorted(tuple(r) for r in got) == [("ash", 300, n), ("oak", 300, n)]
