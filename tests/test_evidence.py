"""Fixed cases of scanning, timing, union, glossary, cleaning and risk rules."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewater.functions import risk as R
from tidewater.functions import text as X
from tidewater.operators import glossary, intervals, union
from tidewater.sources import srt, vtt

ONE = "track string, content string"


def values(spark, column, *texts):
    """The values of a column expression over rows of columns a, b, ..."""
    names = "ab"[: len(texts[0]) if isinstance(texts[0], tuple) else 1]
    rows = [(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_srt_lines_of_white_space_do_not_end_a_block(spark):
    got = srt.parse(spark.createDataFrame([("a", "1\n00:00:01,000 --> 00:00:02,000\nHello\n \nthere\n\n\n2\n00:00:03,000 --> 00:00:04,000\n")], ONE)).orderBy("pos").collect()
    assert [(r.id, r.text) for r in got] == [(1, "Hello\nthere"), (2, "")]
    with pytest.raises(Exception, match="malformed block"):
        srt.parse(spark.createDataFrame([("a", "1\n100:00:01,000 --> 100:00:02,000\nx")], ONE)).collect()


def test_srt_bytes(spark):
    df = spark.createDataFrame([("a", 1, 1, 1000, 2000, "x\ny"), ("a", 2, 2, 2000, 3000, "z")], "track string, pos int, id int, start_ms long, end_ms long, text string")
    assert srt.render(df).first().content == "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nx\r\ny\r\n\n2\r\n00:00:02,000 --> 00:00:03,000\r\nz\r\n"


def test_empty_texts_are_no_duplicates(spark):
    kind = "track int, pos int, start_ms long, end_ms long, norm string"
    second = spark.createDataFrame([(1, 1, 0, 10, ""), (1, 2, 0, 10, "a"), (1, 3, 9000, 9010, "a")], kind)
    assert [r.pos for r in intervals.without_near_duplicates(second, spark.createDataFrame([(1, 1, 0, 10, ""), (1, 2, 5, 10, "a")], kind)).orderBy("pos").collect()] == [1, 3]


def test_runs_follow_the_cue_before(spark):
    """The second cue ends before the first; the third is near the first's end but far from the second's."""
    df = spark.createDataFrame([(1, 1, 0, 10_000), (1, 2, 1000, 2000), (1, 3, 9000, 9500), (1, 4, 9600, 9700)], "track int, pos int, start_ms long, end_ms long")
    assert [r.island for r in intervals.gap_runs(df, 2500).orderBy("pos").collect()] == [1, 1, 2, 2]
    best = intervals.dominant_run(df).first()
    assert (best.island, best.cues, best.span) == (2, 2, 700)


def test_vtt_scan(spark):
    doc = "﻿WEBVTT - a\r\n\r\nSTYLE\r\nx\r\n\r\nNOTE hm\r\n\r\n1\r\n00:01.000 --> 00:02.500 align:start\r\n<c.x>Hi</c> <00:01.200>you &amp; me<rt>ruby</rt>\r\nHi you &amp; me\r\n \r\n1:00:03.000 --> 1:00:04.000\r\n<b></b>\r\n\r\n1:00:05.000 --> 1:00:06.000\r\nx​ y"
    got = vtt.parse(spark.createDataFrame([("a", doc), ("b", "WEBVTT")], ONE)).orderBy("id").collect()
    assert [(r.track, r.id, r.start_ms, r.end_ms, r.text) for r in got] == [("a", 1, 1000, 2500, "Hi you & me"), ("a", 2, 3_605_000, 3_606_000, "x y")]


def test_union_prefers_and_takes_once(spark):
    kind = "track int, pos int, start_ms long, end_ms long, text string"
    first = spark.createDataFrame([(1, 1, 0, 1000, "hello there"), (1, 2, 1000, 2000, "你好"), (1, 3, 5000, 6000, "bye")], kind)
    second = spark.createDataFrame([(1, 7, 0, 2000, "Hello there"), (1, 8, 7000, 7500, "Bye!"), (1, 9, 20_000, 21_000, "bye"), (1, 10, 30_000, 31_000, "")], kind)
    got = {(r.side, r.pos): (r.secondary_evidence, r.flags) for r in union.build(first, second).collect()}
    assert got == {("primary", 1): ("Hello there", []), ("primary", 2): ("", ["whisper_missing"]), ("primary", 3): ("", ["whisper_missing"]), ("secondary", 9): ("bye", ["capcut_missing"]), ("secondary", 10): ("", ["capcut_missing"])}
    assert values(spark, union.preferred(F.col("a"), F.col("b")), ("你好 there", "hello"), ("hello", "x"), ("你好 abc", "1"), ("12", "3"), ("", "ab ")) == ["hello", "hello", "你好 abc", "", "ab"]
    assert values(spark, union.preferred(F.col("a"), F.col("b"), "ja"), (" ", "は"), ("あ", "い")) == ["は", "あ"]


def test_conflict_is_the_block_ratio(spark):
    pairs = [("the cat sat on the mat", "the cat sat on a mat"), ("the cat sat", "a dog ran off"), ("one two three", "one two three four"), ("one", "one two three four"), ("", "x"), ("Don’t go", "don't GO!")]
    want = []
    for a, b in pairs:
        x, y = (" ".join(w for w in "".join(c if c.isalnum() or c == "'" else " " for c in t.lower().replace("’", "'")).split()) for t in (a, b))
        short, long = sorted((len(x), len(y)))
        near = not x or not y or x == y or ((x in y or y in x) and short / max(long, 1) >= 0.72)
        want.append(not near and SequenceMatcher(None, x, y).ratio() < 0.78)
    assert values(spark, union.conflict(F.col("a"), F.col("b")), *pairs) == want and True in want and False in want


def test_nested_cues_join_the_first_that_spans_them(spark):
    rows = [(1, 1, "primary", 0, 9000, "short", "", 1.0, []), (1, 2, "secondary", 1000, 3000, "", "a longer wording", 1.0, []), (1, 3, "secondary", 2000, 2500, "", "short", 1.0, []), (1, 4, "primary", 8000, 9500, "own", "", 1.0, [])]
    df = spark.createDataFrame(rows, "track int, pos int, side string, start_ms long, end_ms long, primary_evidence string, secondary_evidence string, secondary_coverage double, flags array<string>")
    # the child's own secondary text equals what became primary, so only the demoted text is added
    assert sorted((r.pos, r.primary_evidence, r.secondary_evidence) for r in union.merged(df).collect()) == [(1, "a longer wording", "short"), (4, "own", "")]


def test_glossary_boundaries(spark):
    rows = spark.createDataFrame([(1, "The Tower  of\nAdversity, tower of adversity"), (2, "towers of adversity"), (3, "tower, of adversity"), (4, "A-1 unit a 1 unit"), (5, None)], "id int, text string")
    terms = spark.createDataFrame([("Tower of Adversity", "塔"), ("tower", "楼"), ("a-1", "甲"), ("!!", "x")], "term string, target string")
    got = sorted((r.id, r.term, r.times) for r in glossary.hits(rows, ["id"], terms).collect())
    assert got == [(1, "Tower of Adversity", 2), (1, "tower", 2), (3, "tower", 1), (4, "a-1", 1)]
    assert glossary.hits(rows, ["id"], terms.limit(0)).count() == 0
    assert [r.target for r in glossary.lookup(terms, spark.createDataFrame([("TOWER",), ("no",)], "term string")).orderBy("term").collect()] == ["楼", None]


def test_cleaners(spark):
    assert values(spark, X.strip_sounds(F.col("a")), "[Music] hello , you", "♪ la ♪", "Music playing!", "(applause)\n...", "so (laughter) it goes", "the music") == ["hello, you", "la", "", "", "so (laughter) it goes", "the music"]
    assert values(spark, X.without_censored(F.col("a")), "what [ __ ]  is", "[___]", "[__\\h]x") == ["what is", "", "x"]
    assert values(spark, X.without_other_scripts(F.col("a")), "Hello世界", "こんにちは World", "안녕하세요") == ["Hello", "World", ""]
    assert values(spark, X.without_kana(F.col("a")), "Hello", "わーい", "a\nわーい\nHi です\n") == ["Hello", "", "a\nHi\n"]
    assert values(spark, X.japanese_source(F.col("a")), "[音楽]\n 行く  よ \n（笑）") == ["行く よ"]


def test_markers_by_language(spark):
    pair = lambda lang: F.array(*R.missing_markers(F.col("a"), F.col("b"), lang))
    assert values(spark, pair("en"), ("never go if", "走"), ("no wonder as if", "走"), ("I will not", "我不"), ("whether or", "去不去")) == [[True, True], [False, False], [False, False], [False, False]]
    assert values(spark, pair("ja"), ("行かない", "去"), ("もし", "如果"), ("行く", "去")) == [[True, False], [False, False], [False, False]]
    assert values(spark, pair("ko"), ("안 가", "去"), ("가면", "去"), ("없어", "没有")) == [[True, False], [False, True], [False, False]]
    assert values(spark, R.is_incomplete(F.col("a"), F.col("b"), "ja"), ("私の", "我的"), ("行く", "我的")) == [True, False]


def test_words_end_at_other_letters(spark):
    """As in SQL, a word's edge lies between a Latin letter and any other one."""
    pair = F.array(*R.missing_markers(F.col("a"), F.col("b")))
    assert values(spark, pair, ("ga noítag", "x"), ("la ñif", "x"), ("noitag ñ_no", "x"), ("no wonderñ", "x")) == [[True, False], [False, True], [False, False], [False, False]]
    assert values(spark, R.has_credit_line(F.col("a")), "ésubs byñ", "esubs by") == [True, False]
    assert values(spark, R.is_incomplete(F.col("a"), F.col("b")), ("éto", "因为"), ("veto", "因为")) == [True, False]


def test_score_of_a_negation_before_another_letter(spark):
    no = {"conflict": F.lit(False), "terms_missed": F.lit(False), "has_terms": F.lit(False), "names_person": F.lit(False)}
    r = R.reasons(F.col("a"), F.col("b"), F.lit(1000), F.lit(0.0), **no)
    assert values(spark, F.struct(F.array_join(r, ","), R.score(r)), ("ga noítag", "x"), ("ga nota", "x")) == [("negation_missing", 6), ("", 0)]


def test_odd_characters_are_as_in_sql(spark):
    """Line ends, spaces of other scripts, the vertical tab, a dotted capital and long s."""
    assert values(spark, R.is_incomplete(F.col("a"), F.col("b")), ("it is the\u2028", "因为"), ("it is the\x85", "因为"), ("it is the\u3000", "因为"), ("it is the", "因为\u3000")) == [False, False, True, True]
    assert values(spark, R.has_credit_line(F.col("a")), "captions\x0bby", "caption\u017f by", "captions by") == [False, True, True]
    assert values(spark, R.has_noise_command(F.col("a")), "[noi\u017fe]") == [True]
    assert values(spark, R.missing_markers(F.col("a"), F.lit("x"))[1], "not \u0130if it", "not if it") == [False, True]
    assert values(spark, X.visible_length(F.col("a")), "a\x0bb \t") == [3]
    assert values(spark, F.array_join(glossary.term_tokens(F.col("a")), " "), "\u0130he was\x0bhere") == ["ihe was | here"]


def test_risk_rules(spark):
    assert values(spark, R.has_english_residue(F.col("a")), "这是 Violet 的", "BOSS 来了", "plain words", "say the word", "说abc的") == [True, False, False, True, False]
    assert values(spark, R.has_noise_command(F.col("a")), "[inaudible 00:12]", "(Laughter)", "ignore the noise", "noise") == [True, True, True, False]
    assert values(spark, R.suspects_forgotten_name(F.col("a")), ">> Zhezhi something. I forgot", "I forgot", ">> what I don't remember") == [True, False, False]
    whitelist = (["bandai namco"], ["yeah", "okay"])
    assert values(spark, R.is_whitelisted(F.col("a"), *whitelist), "Yeah, okay", "From Bandai Namco Games", "Namco", "", "!!") == [True, True, False, False, False]
    df = spark.createDataFrame([(["text_conflict", "unknown_entity: a ,b", "unknown_entity:", " x : "],)], "r array<string>").select(R.reason_kinds(F.col("r")).alias("k"), R.reason_surfaces(F.col("r"), "unknown_entity").alias("s")).first()
    assert (df.k, df.s) == (["text_conflict", "unknown_entity", "x"], ["a", "b"])


def test_numbered_characters(spark):
    rows = [("a &#233;&#xE9;&#X1F600; &#0; &#xD800; &#9999999; &#; &amp;#65;",), (None,), ("&#39;x&#39;",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(vtt.payload_line(F.col("t"))).collect()]
    assert got == ["a éé😀 \ufffd \ufffd \ufffd &#; &#65;", None, "'x'"]


def test_srt_blocks_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", p, p, p * 1000, p * 1000 + 500, f"x{p}\ny") for p in range(1, 60)] + [("b", 1, 1, 0, 10, "z")], "track string, pos long, id int, start_ms long, end_ms long, text string")
    back = srt.parse_blocks(srt.blocks(rows)).orderBy("track", "pos").collect()
    assert [(r.track, r.id, r.start_ms, r.end_ms, r.text) for r in back] == [(r.track, r.id, r.start_ms, r.end_ms, r.text) for r in rows.orderBy("track", "pos").collect()]
    srt.write(rows, str(tmp_path / "out"))
    for track, n in (("a", 59), ("b", 1)):
        files = sorted((tmp_path / "out" / f"track={track}").glob("*.txt"))
        whole = b"".join(f.read_bytes() for f in files).decode()
        again = srt.parse(spark.createDataFrame([(track, whole)], "track string, content string")).orderBy("pos").collect()
        assert [r.id for r in again] == list(range(1, n + 1)) and again[0].text == ("x1\ny" if track == "a" else "z")
