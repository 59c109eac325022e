"""Queries over source and translation: risk rules, union of transcripts, glossary terms, cleaning and WebVTT, on cues of `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions import text as X
from ..operators import glossary, union
from ..sources import vtt
from .cue_queries import _NORM, _VISIBLE, CUES, cues, second_track

#: Source and translation of a cue, in words that both engines read: defects of every kind at fixed positions.
SAID = """CASE WHEN pos % 13 = 1 THEN concat('>> ', text) WHEN pos % 13 = 2 THEN concat(text, ' [inaudible 00:12]') WHEN pos % 13 = 3 THEN concat('Subtitles by ', text) WHEN pos % 13 = 4 THEN concat('No wonder if ', text)
    WHEN pos % 13 = 5 THEN concat('never ', text, ' because') WHEN pos % 13 = 6 THEN concat(substr(text, 1, 40), ' ', substr(text, 1, 40)) WHEN pos % 13 = 7 THEN concat('>> Zebra something I forgot 1,200 ', text) ELSE text END"""
PUT = """CASE WHEN pos % 11 = 0 THEN '' WHEN pos % 11 = 1 THEN concat('他们说 ', substr(text, 1, 24)) WHEN pos % 11 = 2 THEN '没有人会去因为' WHEN pos % 11 = 3 THEN '如果是这个' WHEN pos % 11 = 4 THEN 'HP 和 NPC 1300'
    WHEN pos % 11 = 5 THEN concat('the ', text) WHEN pos % 11 = 6 THEN '你去不去看' ELSE concat('不', text) END"""


def _bilingual(spark, sf_dir):
    c = cues(spark, sf_dir)
    return c.select("track", "pos", F.expr(SAID).alias("source"), F.expr(PUT).alias("target"), (F.col("end_ms") - F.col("start_ms")).alias("dur"))


def _terms(spark, sf_dir):
    """Glossary: words of the benchmark, its neighbouring pairs and its texts' first three words."""
    w = X.words(F.col("text"))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(w.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 2), " "))
    return b.select(F.explode(F.concat("w", pairs, F.array(F.array_join(F.slice("w", 1, 3), " ")))).alias("term")).distinct().withColumn("target", F.concat(F.lit("译"), F.substring("term", 1, 2)))


def risk_rules(spark, sf_dir):
    s, t, d = F.col("source"), F.col("target"), F.col("dur")
    negation, condition = R.missing_markers(s, t)
    return _bilingual(spark, sf_dir).select(
        "track", "pos", R.has_english_residue(t).alias("english_residue"), R.has_credit_line(s).alias("credit"), R.has_noise_command(s).alias("noise"), X.has_repeated_clause(s).alias("repeated"),
        F.array_join(R.number_set(s), "|").alias("numbers"), negation.alias("negation"), condition.alias("condition"), R.is_incomplete(s, t).alias("incomplete"), R.suspects_forgotten_name(s).alias("forgotten"),
        R.reads_too_fast(t, d).alias("fast"), R.surface(s).alias("surface"),
    )


def risk_score(spark, sf_dir):
    rows = _bilingual(spark, sf_dir)
    floors = rows.select("track", X.characters_per_minute(F.col("source"), F.col("dur")).alias("cpm")).where("cpm > 0").groupBy("track").agg((F.median("cpm") * 0.25).alias("floor"))
    # hits are few beside n-grams: translations meet them, not every n-gram
    found = glossary.hits(rows.select("track", "pos", F.col("source").alias("text")), ["track", "pos"], _terms(spark, sf_dir)).select("track", "pos", F.col("target").alias("means"))
    missed = found.join(rows.select("track", "pos", "target"), ["track", "pos"]).groupBy("track", "pos").agg(F.max((~F.col("target").contains(F.col("means"))).cast("int")).alias("missed"))
    joined = rows.where(F.col("source").rlike(r"[\p{L}\p{N}]")).join(floors, "track", "left").join(missed, ["track", "pos"], "left")
    reasons = R.reasons(F.col("source"), F.col("target"), F.col("dur"), F.coalesce("floor", F.lit(0.0)), conflict=F.lit(False), terms_missed=F.coalesce(F.col("missed") == 1, F.lit(False)), has_terms=F.col("missed").isNotNull(), names_person=F.lit(False))
    scored = joined.select("track", "pos", reasons.alias("r")).where(F.size("r") > 0)
    return scored.select("track", "pos", F.array_join("r", ",").alias("reasons"), R.score(F.col("r")).alias("score"), R.review_required(F.col("r")).alias("review_required"), R.severity(F.col("r")).alias("severity"))


ENTITIES, WORDS = ["bandai namco", "krita"], ["yeah", "okay", "name"]
#: Reasons, language, primary evidence, decision and confidence of a risk at fixed positions of the event table.
RISKS = """SELECT event_id AS key, event_id % 5 <> 4 AS required, CASE WHEN event_id % 3 = 0 THEN 'en' ELSE 'ko' END AS lang, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS prim,
    CASE WHEN event_id % 7 = 0 THEN ' Keep' WHEN event_id % 7 = 1 THEN 'replace' END AS decision, CASE WHEN event_id % 2 = 0 THEN 0.95 ELSE 0.5 END AS confidence,
    CASE WHEN event_id % 8 = 0 THEN 'reading_speed|credit_line' WHEN event_id % 8 = 1 THEN 'text_conflict|source_unresolved' WHEN event_id % 8 = 2 THEN 'unknown_entity:From Bandai Namco Games' WHEN event_id % 8 = 3 THEN 'unknown_entity: Yeah okay ,Krita'
         WHEN event_id % 8 = 4 THEN 'unknown_entity:Wangchuan,yeah' WHEN event_id % 8 = 5 THEN 'person_name_present|text_conflict' WHEN event_id % 8 = 6 THEN 'negation_missing|unknown_entity' ELSE '' END AS reasons FROM events"""


def risk_triage(spark, sf_dir):
    spark_sql = RISKS.removesuffix(" FROM events")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_columns(spark_sql))
    found = F.filter(F.split("reasons", r"\|"), lambda x: x != "")
    out = {scope: R.triage(found, F.col("required"), F.col("lang"), F.col("prim"), F.col("decision"), F.col("confidence").cast("double"), ENTITIES, WORDS, scope, 0.9) for scope in ("off", "names", "all")}
    return e.select("key", F.array_join(R.reason_kinds(found), ",").alias("kinds"), *[c.alias(f"scope_{k}") for k, c in out.items()])


def _columns(select: str) -> list[str]:
    """Expressions of a select list without parentheses that hold commas outside of them."""
    out, depth, text = [], 0, ""
    for ch in select.removeprefix("SELECT "):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth and text.count("'") % 2 == 0:
            out.append(text)
            text = ""
        else:
            text += ch
    return [*out, text]


def source_union(spark, sf_dir):
    """Both transcripts, the second at other times and here and there far off, as one; whether texts conflict is in text_conflicts."""
    rows = cues(spark, sf_dir).where("end_ms > start_ms")
    second = second_track(rows).withColumns({c: F.col(c) + F.when(F.col("pos") % 4 == 0, 90_000).otherwise(0) for c in ("start_ms", "end_ms")})
    both = union.build(rows.select("track", "pos", "start_ms", "end_ms", "text"), second.select("track", "pos", "start_ms", "end_ms", "text"))
    flags = F.array_join(F.array_remove("flags", "text_conflict"), ",")
    return both.select("track", "pos", "side", "start_ms", "end_ms", union.preferred(F.col("primary_evidence"), F.col("secondary_evidence")).alias("text"), F.length("secondary_evidence").alias("heard"), flags.alias("flags"))


def source_union_nested(spark, sf_dir):
    """The union's cues that another spans, and the evidence of those that stay."""
    rows = cues(spark, sf_dir).where("end_ms > start_ms").select("track", "pos", F.lit("primary").alias("side"), "start_ms", (F.col("end_ms") + F.when(F.col("pos") % 5 == 0, 9000).otherwise(0)).alias("end_ms"),
        F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("text")).alias("primary_evidence"), F.when(F.col("pos") % 4 == 0, F.col("text")).otherwise("").alias("secondary_evidence"), F.lit(1.0).alias("secondary_coverage"), F.array().cast("array<string>").alias("flags"))
    return union.merged(rows).select("track", "pos", "primary_evidence", "secondary_evidence")


def text_conflicts(spark, sf_dir):
    """Each cue's text against the next cue's, as two wordings of one source."""
    from pyspark.sql import Window

    after = F.lead("text", 1, "").over(Window.partitionBy("track").orderBy("pos"))
    rows = cues(spark, sf_dir).select("track", "pos", "text", F.when(F.col("pos") % 2 == 0, after).otherwise(F.concat(F.col("text"), F.lit(" "), F.substring("text", 1, 9))).alias("other"))
    return rows.select("track", "pos", union.conflict(F.col("text"), F.col("other")).alias("conflict"))


def glossary_hits(spark, sf_dir):
    return glossary.hits(cues(spark, sf_dir).select("track", "pos", "text"), ["track", "pos"], _terms(spark, sf_dir)).select("track", "pos", "term", "times")


def term_usage(spark, sf_dir):
    """Terms of every length, single words and phrases, their occurrences and the cues they are in."""
    return glossary.usage(glossary.hits(cues(spark, sf_dir).select("track", "pos", "text"), ["track", "pos"], _terms(spark, sf_dir)))


def glossary_kept(spark, sf_dir):
    rows = cues(spark, sf_dir)
    found = glossary.hits(rows.select("track", "pos", "text"), ["track", "pos"], _terms(spark, sf_dir))
    return glossary.target_kept(found, rows.select("track", "pos", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("译"), F.substring("text", 1, 2))).otherwise("").alias("translated")), ["track", "pos"])


#: Marks for the cleaners around a cue's text.
MARKED = """CASE WHEN pos % 9 = 0 THEN concat('[Music] ', text, chr(10), ' [ __ ]  ') WHEN pos % 9 = 1 THEN concat('(applause)', chr(10), text, ' .') WHEN pos % 9 = 2 THEN concat('♪ ', text, ' ♪') WHEN pos % 9 = 3 THEN ' music playing! '
    WHEN pos % 9 = 4 THEN concat('わーい', chr(10), text, ' こんにちは') WHEN pos % 9 = 5 THEN concat('Привет ', text, ' 안녕') WHEN pos % 9 = 6 THEN concat('[音楽]', chr(10), '  ', text, '   x') WHEN pos % 9 = 7 THEN concat('so [ ___ ] ', text) ELSE concat(' ', text, ' ') END"""


def caption_cleaning(spark, sf_dir):
    t = F.col("marked")
    return cues(spark, sf_dir).select("track", "pos", F.expr(MARKED.replace("chr(10)", "char(10)")).alias("marked")).select(
        "track", "pos", X.strip_sounds(t).alias("spoken"), X.without_censored(t).alias("uncensored"), X.has_other_script(t).alias("other_script"), X.without_other_scripts(t).alias("latin"), X.without_kana(t).alias("no_kana"),
        X.japanese_source(t).alias("ja_source"), X.exact_marker(t).alias("marker"),
    )


def vtt_lines(spark, sf_dir):
    """Payload cleaning over lines of markup: all lines of the pages."""
    lines = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(F.split(F.coalesce("html", F.lit("")), "\n")).alias("n", "line"))
    return lines.select("page_id", "n", vtt.payload_line(F.col("line")).alias("text"))


def vtt_scan(spark, sf_dir):
    """Each conversation as a WebVTT file, cue by cue under its own track, with notes, settings, tags and repeated lines."""
    stamp = lambda c: F.format_string("%02d:%02d.%03d", F.floor(c / 60000), F.floor(c / 1000) % 60, c % 1000)
    c = cues(spark, sf_dir).where("start_ms < 5900000 and end_ms < 5900000")
    body = F.concat_ws("\r\n", F.lit("﻿WEBVTT"), F.lit(""), F.lit("NOTE a note"), F.lit(""), F.lit("STYLE"), F.lit("::cue {}"), F.lit(""), F.lit("id"), F.concat_ws(" --> ", stamp(F.col("start_ms")), F.concat(stamp(F.col("end_ms")), F.lit(" align:start"))),
        F.concat(F.lit("<v Bob>"), "text", F.lit("</v> &amp;&nbsp;<00:01.000>co")), F.concat("text", F.lit(" & co")), F.lit("<c> </c>"), F.lit("end"), F.lit("end"), F.lit(""), F.lit("no timing"))
    return vtt.parse(c.select(F.struct("track", "pos").alias("track"), body.alias("content"))).select("track.track", "track.pos", "id", "start_ms", "end_ms", "text")


QUERIES = {f.__name__: f for f in (risk_rules, risk_score, risk_triage, source_union, source_union_nested, text_conflicts, glossary_hits, term_usage, glossary_kept, caption_cleaning, vtt_lines, vtt_scan)}


def _java(pattern: str) -> str:
    """A fixed pattern as RE2 reads it, inside a SQL string."""
    return pattern.replace("'", "''")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_BI = f"{CUES}, b AS (SELECT track, pos, {SAID} AS source, {PUT} AS target, end_ms - start_ms AS dur FROM cues)"
_RUNS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')"
_RESIDUE = f"""(len(list_filter({_RUNS.format('target')}, lambda w: regexp_matches(w, '^[A-Za-z]{{2,}}$') AND NOT list_contains({_list(R.LATIN_TOKENS)}, upper(w)) AND list_contains({_list(R.RESIDUE_WORDS)}, w))) > 0
    OR (len(list_filter({_RUNS.format('target')}, lambda w: regexp_matches(w, '^[A-Za-z]{{2,}}$') AND NOT list_contains({_list(R.LATIN_TOKENS)}, upper(w)))) > 0 AND regexp_matches(target, '{R.HAN_BASIC}')))"""
_NUMBERS = r"list_sort(list_distinct(list_transform(regexp_extract_all({0}, '\d+(?:[.,]\d+)?'), lambda v: regexp_replace(v, '[.,]', '', 'g'))))"
_ANY = lambda words: "(" + " OR ".join(f"contains(target, '{w}')" for w in words.split()) + ")"
_NEG, _COND, _NO, _IF = R.MARKERS["en"]
_NEGATION = f"(regexp_matches(regexp_replace(lower(source), '{R.NOT_NEGATION}', '', 'g'), '{_NEG}') AND NOT {_ANY(_NO)})"
_EITHER = "len(list_filter(range(1, length(target) - 1), lambda i: substr(target, i, 1) = substr(target, i + 2, 1) AND substr(target, i + 1, 1) = '不' AND regexp_matches(substr(target, i, 1), '" + R.HAN_BASIC + "'))) > 0"
_CONDITION = f"(regexp_matches(regexp_replace(lower(source), '{R.NOT_CONDITION}', '', 'g'), '{_COND}') AND NOT {_ANY(_IF)} AND NOT {_EITHER})"
_STRIPPED = r"trim(regexp_replace(source, '>>+|\[[^\]]+\]', ' ', 'g'))"
_INCOMPLETE = f"(regexp_matches({_STRIPPED}, '{X.FRAGMENT_END}') AND regexp_matches(regexp_replace(trim(target), '[，,、；;：:]+$', ''), '{R.TARGET_FRAGMENT}'))"
_FORGOTTEN = f"(contains(source, '>>') AND regexp_matches(lower(source), '{_java(R.FORGOT)}') AND regexp_matches(trim(substr(source, instr(source, '>>') + 2)), '{R.FORGOTTEN_NAME}'))"
_SEEN = r"length(regexp_replace({0}, '\s+', '', 'g'))"
_FAST = f"(dur > 0 AND {_SEEN.format('target')} >= 18 AND {_SEEN.format('target')} / (dur / 1000) > 14)"
_W = r"list_filter(string_split(trim(regexp_replace(lower(source), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_REPEATED = """(length(array_to_string(w, '')) % 2 = 0 AND length(array_to_string(w, '')) >= 24 AND substr(array_to_string(w, ''), 1, length(array_to_string(w, '')) // 2) = substr(array_to_string(w, ''), length(array_to_string(w, '')) // 2 + 1)
    AND (len(w) < 2 OR (len(w) % 2 = 0 AND len(w) >= 6 AND w[1 : len(w) // 2] = w[len(w) // 2 + 1 :] AND len(list_distinct(w[1 : len(w) // 2])) >= 3)))"""
_SURFACE = r"trim(regexp_replace(lower({0}), '[^0-9a-z\x{{4E00}}-\x{{9FFF}}]+', ' ', 'g'))"
_TERMS = """terms AS (SELECT DISTINCT unnest(list_concat(w, list_transform(range(1, greatest(len(w), 2)), lambda i: array_to_string(w[i : i + 1], ' ')), [array_to_string(w[1 : 3], ' ')])) AS term
    FROM (SELECT regexp_extract_all(replace(lower(text), '’', ''''), '[a-z0-9'']+') AS w FROM benchmark)),
    t AS (SELECT term, '译' || substr(term, 1, 2) AS target, regexp_replace(regexp_replace(array_to_string(TOKENS(term), ' '), '^(?:\\| )+', ''), '(?: \\|)+$', '') AS gram FROM terms),
    k AS (SELECT term, target, gram, len(string_split(gram, ' ')) AS n FROM t WHERE regexp_matches(gram, '[a-z0-9]'))"""
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\s]+', ' | ', 'g'), '\s+'), lambda w: w <> '')"
_TERMS = _TERMS.replace("TOKENS(term)", _TOKENS.format("term"))


def _hits(source: str, text: str) -> str:
    """Terms of each row by comparing every term with the row's tokens at every place."""
    return f"""{_TERMS}, w AS (SELECT track, pos, {_TOKENS.format(text)} AS w FROM {source}),
        g AS (SELECT track, pos, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS gram FROM w, (SELECT DISTINCT n FROM k)),
        h AS (SELECT track, pos, term, target, count(*) AS times FROM g JOIN k USING (n, gram) GROUP BY ALL)"""


_FIRED = {
    "empty_translation": "trim(target) = ''", "credit_line": f"regexp_matches(source, '{_java(R.CREDITS)}')", "noise_command": f"regexp_matches(source, '{_java(R.NOISE)}')", "repeated_clause": _REPEATED,
    "number_mismatch": f"len({_NUMBERS.format('source')}) > 0 AND len({_NUMBERS.format('target')}) > 0 AND {_NUMBERS.format('source')} <> {_NUMBERS.format('target')}", "english_residue": _RESIDUE, "term_mismatch": "missed = 1",
    "suspected_name": f"missed IS NULL AND {_FORGOTTEN}", "reading_speed": _FAST, "low_info_density": f"dur >= 6000 AND {_SEEN.format('source')} BETWEEN 1 AND 3 AND cpm < coalesce(floor, 0)", "negation_missing": _NEGATION,
    "condition_marker_missing": _CONDITION, "incomplete_fragment": _INCOMPLETE,
}
_CPM = f"CASE WHEN dur > 0 THEN {_SEEN.format('source')} / (dur / 60000.0::DOUBLE) ELSE 0 END"
_REQUIRED = f"list_has_any(r, {_list(R.AUTOMATIC + R.MANUAL)})"
_POINTS = "list_sum(list_transform(r, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.SCORES.items()) + " END))::INTEGER"
_LINES = "string_split(regexp_replace({0}, '\\r\\n|\\r', chr(10), 'g'), chr(10))"
_SQUEEZE = r"regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_RESTED = rf"regexp_replace(regexp_replace(marked, '(?i)[\[\(\{{（【]\s*{X.SOUND}\s*[\]\)\}}）】]', ' ', 'g'), '{X.MUSIC_SIGNS}', ' ', 'g')"
_PAYLOAD = f"regexp_replace(regexp_replace(regexp_replace(LINE, '{vtt.INLINE_TIME}', '', 'g'), '{vtt.RUBY_TEXT}', '', 'g'), '{vtt.TAG}', '', 'g')"
for _name, _sign in vtt.ENTITIES.items():
    _PAYLOAD = f"replace({_PAYLOAD}, '{_name}', '{_java(_sign)}')"
_PAYLOAD = f"regexp_replace(replace(replace({_PAYLOAD}, chr(160), ' '), chr(8203), ''), '^\\s+|\\s+$', '', 'g')"
_KINDS = "list_sort(list_distinct(list_filter(list_transform(f, lambda x: trim(string_split(x, ':')[1])), lambda x: x <> '')))"
_WHITE = f"""(lambda_norm <> '' AND (list_contains({_list(WORDS + ENTITIES)}, lambda_norm) OR len(list_filter(string_split(lambda_norm, ' '), lambda w: NOT list_contains({_list(WORDS)}, w))) = 0 OR contains(' ' || lambda_norm || ' ', ' bandai namco ')))"""


def _triage(scope: str) -> str:
    kept = "lower(trim(coalesce(decision, ''))) = 'keep' AND confidence >= 0.9"
    left = lambda names: f"len(list_filter(x, lambda v: NOT list_contains({_list(names)}, v))) = 0"
    trusted = {"off": "", "all": f"WHEN {kept} THEN 'trusted_keep'", "names": f"WHEN {kept} AND {left(R.TRUSTED_NAMES + R.CONFLICT)} THEN 'trusted_keep_name'"}[scope]
    return f"""CASE WHEN NOT required OR len(kinds) = 0 THEN NULL WHEN len(x) = 0 THEN 'advisory_only' {trusted}
        WHEN {left(R.CONFLICT)} THEN CASE WHEN lang = 'en' AND trim(prim) <> '' THEN 'source_conflict_en' END
        WHEN {left(['unknown_entity'])} AND len(s) > 0 AND len(list_filter(s, lambda v: NOT {_WHITE.replace('lambda_norm', _SURFACE.format('v'))})) = 0 THEN 'whitelisted_entity' END AS scope_{scope}"""


SQL = {
    "risk_rules": f"""{_BI}, q AS (SELECT *, {_W} AS w FROM b)
        SELECT track, pos, {_RESIDUE} AS english_residue, {_FIRED['credit_line']} AS credit, {_FIRED['noise_command']} AS noise, {_REPEATED} AS repeated, array_to_string({_NUMBERS.format('source')}, '|') AS numbers,
               {_NEGATION} AS negation, {_CONDITION} AS condition, {_INCOMPLETE} AS incomplete, {_FORGOTTEN} AS forgotten, {_FAST} AS fast, {_SURFACE.format('source')} AS surface FROM q""",
    "risk_score": f"""{_BI}, {_hits('b', 'source')},
        m AS (SELECT track, pos, max(CASE WHEN contains(b.target, h.target) THEN 0 ELSE 1 END) AS missed FROM h JOIN b USING (track, pos) GROUP BY ALL),
        c AS (SELECT *, {_CPM} AS cpm FROM b), f AS (SELECT track, median(cpm) * 0.25 AS floor FROM c WHERE cpm > 0 GROUP BY 1),
        q AS (SELECT c.*, floor, missed, {_W} AS w FROM c LEFT JOIN f USING (track) LEFT JOIN m USING (track, pos) WHERE regexp_matches(source, '[\\p{{L}}\\p{{N}}]')),
        x AS (SELECT track, pos, list_filter([{', '.join(f"CASE WHEN {_FIRED[k]} THEN '{k}' END" for k in sorted(_FIRED))}], lambda v: v IS NOT NULL) AS r FROM q)
        SELECT track, pos, array_to_string(r, ',') AS reasons, {_POINTS} AS score, {_REQUIRED} AS review_required, CASE WHEN NOT {_REQUIRED} THEN 'advisory' WHEN {_POINTS} >= 6 THEN 'high' ELSE 'medium' END AS severity FROM x WHERE len(r) > 0""",
    "risk_triage": f"""WITH e AS ({RISKS}), k AS (SELECT *, list_filter(string_split(reasons, '|'), lambda v: v <> '') AS f FROM e),
        l AS (SELECT *, {_KINDS} AS kinds, list_filter(list_transform(string_split(coalesce(regexp_extract(list_filter(f, lambda v: starts_with(v, 'unknown_entity:'))[-1], '^[^:]*:(.*)$', 1), ''), ','), lambda v: trim(v)), lambda v: v <> '') AS s FROM k),
        x AS (SELECT *, list_filter(kinds, lambda v: NOT list_contains({_list(R.ADVISORY)}, v)) AS x FROM l)
        SELECT key, array_to_string(kinds, ',') AS kinds, {_triage('off')}, {_triage('names')}, {_triage('all')} FROM x""",
    "source_union": f"""{CUES}, p AS (SELECT track, pos, start_ms, end_ms, text FROM cues WHERE end_ms > start_ms),
        s AS (SELECT o.track, o.pos, o.text, o.start_ms + CASE WHEN o.pos % 4 = 0 THEN 90000 ELSE 0 END AS start_ms, o.end_ms + CASE WHEN o.pos % 4 = 0 THEN 90000 ELSE 0 END AS end_ms FROM other o JOIN p USING (track, pos)),
        m AS (SELECT p.track, p.pos, s.pos AS other, s.text AS heard, (least(p.end_ms, s.end_ms) - greatest(p.start_ms, s.start_ms)) / (p.end_ms - p.start_ms)::DOUBLE AS ratio,
                     row_number() OVER (PARTITION BY p.track, p.pos ORDER BY (least(p.end_ms, s.end_ms) - greatest(p.start_ms, s.start_ms)) DESC, s.start_ms, s.end_ms, s.pos) AS n
              FROM p JOIN s ON p.track = s.track AND p.start_ms < s.end_ms AND s.start_ms < p.end_ms),
        t AS (SELECT *, row_number() OVER (PARTITION BY track, other ORDER BY pos) AS turn FROM m WHERE n = 1 AND ratio >= 0.5), k AS (SELECT * FROM t WHERE turn = 1),
        own AS (SELECT p.track, p.pos, 'primary' AS side, start_ms, end_ms, text AS a, coalesce(heard, '') AS b, k.pos IS NULL AS missing FROM p LEFT JOIN k USING (track, pos)),
        alone AS (SELECT track, pos, 'secondary' AS side, start_ms, end_ms, '' AS a, text AS b, false AS missing FROM s
                  WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.track = s.track AND k.other = s.pos)
                    AND NOT EXISTS (SELECT 1 FROM p WHERE p.track = s.track AND {_NORM.format('p.text')} = {_NORM.format('s.text')} AND {_NORM.format('s.text')} <> '' AND greatest(0, p.start_ms - s.end_ms, s.start_ms - p.end_ms) <= 2000)),
        u AS (SELECT * FROM own UNION ALL SELECT * FROM alone), e AS (SELECT *, len(regexp_extract_all(a, '[A-Za-z]')) >= 2 AS ae, len(regexp_extract_all(b, '[A-Za-z]')) >= 2 AS be FROM u)
        SELECT track, pos, side, start_ms, end_ms, CASE WHEN ae AND NOT regexp_matches(a, '{R.HAN_BASIC}') THEN trim(a) WHEN be THEN trim(b) WHEN ae THEN trim(a) ELSE '' END AS text, length(b)::INTEGER AS heard,
               CASE WHEN side = 'secondary' THEN 'capcut_missing' WHEN missing THEN 'whisper_missing' WHEN NOT ae AND be THEN 'secondary_english_preferred' ELSE '' END AS flags FROM e""",
    "glossary_hits": f"{CUES}, {_hits('cues', 'text')} SELECT track, pos, term, times FROM h",
    "term_usage": f"{CUES}, {_hits('cues', 'text')} SELECT term, sum(times)::BIGINT AS hits, count(*) AS cues FROM h GROUP BY 1",
    "glossary_kept": f"""{CUES}, {_hits('cues', 'text')}, b AS (SELECT term, target, contains(CASE WHEN pos % 2 = 0 THEN '译' || substr(text, 1, 2) ELSE '' END, target)::INT AS kept FROM h JOIN cues USING (track, pos))
        SELECT term, target, count(*) AS said, sum(kept)::BIGINT AS kept, round(sum(kept) / count(*), 6) AS rate FROM b GROUP BY 1, 2""",
    "caption_cleaning": rf"""{CUES}, m AS (SELECT track, pos, {MARKED} AS marked FROM cues), r AS (SELECT *, {_RESTED} AS rest FROM m)
        SELECT track, pos, CASE WHEN regexp_matches(rest, '(?i)^\s*{X.SOUND}\s*[.!?,;:。！？]*\s*$') THEN '' ELSE array_to_string(list_filter(list_transform({_LINES.format('rest')}, lambda x: regexp_replace({_SQUEEZE.format('x')}, '\s+([,.;:!?。，！？；：])', '\1', 'g')), lambda x: regexp_replace(x, '[{X.EDGE}{X.EMPTY_SIGNS}]', '', 'g') <> ''), chr(10)) END AS spoken,
               array_to_string(list_filter(list_transform({_LINES.format('marked')}, lambda x: {_SQUEEZE.format(f"regexp_replace(x, '{X.CENSORED}', ' ', 'g')")}), lambda x: x <> ''), chr(10)) AS uncensored,
               regexp_matches(marked, '{X.OTHER_SCRIPTS}') AS other_script, regexp_replace(regexp_replace(marked, '{X.OTHER_SCRIPTS}', '', 'g'), '^\s+|\s+$', '', 'g') AS latin,
               array_to_string(list_filter(list_transform(string_split(marked, chr(10)), lambda x: CASE WHEN regexp_matches(x, '{X.KANA}') THEN nullif(regexp_replace(regexp_replace(x, '{X.KANA}', '', 'g'), '^\s+|\s+$', '', 'g'), '') ELSE x END), lambda x: x IS NOT NULL), chr(10)) AS no_kana,
               array_to_string(list_filter(list_transform({_LINES.format('marked')}, lambda x: {_SQUEEZE.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '{X.STAGE_JA}')), chr(10)) AS ja_source,
               regexp_replace(lower(regexp_replace(marked, '^[{X.EDGE}]+|[{X.EDGE}]+$', '', 'g')), '\s+', ' ', 'g') AS marker FROM r""",
    "vtt_lines": f"""WITH l AS (SELECT page_id, string_split(coalesce(html, ''), chr(10)) AS l FROM pages), e AS (SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM l)
        SELECT page_id, n::INTEGER AS n, {_PAYLOAD.replace('LINE', 'line')} AS text FROM e""",
    "vtt_scan": f"""{CUES} SELECT track, pos, 1 AS id, start_ms, end_ms, trim(array_to_string(list_filter([trim({_PAYLOAD.replace('LINE', "text || ' & co'")}), 'end'], lambda x: x <> ''), chr(10))) AS text FROM cues WHERE start_ms < 5900000 AND end_ms < 5900000""",
}
