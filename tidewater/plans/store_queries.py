"""Queries over batches, reports, translation memory, timing and small column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import public as P
from ..operators import intervals, manifest, memory
from .cue_queries import CUES, cues, second_track
from .evidence_queries import _RUNS, PUT, _list


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Changes of batch states: each user's events in their order.
CHANGES = "SELECT user_id AS batch, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'pending' ELSE 'running' END AS state, CASE WHEN event_type = 'error' THEN concat('e', event_id) END AS error"


def batch_states(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id AS batch", "event_id AS seq", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'pending' ELSE 'running' END AS state", "CASE WHEN event_type = 'error' THEN concat('e', event_id) END AS error")
    return manifest.states(rows)


def batch_results(spark, sf_dir):
    """Orders as batches: their lines are results, some blank, some repeated under one id, some missing."""
    said = F.when((F.col("l_linenumber") % 5 == 0) & (F.col("l_returnflag") == "N"), " ").otherwise(F.concat("l_linestatus", F.col("l_suppkey").cast("string")))
    number = F.when((F.col("l_linenumber") == 3) & (F.col("l_partkey") % 2 == 0), 2).otherwise(F.col("l_linenumber")).cast("int")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("int").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), number.alias("id"), said.alias("translated")).alias("r"))
    grouped = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("r"))
    state = F.when(F.col("l_orderkey") % 7 == 0, "failed").otherwise("success")
    ids = F.when(F.col("l_orderkey") % 11 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.array_max(F.transform("r", lambda x: x["id"]))))
    batches = grouped.select("l_orderkey", state.alias("state"), ids.alias("ids"), F.transform("r", lambda x: F.struct(x["id"].alias("id"), x["translated"].alias("translated"))).alias("results"))
    used = manifest.usable(batches)
    shown = F.array_join(F.array_sort(F.transform("partial", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), r["translated"]))), "|")
    return used.select("l_orderkey", "whole", shown.alias("partial"))


def layout_changes(spark, sf_dir):
    ids = lambda name, keep: _t(spark, sf_dir, "lineitem").where(keep).groupBy(F.col("l_orderkey").alias("batch")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("ids"))
    return manifest.layout_changes(ids("a", F.col("l_partkey") % 50 != 0), ids("b", F.col("l_suppkey") % 60 != 0))


def result_report(spark, sf_dir):
    c = cues(spark, sf_dir)
    results = c.where("pos % 17 <> 3 OR track % 4 > 0").select("track", F.when(F.col("track") % 5 == 0, F.col("pos") + F.col("pos") % 2 * 100).otherwise(F.col("pos")).alias("id"), F.col("text").alias("original"), F.expr(PUT).alias("translated"))
    return manifest.report(c.select("track", F.col("pos").alias("id")), results, "track")


def round_two_answers(spark, sf_dir):
    """Responses in JSON between fences: answers of events, some of them not expected, repeated or not valid."""
    e = _t(spark, sf_dir, "events")
    answer = F.to_json(F.struct((F.col("event_id") % 7).cast("string").alias("id"), F.concat(F.lit(" t"), F.col("event_id").cast("string")).alias("text"), F.when(F.col("event_id") % 5 == 0, "skip").when(F.col("event_id") % 2 == 0, " Keep ").otherwise("replace").alias("decision"),
        F.when(F.col("event_id") % 6 == 0, "1.5").otherwise("0.5").alias("confidence"), F.col("event_type").alias("reason")))
    rows = e.select(F.floor(F.col("event_id") / 10).alias("batch"), F.struct("event_id", answer.alias("a")).alias("a")).groupBy("batch").agg(F.array_sort(F.collect_list("a")).alias("a"))
    body = F.concat(F.lit("```json\n{\"results\": ["), F.array_join(F.transform("a", lambda x: x["a"]), ", "), F.lit("]}\n```"))
    return manifest.answers(rows.select("batch", F.sequence(F.lit(0), F.lit(5)).alias("expected"), body.alias("response")))


EDITS = """event_id AS seq, concat(' ', upper(event_type), '  u', user_id % 40) AS source, CASE WHEN event_id % 9 = 0 THEN concat('f', event_id % 3) ELSE 'old' END AS previous, concat('f', event_id % 3) AS final,
    CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'Wuwa' ELSE 'wuwa' END AS game, CASE WHEN event_id % 5 = 0 THEN 'ja' ELSE 'en' END AS language, 'zh-CN' AS target, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE event_type END AS error_type, event_id % 10 = 1 AS approve"""


def _edits(spark, sf_dir):
    from .evidence_queries import _columns

    return _t(spark, sf_dir, "events").selectExpr(*_columns(EDITS))


def memory_merge(spark, sf_dir):
    edits = _edits(spark, sf_dir)
    return memory.merge_edits(memory.entries_of(edits.where("seq % 2 = 0 AND seq < 5000")), edits.where("seq % 2 = 1 OR seq >= 5000"))


def memory_hits(spark, sf_dir):
    entries = memory.entries_of(_edits(spark, sf_dir))
    asked = _t(spark, sf_dir, "events").select(F.concat(F.col("event_type"), F.lit(" U"), (F.col("user_id") % 50).cast("string")).alias("text"), F.lit("en").alias("language"), F.lit("zh-CN").alias("target"), F.when(F.col("user_id") % 2 == 0, "WUWA").otherwise("").alias("game"))
    return memory.approved_for(entries, asked).select("id", "source_normalized", "game", "final")


def memory_retained(spark, sf_dir):
    return memory.retained(memory.entries_of(_edits(spark, sf_dir)), 400).select("id", "approved")


def timed_tokens(spark, sf_dir):
    return intervals.timed_tokens(cues(spark, sf_dir).select("track", "pos", "start_ms", "end_ms", "text"))


def applied_timing(spark, sf_dir):
    c = cues(spark, sf_dir).where("end_ms > start_ms")
    aligned = c.select("track", "pos", (F.col("start_ms") + 700).alias("start_ms"), (F.col("end_ms") - F.col("pos") % 300).alias("end_ms")).where("pos % 3 <> 1")
    return intervals.apply_timing(second_track(c).select("track", "pos", "start_ms", "end_ms"), c.select("track", "pos", "start_ms", "end_ms"), aligned)


def remapped_cues(spark, sf_dir):
    return intervals.remapped(cues(spark, sf_dir).where("text <> ''").select("track", "pos", "start_ms", "end_ms"), 90_000)


def language_pairs(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    pair = P.language_pair(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("lang"))).when(F.col("doc_id") % 3 == 1, "ja"), F.when(F.col("doc_id") % 5 == 0, " zh-CN ").when(F.col("doc_id") % 5 == 1, "zh"))
    return d.select("doc_id", pair["source_language"].alias("source_language"), pair["target_language"].alias("target_language"))


def delivery_states(spark, sf_dir):
    q = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_quantity") > 10) / F.count("*")).alias("risk"), (F.count_if(F.col("l_quantity") > 25) / F.count("*")).alias("req"), F.count_if(F.col("l_quantity") > 40).alias("n"))
    return q.select("l_orderkey", P.delivery_state(F.col("risk"), F.col("req"), F.col("n")).alias("state"))


def searches(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", P.mentions(" BRAND#2", F.col("p_name"), F.col("p_brand")).alias("job"), (F.lower("p_name").contains("e") | F.lower("p_type").contains("brass")).alias("glossary"), P.is_unresolved(F.col("p_size") > 10, F.when(F.col("p_size") % 2 == 0, "review").otherwise("accepted")).alias("unresolved"))


def full_width_punctuation(spark, sf_dir):
    return cues(spark, sf_dir).select("track", "pos", P.full_width(F.concat(F.col("text"), F.lit(", a. b 3.14 x!! y ?? z: w; ... "))).alias("text"))


QUERIES = {f.__name__: f for f in (batch_states, batch_results, layout_changes, result_report, round_two_answers, memory_merge, memory_hits, memory_retained, timed_tokens, applied_timing, remapped_cues, language_pairs, delivery_states, searches, full_width_punctuation)}

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _entries(name: str, where: str) -> str:
    return f"""{name}0 AS (SELECT seq, {_STRIP.format('source')} AS source, previous, final, coalesce(nullif(game, ''), 'default') AS game, language, target, coalesce(nullif(trim(error_type), ''), '其他') AS error_type, approve FROM d WHERE {where}),
        {name}1 AS (SELECT *, CASE WHEN language = 'en' THEN lower(regexp_replace(source, '\\s+', ' ', 'g')) ELSE regexp_replace(source, '\\s+', ' ', 'g') END AS norm FROM {name}0 WHERE final <> previous),
        {name}2 AS (SELECT *, substr(sha256(language || chr(0) || target || chr(0) || lower(game) || chr(0) || norm || chr(0) || final), 1, 24) AS id FROM {name}1),
        {name} AS (SELECT id, arg_max(source, seq) AS source, any_value(norm) AS source_normalized, arg_max(previous, seq) AS previous, any_value(final) AS final, arg_min(game, seq) AS game, any_value(language) AS language, any_value(target) AS target,
                   arg_max(error_type, seq) AS error_type, bool_or(approve) AS approved, count(*) AS seen_count, min(seq) AS created_seq, max(seq) AS updated_seq FROM {name}2 GROUP BY id)"""


_SAFE = _list(manifest.SAFE)
_LEFT = f"len(list_filter({_RUNS.format('translated')}, lambda w: regexp_matches(w, '^[A-Za-z]{{3,}}$') AND NOT (list_contains({_SAFE}, w) OR list_contains({_SAFE}, upper(w)) OR list_contains({_SAFE}, upper(w[1]) || lower(w[2:]))))) > 0"
_T0 = "start_ms + round_even(length * {0} / count, 0)::BIGINT"
SQL = {
    "batch_states": f"""WITH c AS ({CHANGES} FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY batch ORDER BY seq) AS before FROM c)
        SELECT batch, arg_max(state, seq) AS state, sum(CASE WHEN state = 'running' AND before IS DISTINCT FROM 'running' THEN 1 ELSE 0 END)::BIGINT AS attempts,
               CASE WHEN max(seq) FILTER (error IS NOT NULL) > coalesce(max(seq) FILTER (state IN ('running', 'success')), -1) THEN arg_max(error, seq) FILTER (error IS NOT NULL) END AS error FROM l GROUP BY 1""",
    "batch_results": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 3 AND l_partkey % 2 = 0 THEN 2 ELSE l_linenumber END AS id, CASE WHEN l_linenumber % 5 = 0 AND l_returnflag = 'N' THEN ' ' ELSE l_linestatus || l_suppkey::VARCHAR END AS translated FROM lineitem),
        n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, id, translated) AS k FROM r),
        last AS (SELECT l_orderkey, id, arg_max(translated, k) AS translated FROM n WHERE trim(translated) <> '' GROUP BY 1, 2),
        x AS (SELECT l_orderkey, max(id) AS top FROM n GROUP BY 1),
        p AS (SELECT l_orderkey, string_agg(id::VARCHAR || ':' || translated, '|' ORDER BY id::VARCHAR || ':' || translated) AS partial, count(*) AS got FROM last GROUP BY 1)
        SELECT l_orderkey, l_orderkey % 7 <> 0 AND (l_orderkey % 11 = 0 OR coalesce(got, 0) = top) AS whole, coalesce(partial, '') AS partial FROM x LEFT JOIN p USING (l_orderkey)""",
    "layout_changes": """WITH a AS (SELECT DISTINCT l_orderkey AS batch, l_linenumber AS id FROM lineitem WHERE l_partkey % 50 <> 0), b AS (SELECT DISTINCT l_orderkey AS batch, l_linenumber AS id FROM lineitem WHERE l_suppkey % 60 <> 0)
        SELECT DISTINCT batch FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))""",
    "result_report": f"""{CUES}, g AS (SELECT track, pos AS id FROM cues),
        r AS (SELECT track, CASE WHEN track % 5 = 0 THEN pos + pos % 2 * 100 ELSE pos END AS id, text AS original, {PUT} AS translated FROM cues WHERE pos % 17 <> 3 OR track % 4 > 0),
        f AS (SELECT coalesce(a.track, b.track) AS track, count(*) FILTER (b.id IS NULL) AS missing, count(*) FILTER (a.id IS NULL) AS extra FROM (SELECT DISTINCT * FROM g) a FULL JOIN (SELECT DISTINCT track, id FROM r) b ON a.track = b.track AND a.id = b.id GROUP BY 1),
        c AS (SELECT track, count(*) AS given FROM g GROUP BY 1),
        s AS (SELECT track, count(*) AS got, count(*) FILTER (trim(translated) = '') AS empty, count(*) FILTER (translated <> '' AND original <> '' AND length(translated) / greatest(length(original), 1) < 0.05) AS short,
              count(*) FILTER (translated <> '' AND original <> '' AND length(translated) / greatest(length(original), 1) > 5) AS long, count(*) FILTER ({_LEFT}) AS leftover FROM r GROUP BY 1)
        SELECT track, coalesce(given, 0) AS given, coalesce(got, 0) AS got, missing, extra, coalesce(empty, 0) AS empty, coalesce(short, 0) AS short, coalesce(long, 0) AS long, coalesce(leftover, 0) AS leftover,
               coalesce(given, 0) = coalesce(got, 0) AND missing = 0 AND extra = 0 AND coalesce(empty, 0) = 0 AS passed FROM f LEFT JOIN c USING (track) LEFT JOIN s USING (track)""",
    "round_two_answers": """WITH a AS (SELECT event_id // 10 AS batch, event_id, (event_id % 7)::INTEGER AS id, CASE WHEN event_id % 2 = 0 THEN 'keep' ELSE 'replace' END AS decision, 't' || event_id::VARCHAR AS text, 0.5::DOUBLE AS confidence, event_type AS reason
            FROM events WHERE event_id % 7 <= 5 AND event_id % 5 <> 0 AND event_id % 6 <> 0)
        SELECT batch, id, decision, text, confidence, reason FROM a QUALIFY row_number() OVER (PARTITION BY batch, id ORDER BY event_id) = 1""",
    "memory_merge": f"""WITH d AS (SELECT {EDITS} FROM events), {_entries('b', 'seq % 2 = 0 AND seq < 5000')}, {_entries('n', 'seq % 2 = 1 OR seq >= 5000')}
        SELECT coalesce(b.id, n.id) AS id, coalesce(n.source, b.source) AS source, coalesce(b.source_normalized, n.source_normalized) AS source_normalized, coalesce(n.previous, b.previous) AS previous, coalesce(b.final, n.final) AS final, coalesce(b.game, n.game) AS game,
               coalesce(b.language, n.language) AS language, coalesce(b.target, n.target) AS target, coalesce(n.error_type, b.error_type) AS error_type, coalesce(b.approved, false) OR coalesce(n.approved, false) AS approved,
               coalesce(b.seen_count, 0) + coalesce(n.seen_count, 0) AS seen_count, coalesce(b.created_seq, n.created_seq) AS created_seq, coalesce(n.updated_seq, b.updated_seq) AS updated_seq FROM b FULL JOIN n ON b.id = n.id""",
    "memory_hits": f"""WITH d AS (SELECT {EDITS} FROM events), {_entries('b', 'true')}, q AS (SELECT DISTINCT lower(event_type || ' U' || (user_id % 50)::VARCHAR) AS s, CASE WHEN user_id % 2 = 0 THEN 'wuwa' ELSE '' END AS g FROM events)
        SELECT id, source_normalized, game, final FROM b WHERE approved AND language = 'en' AND EXISTS (SELECT 1 FROM q WHERE s = source_normalized AND (g = '' OR g = lower(game)))""",
    "memory_retained": f"""WITH d AS (SELECT {EDITS} FROM events), {_entries('b', 'true')}, r AS (SELECT id, approved, row_number() OVER (PARTITION BY approved ORDER BY updated_seq DESC, id) AS n FROM b)
        SELECT id, approved FROM r WHERE approved OR n <= greatest(0, 400 - (SELECT count(*) FROM b WHERE approved))""",
    "timed_tokens": f"""{CUES}, w AS (SELECT track, pos, start_ms, end_ms, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?') AS w FROM cues), c AS (SELECT *, len(w) AS count, greatest(len(w) * 120, least(greatest(end_ms - start_ms, len(w)), greatest(800, len(w) * 800))) AS length FROM w WHERE len(w) > 0),
        e AS (SELECT track, pos, start_ms, length, count, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS n FROM c)
        SELECT track, pos, n::INTEGER AS n, word, {_T0.format('n')} AS start_ms, {_T0.format('(n + 1)')} AS end_ms FROM e""",
    "applied_timing": f"""{CUES}, c AS (SELECT * FROM cues WHERE end_ms > start_ms), i AS (SELECT o.track, o.pos, o.start_ms, o.end_ms FROM other o JOIN c USING (track, pos)),
        s AS (SELECT i.track, i.pos, min(c.start_ms + 700) AS s, max(c.end_ms - c.pos % 300) AS e FROM i JOIN c ON i.track = c.track AND c.end_ms > i.start_ms AND c.start_ms < i.end_ms AND c.pos % 3 <> 1 GROUP BY 1, 2)
        SELECT track, pos, coalesce(s, start_ms) AS start_ms, coalesce(e, end_ms) AS end_ms FROM i LEFT JOIN s USING (track, pos)""",
    "remapped_cues": f"{CUES} SELECT track, pos, start_ms + 90000 AS start_ms, end_ms + 90000 AS end_ms, row_number() OVER (PARTITION BY track ORDER BY pos)::INTEGER AS id FROM cues WHERE text <> ''",
    "language_pairs": """WITH p AS (SELECT doc_id, coalesce(lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' || upper(lang) WHEN doc_id % 3 = 1 THEN 'ja' END)), 'en') AS s, coalesce(trim(CASE WHEN doc_id % 5 = 0 THEN ' zh-CN ' WHEN doc_id % 5 = 1 THEN 'zh' END), 'zh-CN') AS t FROM documents)
        SELECT doc_id, CASE WHEN s IN ('en', 'ja', 'ko') AND t = 'zh-CN' THEN s END AS source_language, CASE WHEN s IN ('en', 'ja', 'ko') AND t = 'zh-CN' THEN t END AS target_language FROM p""",
    "delivery_states": """WITH q AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 10) / count(*) AS a, count(*) FILTER (l_quantity > 25) / count(*) AS b, count(*) FILTER (l_quantity > 40) AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CASE WHEN a >= 0.8 AND b >= 0.5 THEN 'source_unreliable' WHEN n > 0 THEN 'review_required' ELSE 'deliverable' END AS state FROM q""",
    "searches": "SELECT p_partkey, contains(lower(p_name || ' ' || p_brand), 'brand#2') AS job, contains(lower(p_name), 'e') OR contains(lower(p_type), 'brass') AS glossary, p_size > 10 AND p_size % 2 = 0 AS unresolved FROM part",
    "full_width_punctuation": rf"""{CUES}, a AS (SELECT track, pos, regexp_replace({_STRIP.format("text || ', a. b 3.14 x!! y ?? z: w; ... '")}, '[.。]+$', '') AS t FROM cues), b AS (SELECT track, pos, regexp_replace(t, ',\s*', '，', 'g') AS t FROM a),
        c AS (SELECT track, pos, replace(regexp_replace(regexp_replace(regexp_replace(t, '([0-9])\.', '\1' || chr(1), 'g'), '\.([0-9])', chr(1) || '\1', 'g'), '\.\s*', '。', 'g'), chr(1), '.') AS t FROM b),
        d AS (SELECT track, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\s*', '！', 'g'), '\?\s*', '？', 'g'), ':\s*', '：', 'g'), ';\s*', '；', 'g') AS t FROM c),
        e AS (SELECT track, pos, regexp_replace(regexp_replace(regexp_replace(replace(t, '...', '…'), '[.。]{{3,}}', '…', 'g'), '！{{2,}}', '！', 'g'), '？{{2,}}', '？', 'g') AS t FROM d)
        SELECT track, pos, {_STRIP.format("regexp_replace(t, '[，。；：！？、]+$', '')")} AS text FROM e""",
}
