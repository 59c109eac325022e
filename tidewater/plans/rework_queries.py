"""Queries over work kept from an earlier run, rebuilds, change plans, reports, misheard names and shown cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions import text as X
from ..operators import display, names, reports, rework
from .cue_queries import CUES, cues
from .evidence_queries import _LINES, _SQUEEZE, _columns, _list


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Cues of now and of an earlier run: some moved, some renumbered, some with sounds that are gone, some not translated.
NOW = "track, pos AS id, start_ms, end_ms, text"
THEN = "track, CASE WHEN pos % 4 = 1 THEN pos + 100 ELSE pos END AS id, CASE WHEN pos % 3 = 0 THEN start_ms + 5 ELSE start_ms END AS start_ms, end_ms, CASE WHEN pos % 5 = 2 THEN concat('[music] ', text) ELSE text END AS original"
SAID = "track, id, original, id * 2 AS seq, CASE WHEN id % 6 = 5 THEN ' ' ELSE concat('t', id) END AS translated"
AGAIN = "track, id, original, id * 2 + 1 AS seq, concat('u', id) AS translated"


def kept_results(spark, sf_dir):
    c = cues(spark, sf_dir).where("text <> ''")
    then = c.selectExpr(*_columns(THEN))
    results = then.selectExpr(*_columns(SAID)).unionByName(then.where("id % 7 = 3").selectExpr(*_columns(AGAIN)))
    return rework.kept_results(c.selectExpr(*_columns(NOW)), results, then).select("track", "id", "kept", "by")


def kept_answers(spark, sf_dir):
    """Lines of an order as risks: the part is the key, and some lines changed theirs."""
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("id"), "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("l_returnflag"))
    one = lines.groupBy("track", "id").agg(F.min("l_partkey").alias("p"), F.max("l_partkey").alias("q"))
    active = one.select("track", "id", F.col("p").cast("string").alias("key"), F.when(F.col("id") == 2, "ja").when(F.col("id") == 3, "").otherwise("en").alias("language"))
    entries = one.select("track", "id", F.when(F.col("id") % 4 == 0, F.col("q")).otherwise(F.col("p")).cast("string").alias("key"))
    answer = F.when(F.col("l_returnflag") == "A", "Keep").when(F.col("l_returnflag") == "N", "replace").otherwise("skip")
    results = lines.select("track", (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"), "id", answer.alias("decision"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit(" s"), F.col("l_suppkey"))).alias("translated"), F.when(F.col("l_suppkey") % 2 == 0, 0.5).alias("confidence"))
    return rework.kept_answers(active, entries, results, legacy=True)


UNITS = """track, pos, start_ms, end_ms, CASE WHEN pos % 4 = 0 THEN 'unresolved' ELSE 'primary' END AS decision, pos % 3 = 0 AS clash, (pos * 7 % 10) / 10.0 AS confidence, CASE WHEN pos % 2 = 0 THEN text END AS name,
    CASE WHEN pos % 3 = 1 THEN '' ELSE text END AS canonical, CASE WHEN pos % 5 = 0 THEN NULL ELSE concat('e ', text) END AS evidence"""


def rebuild_queue(spark, sf_dir):
    u = cues(spark, sf_dir).selectExpr(*_columns(UNITS))
    why = rework.rebuild_reasons(F.col("decision"), F.col("clash"), F.col("confidence"), F.when(F.col("name").isNotNull(), F.array("name")))
    return rework.rebuild_queue(u.withColumn("reasons", why), 2).select("track", "pos", F.array_join("reasons", ",").alias("reasons"), "called")


def unit_neighbours(spark, sf_dir):
    n = rework.neighbours(cues(spark, sf_dir).selectExpr(*_columns(UNITS)))
    return n.select("track", "pos", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


def blocking_risks(spark, sf_dir):
    """Priorities and states of orders as reasons with evidence behind a colon."""
    o = _t(spark, sf_dir, "orders")
    reasons = F.array(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "unknown_entity").when(F.col("o_orderkey") % 3 == 1, "credit_line").otherwise("reading_speed"), F.lit(":"), "o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "number_mismatch").otherwise("noise_command"))
    return o.select("o_orderkey", rework.blocks(reasons).alias("blocks"))


def _plan(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    store = p.selectExpr("concat('t', p_partkey) AS term", "p_name AS target", "p_brand AS category")
    doing = p.where("p_partkey % 3 = 0").selectExpr("p_partkey AS action", "CASE WHEN p_partkey % 2 = 0 THEN 'add' ELSE 'replace' END AS operation", "CASE WHEN p_partkey % 5 = 0 THEN 'gone' ELSE concat('t', p_partkey + 1) END AS old_term",
        "CASE WHEN p_partkey % 7 < 3 THEN concat('n', p_partkey) ELSE concat('t', p_partkey) END AS term", "CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_name END AS target", "p_brand AS category")
    return store, rework.change_plan(doing, store)


def change_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[1].select("action", "state", "why")


def changed_store(spark, sf_dir):
    return rework.apply_plan(*_plan(spark, sf_dir))


SCORED = """track AS conv, text AS gold, CASE WHEN pos % 6 = 0 THEN '__ERROR__ x' WHEN pos % 6 = 1 THEN concat(' ', text, ' ') WHEN pos % 6 = 2 THEN concat(text, ' 12.5?') WHEN pos % 6 = 3 THEN concat('不 ', text) WHEN pos % 6 = 4 THEN concat(substr(text, 1, 30), ' 안') ELSE text END AS translation"""


def translation_scores(spark, sf_dir):
    rows = cues(spark, sf_dir).selectExpr("role", *_columns(SCORED)).withColumn("entities", F.slice(F.split("gold", " "), 1, 3))
    return reports.translation_scores(rows, "role")


def run_means(spark, sf_dir):
    """Orders of a customer as runs; one without a price has no cost."""
    o = _t(spark, sf_dir, "orders").selectExpr("o_custkey AS model", "o_orderkey % 50 AS tokens_in", "o_orderkey % 30 AS tokens_out", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 END AS tokens_total", "o_orderkey % 1000 / 8.0D AS wall_seconds",
        "CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 64 / 16.0D END AS cost", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 32 / 32.0D END AS exact")
    means = reports.run_means(o, "model", ["exact"])
    return means.withColumn("exact", F.round("exact", 6))


def review_states(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("user_id", "CASE event_id % 7 WHEN 0 THEN 'keep' WHEN 1 THEN 'replace' WHEN 2 THEN 'replace_rejected' WHEN 3 THEN 'no_result' WHEN 4 THEN 'other' END AS state")
    return reports.state_counts(e, "user_id")


def _jobs(spark, sf_dir):
    return _t(spark, sf_dir, "orders").selectExpr("o_orderkey AS job", "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS state", "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS error",
        "o_orderdate AS updated", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS completed", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END AS dry_run")


def recent_failures(spark, sf_dir):
    return reports.recent_failures(_jobs(spark, sf_dir))


def reviewable_jobs(spark, sf_dir):
    return reports.reviewable(_jobs(spark, sf_dir)).select("job")


def tag_counts(spark, sf_dir):
    return reports.tag_counts(_t(spark, sf_dir, "documents").select(F.array("lang", "source").alias("tags")).withColumn("tags", F.array_compact("tags")), "tags")


def speech_coverage(spark, sf_dir):
    c = cues(spark, sf_dir)
    return reports.speech_coverage(c, c.groupBy("track").agg((F.max("end_ms") - F.min("start_ms") % 7 * 100_000).alias("audio_ms")))


def _names(spark, sf_dir):
    """Names made of the benchmark's words with two letters changed in place, and of pairs of its words without the last letter."""
    w = _t(spark, sf_dir, "benchmark").select(X.words(F.col("text")).alias("w"))
    one = w.select(F.explode("w").alias("a")).where("length(a) >= 5").selectExpr("concat(substr(a, 1, 1), substr(a, 3, 1), substr(a, 2, 1), substr(a, 4)) AS term", "concat('n', length(a)) AS target")
    two = w.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1]))).alias("a")).selectExpr("substr(a, 1, length(a) - 1) AS term", "'pair' AS target")
    return one.unionByName(two).distinct().withColumn("category", F.lit("character"))


def _heard(spark, sf_dir):
    return cues(spark, sf_dir).select("track", "pos", F.when(F.col("pos") % 2 == 0, F.initcap("text")).otherwise(F.col("text")).alias("text"))


def misheard_names(spark, sf_dir):
    rows = _heard(spark, sf_dir)
    return names.misheard(rows, ["track", "pos"], _names(spark, sf_dir), rows.select("track", "pos", F.split_part("text", F.lit(" "), F.lit(1)).alias("term")))


def _long_cues(spark, sf_dir):
    """Cues that last long; some hold Chinese without spaces, some version numbers."""
    text = F.when(F.col("pos") % 4 == 1, F.concat(F.repeat(F.lit("我们在路上看到了3.1版本的斯特赖德之门"), 3), F.substring("text", 1, 30))).when(F.col("pos") % 4 == 2, F.regexp_replace("text", "[,.;:!?]", "")).otherwise(F.substring("text", 1, 200))
    return cues(spark, sf_dir).select("track", "pos", "start_ms", (F.col("end_ms") + F.col("pos") % 3 * 9000).alias("end_ms"), text.alias("text"))


def reading_rhythm(spark, sf_dir):
    return display.numbered(display.reading_rhythm(_long_cues(spark, sf_dir)))


def _spans(rows):
    step = F.sequence(F.lit(0), F.col("pos") % 5)
    return rows.select("track", "pos", F.explode(step).alias("k"), "start_ms", "end_ms").select("track", "pos", (F.col("start_ms") + F.col("k") * 2900).alias("start_ms"), (F.col("start_ms") + F.col("k") * 2900 + 2500).alias("end_ms"))


def shown_cues(spark, sf_dir):
    rows = _long_cues(spark, sf_dir)
    return display.redistributed(rows, _spans(rows))


QUERIES = {f.__name__: f for f in (kept_results, kept_answers, rebuild_queue, unit_neighbours, blocking_risks, change_plan, changed_store, translation_scores, run_means, review_states, recent_failures, reviewable_jobs, tag_counts, speech_coverage, misheard_names, reading_rhythm, shown_cues)}

_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_REST = rf"regexp_replace(regexp_replace(TEXT, '(?i)[\[\(\{{（【]\s*{X.SOUND}\s*[\]\)\}}）】]', ' ', 'g'), '{X.MUSIC_SIGNS}', ' ', 'g')"


def _bare(text: str) -> str:
    rest = _REST.replace('TEXT', text)
    return rf"""CASE WHEN regexp_matches({rest}, '(?i)^\s*{X.SOUND}\s*[.!?,;:。！？]*\s*$') THEN '' ELSE array_to_string(list_filter(list_transform({_LINES.format(rest)}, lambda x: regexp_replace({_SQUEEZE.format('x')}, '\s+([,.;:!?。，！？；：])', '\1', 'g')), lambda x: regexp_replace(x, '[{X.EDGE}{X.EMPTY_SIGNS}]', '', 'g') <> ''), chr(10)) END"""


_PLAN = """store AS (SELECT concat('t', p_partkey) AS term, p_name AS target, p_brand AS category FROM part),
    doing AS (SELECT p_partkey AS action, CASE WHEN p_partkey % 2 = 0 THEN 'add' ELSE 'replace' END AS operation, CASE WHEN p_partkey % 5 = 0 THEN 'gone' ELSE concat('t', p_partkey + 1) END AS old_term,
              CASE WHEN p_partkey % 7 < 3 THEN concat('n', p_partkey) ELSE concat('t', p_partkey) END AS term, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_name END AS target, p_brand AS category FROM part WHERE p_partkey % 3 = 0),
    said AS (SELECT a.*, CASE WHEN operation = 'add' AND n.term IS NULL THEN 'change' WHEN operation = 'add' AND n.target = a.target AND n.category = a.category THEN 'applied' WHEN operation = 'add' THEN 'existing row conflicts'
                              WHEN o.term IS NULL AND n.target = a.target AND n.category = a.category THEN 'applied' WHEN o.term IS NULL THEN 'old row is missing' WHEN n.term IS NOT NULL THEN 'both rows exist' WHEN o.target <> a.target THEN 'target differs' ELSE 'change' END AS s
             FROM doing a LEFT JOIN store n ON n.term = a.term LEFT JOIN store o ON o.term = a.old_term)"""
_JOBS = """j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS error, o_orderdate AS updated,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END AS dry_run FROM orders)"""
_WHY = "list_filter([CASE WHEN decision = 'unresolved' THEN 'source_unresolved' END, CASE WHEN clash AND confidence < 0.45 THEN 'low_confidence_conflict' END, CASE WHEN clash AND name IS NOT NULL THEN 'unknown_entity_conflict' END], lambda x: x IS NOT NULL)"
_NUM = r"regexp_extract_all({0}, '\d+(?:\.\d+)?')"
_NEG = f"regexp_matches({{0}}, '[{reports.NEGATIONS}]')"
SQL = {
    "kept_results": f"""{CUES}, c AS (SELECT * FROM cues WHERE text <> ''), e AS (SELECT {THEN} FROM c), r AS (SELECT {SAID} FROM e UNION ALL SELECT {AGAIN} FROM e WHERE id % 7 = 3), s AS (SELECT *, {_bare('original')} AS bare FROM r WHERE trim(translated) <> ''),
        a AS (SELECT s.track, e.start_ms, e.end_ms, e.original AS text, arg_max(s.translated, s.seq) AS v FROM s JOIN e USING (track, id) GROUP BY ALL), b AS (SELECT track, id, original AS text, arg_max(translated, seq) AS v FROM s GROUP BY ALL),
        d AS (SELECT track, id, bare, arg_max(translated, seq) AS v FROM s WHERE bare <> '' GROUP BY ALL), n AS (SELECT {NOW}, {_bare('text')} AS bare FROM c)
        SELECT track, id, coalesce(a.v, b.v, d.v) AS kept, CASE WHEN a.v IS NOT NULL THEN 'times' WHEN b.v IS NOT NULL THEN 'id' WHEN d.v IS NOT NULL THEN 'cleaned' END AS by
        FROM n LEFT JOIN a USING (track, start_ms, end_ms, text) LEFT JOIN b USING (track, id, text) LEFT JOIN d USING (track, id, bare)""",
    "kept_answers": """WITH l AS (SELECT DISTINCT l_orderkey AS track, l_linenumber AS id, l_partkey AS p, l_suppkey AS s FROM lineitem), f AS (SELECT l_orderkey AS track, l_linenumber AS id, l_partkey AS p, l_suppkey AS s, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
        o AS (SELECT track, id, min(p) AS lo, max(p) AS hi FROM l GROUP BY ALL), k AS (SELECT track, id FROM o WHERE id <> 2 AND (id % 4 <> 0 OR lo = hi)),
        a AS (SELECT track, id, arg_max({'decision': CASE flag WHEN 'A' THEN 'keep' WHEN 'N' THEN 'replace' ELSE 'review' END, 'text': concat('s', s), 'confidence': CASE WHEN s % 2 = 0 THEN 0.5 ELSE 0.0 END}, p * 1000 + s) AS v FROM f WHERE s % 9 <> 0 GROUP BY ALL)
        SELECT track, id, v.decision AS decision, v.text AS text, v.confidence::DOUBLE AS confidence FROM k JOIN a USING (track, id)""",
    "rebuild_queue": f"""{CUES}, u AS (SELECT {UNITS} FROM cues), w AS (SELECT *, {_WHY} AS r FROM u)
        SELECT track, pos, array_to_string(r, ',') AS reasons, row_number() OVER (PARTITION BY track ORDER BY start_ms, end_ms, pos) <= 2 AS called FROM w WHERE len(r) > 0""",
    "unit_neighbours": f"""{CUES}, u AS (SELECT {UNITS} FROM cues), s AS (SELECT track, pos, coalesce(nullif(canonical, ''), nullif(evidence, '')) AS t FROM u)
        SELECT track, pos, concat_ws('|', lag(t, 2) OVER w, lag(t, 1) OVER w) AS before, concat_ws('|', lead(t, 1) OVER w, lead(t, 2) OVER w) AS after FROM s WINDOW w AS (PARTITION BY track ORDER BY pos)""",
    "blocking_risks": f"""SELECT o_orderkey, len(list_intersect([CASE o_orderkey % 3 WHEN 0 THEN 'unknown_entity' WHEN 1 THEN 'credit_line' ELSE 'reading_speed' END, CASE WHEN o_orderstatus = 'F' THEN 'number_mismatch' ELSE 'noise_command' END], {_list(R.AUTOMATIC)})) > 0 AS blocks FROM orders""",
    "change_plan": f"WITH {_PLAN} SELECT action, CASE WHEN s IN ('change', 'applied') THEN s ELSE 'conflict' END AS state, CASE WHEN s NOT IN ('change', 'applied') THEN s END AS why FROM said",
    "changed_store": f"WITH {_PLAN} SELECT * FROM store WHERE term NOT IN (SELECT old_term FROM said WHERE s = 'change' AND operation <> 'add') UNION ALL SELECT term, target, category FROM said WHERE s = 'change'",
    "translation_scores": f"""{CUES}, r AS (SELECT role, {SCORED} FROM cues), c AS (SELECT *, {_NUM.format('gold')} AS a, {_NUM.format('translation')} AS b, string_split(gold, ' ')[1:3] AS names FROM r WHERE gold <> '' AND translation <> '' AND NOT starts_with(translation, '__ERROR__'))
        SELECT role, count(*) AS checked, count_if({_STRIPPED.format('gold')} = {_STRIPPED.format('translation')})::BIGINT AS exact, count_if(len(a) > 0)::BIGINT AS number_checked, count_if(regexp_matches(translation, '[가-힯]'))::BIGINT AS hangul_left,
               round(count_if(len(a) > 0 AND list_sort(a) = list_sort(b)) / nullif(count_if(len(a) > 0), 0), 3) AS number_accuracy, round(count_if({_NEG.format('gold')} = {_NEG.format('translation')}) / count(*), 3) AS negation_accuracy,
               round(count_if(regexp_matches(gold, '[?？]') = regexp_matches(translation, '[?？]')) / count(*), 3) AS question_accuracy, round(sum(len(list_filter(names, lambda e: contains(translation, e)))) / nullif(sum(len(names)), 0), 3) AS entity_accuracy FROM c GROUP BY role""",
    "run_means": """WITH o AS (SELECT o_custkey AS model, o_orderkey % 50 AS i, o_orderkey % 30 AS o, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 END AS t, o_orderkey % 1000 / 8.0 AS w, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 64 / 16.0 END AS c, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 32 / 32.0 END AS x FROM orders)
        SELECT model, count(*) AS repeat, round(avg(x::DOUBLE), 6) AS exact, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, sum(coalesce(nullif(t, 0), i + o))::BIGINT AS tokens_total, round(sum(w::DOUBLE), 3) AS wall_seconds, CASE WHEN bool_and(c IS NOT NULL) THEN sum(c::DOUBLE) END AS cost FROM o GROUP BY model""",
    "review_states": "WITH e AS (SELECT user_id, coalesce(CASE event_id % 7 WHEN 0 THEN 'keep' WHEN 1 THEN 'replace' WHEN 2 THEN 'replace_rejected' WHEN 3 THEN 'no_result' WHEN 4 THEN 'other' END, 'deferred_weak_risk') AS s FROM events) SELECT user_id, count(*) AS total, " + ", ".join(f"count_if(s = '{s}')::BIGINT AS {s}" for s in reports.STATES) + " FROM e GROUP BY user_id",
    "recent_failures": f"WITH {_JOBS} SELECT job, coalesce(nullif(error, ''), 'internal_error') AS error FROM j WHERE state = 'failed' ORDER BY updated DESC, job DESC LIMIT 5",
    "reviewable_jobs": f"WITH {_JOBS} SELECT job FROM j WHERE state = 'completed' AND NOT coalesce(dry_run, false)",
    "tag_counts": "SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) WHERE tag IS NOT NULL GROUP BY tag",
    "speech_coverage": f"{CUES}, t AS (SELECT track, sum(end_ms - start_ms) AS said, max(end_ms) - min(start_ms) % 7 * 100000 AS a FROM cues GROUP BY track) SELECT track, round(CASE WHEN a > 0 THEN said / a END, 3) AS coverage FROM t",
}
