"""Queries over names and terms: glossary extraction by language, entity candidates, names put right, words nearly alike, live job logs.

Japanese and Korean texts are the conversations' with each Latin letter put as a character of the script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import carry, entities, similar
from ..streaming import watch
from .cue_queries import CUES, cues
from .evidence_queries import _TERMS, _columns, _terms

LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {"ja": "アイウエオカキクケコサシスセソタチツテトナニヌネノハ", "ko": "가나다라마바사아자차카타파하거너더러머버서어저처커터"}
IDS = ["track", "pos"]


def _as(script: str, text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, SCRIPTS[script])


def _foreign(spark, sf_dir, script: str) -> tuple[DataFrame, DataFrame]:
    rows = cues(spark, sf_dir).select(*IDS, _as(script, F.col("text")).alias("text"))
    terms = _terms(spark, sf_dir).where("NOT term RLIKE '[^a-z]'").select(_as(script, F.col("term")).alias("term"), "target").where("length(term) >= 3")
    return rows, terms


def glossary_extract(spark, sf_dir):
    return entities.extract(cues(spark, sf_dir).select(*IDS, "text"), IDS, _terms(spark, sf_dir)).select(*IDS, "term", "times")


def glossary_extract_ja(spark, sf_dir):
    rows, terms = _foreign(spark, sf_dir, "ja")
    return entities.extract(rows, IDS, terms, "ja").select(*IDS, "term", "times")


def glossary_extract_ko(spark, sf_dir):
    rows, terms = _foreign(spark, sf_dir, "ko")
    return entities.extract(rows, IDS, terms, "ko").select(*IDS, "term", "times")


def cased(spark, sf_dir) -> DataFrame:
    """Cues with capitals, announcements, addresses and slips of names at fixed positions."""
    said = """CASE WHEN pos % 4 = 0 THEN concat('Sponsored by ', initcap(element_at(split(text, ' '), 1)), ' ', initcap(element_at(split(text, ' '), 1)), ' ', text) WHEN pos % 4 = 1 THEN initcap(text)
        WHEN pos % 4 = 2 THEN concat('see www.', replace(text, ' ', '.'), ' now ', initcap(substring(text, 1, 80))) ELSE text END"""
    return cues(spark, sf_dir).select(*IDS, F.expr(said).alias("text"))


def names(spark, sf_dir) -> DataFrame:
    return _terms(spark, sf_dir).where("term RLIKE '^[a-z]{5,}$'").select(F.initcap("term").alias("term"), "target")


def entity_candidates(spark, sf_dir):
    """Words that several cues hold in lower case are no names."""
    plain = cues(spark, sf_dir).select(*IDS, F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where("word RLIKE '^[a-z]+$'").groupBy("word").agg(F.count("*").alias("n")).where("n > 3")
    return entities.candidates(cased(spark, sf_dir), IDS, names(spark, sf_dir), plain)


def misspelt(spark, sf_dir) -> DataFrame:
    """Cues with words of one, two or three letters more, fewer or other."""
    said = """CASE WHEN pos % 5 = 0 THEN regexp_replace(initcap(text), '([a-z])e', '$1ee') WHEN pos % 5 = 1 THEN regexp_replace(initcap(text), 'th', 'd') WHEN pos % 5 = 2 THEN regexp_replace(text, '([a-z]{3})([a-z]{3})', '$1 $2')
        WHEN pos % 5 = 3 THEN regexp_replace(initcap(text), 'an', 'on') ELSE concat(replace(text, ' ', '-'), 'ly ') END"""
    return cues(spark, sf_dir).select(*IDS, F.expr(said).alias("text"))


def heard_names(spark, sf_dir):
    return similar.heard_as(misspelt(spark, sf_dir), IDS, names(spark, sf_dir))


def names_put_right(spark, sf_dir):
    known = names(spark, sf_dir)
    aliases = known.where("length(term) > 7").select(F.concat(F.substring("term", 1, 4), F.lit(" "), F.substring("term", 5, 40)).alias("term"), F.lower("term").alias("target"))
    out = entities.normalised(misspelt(spark, sf_dir), IDS, known, aliases)
    return out.withColumn("canonical", F.array_join("canonical", "|"))


def near_terms_ja(spark, sf_dir):
    rows, terms = _foreign(spark, sf_dir, "ja")
    return similar.nearly_in(rows, IDS, terms)


def audited_words(spark, sf_dir):
    """Words of three conversations or more that no benchmark text has, with the word of one that is most like each."""
    known = _terms(spark, sf_dir).where("NOT term RLIKE ' '")
    return similar.audited(cues(spark, sf_dir).select("track", "text"), known)


#: Job rows of the event table: a user is a job; numbers that repeat and go missing, progress, a worker that goes, ends.
JOBS = """concat('job', user_id) AS job, event_id + user_id % 3 - event_id % 4 AS seq, cast(ts AS timestamp) AS ts, cast(floor(event_id / 3000) AS int) AS generation,
    CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'completed' WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'queued' ELSE 'running' END AS status,
    event_type AS stage, cast(floor(value) AS double) AS progress, event_id % 6 <> 0 AS alive, props AS message"""


def jobs_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_columns(f"SELECT {JOBS}"))


def job_rows(spark, sf_dir) -> DataFrame:
    watch.prepare(spark)
    path = f"{sf_dir}/events.parquet"
    # a stream's path is a folder or a pattern
    return jobs_of(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]"))


def job_watch(spark, sf_dir):
    return watch.drained(watch.tail(job_rows(spark, sf_dir), silent_ms=12 * 3_600_000, keep_ms=20 * 86_400_000), carry.folder(spark, "watch"))


def job_changes(spark, sf_dir):
    rows = job_rows(spark, sf_dir)
    mark = watch.revision(status=F.col("status"), stage=F.col("stage"), progress=F.col("progress"), generation=F.col("generation"), updated_at=F.lit(""), next_event_seq=F.lit(0), archived=F.lit(False))
    records = rows.select("job", F.col("seq").alias("version"), (F.col("seq") % 13 == 0).alias("deleted"), "generation", F.col("ts").cast("string").alias("updated_at"), mark.alias("revision"))
    return watch.drained(watch.changes(records), carry.folder(spark, "changes"))


QUERIES = {f.__name__: f for f in (glossary_extract, glossary_extract_ja, glossary_extract_ko, entity_candidates, heard_names, names_put_right, near_terms_ja, audited_words, job_watch, job_changes)}



def _extract_sql(script: str, before: str) -> str:
    # a term's occurrences follow each other without overlap; what stands before it is part of the match
    return f"""{CUES}, {_TERMS}, texts AS (SELECT track, pos, translate(lower(text), '{LATIN}', '{SCRIPTS[script]}') AS text FROM cues),
        names AS (SELECT DISTINCT translate(term, '{LATIN}', '{SCRIPTS[script]}') AS term FROM k WHERE regexp_full_match(term, '[a-z]{{3,}}')),
        met AS (SELECT track, pos, term, len(regexp_extract_all(text, '{before}' || term)) AS times FROM texts JOIN names ON contains(text, term))
        SELECT track, pos, term, times FROM met WHERE times > 0 AND NOT EXISTS (SELECT 1 FROM met x WHERE x.track = met.track AND x.pos = met.pos AND x.times > 0 AND length(x.term) > length(met.term) AND contains(x.term, met.term))"""


SQL = {
    "glossary_extract_ja": _extract_sql("ja", ""),
    "glossary_extract_ko": _extract_sql("ko", "(?:^|[^가-힯])"),
    "audited_words": f"""{CUES}, {_TERMS}, n AS (SELECT DISTINCT lower(term) AS name FROM k WHERE NOT contains(term, ' ') AND term <> ''),
        s AS (SELECT word, count(*) AS files FROM (SELECT DISTINCT track, unnest(regexp_extract_all(lower(text), '[a-z]{{3,12}}')) AS word FROM cues) GROUP BY 1 HAVING count(*) >= 3),
        a AS (SELECT * FROM s WHERE word NOT IN (SELECT name FROM n)),
        l AS (SELECT word, name, 1 - levenshtein(word, name) / greatest(length(word), length(name))::DOUBLE AS alike FROM a JOIN n ON least(length(word), length(name)) >= 0.5 * greatest(length(word), length(name))),
        b AS (SELECT word, arg_min(name, (-alike, name)) AS match, max(alike) AS alike FROM l WHERE alike >= 0.6 - 1e-9 GROUP BY 1)
        SELECT word, files, match, round(alike, 3) AS similarity, CASE WHEN round(alike, 3) >= 0.75 THEN 'high' WHEN alike IS NOT NULL THEN 'medium' ELSE 'low' END AS band FROM a LEFT JOIN b USING (word)""",
}
