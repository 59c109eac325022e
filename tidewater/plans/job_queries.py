"""Queries over job-like tables: events as a job log (a user is a job), customers and orders as keyed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import rate
from ..operators import sets
from ..streaming import jobs


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def job_log_tail(spark, sf_dir):
    """The last 300 events of each kind's log."""
    return sets.keep_last(_t(spark, sf_dir, "events"), "event_type", "event_id").select("user_id", "event_id", "event_type")


def job_events_after(spark, sf_dir):
    return jobs.after(_t(spark, sf_dir, "events"), 100).select("event_id", "user_id", "event_type")


def job_last_activity(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "view", F.col("event_id"))).alias("last_event"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))


def job_sessions(spark, sf_dir):
    s = jobs.sessions(_t(spark, sf_dir, "events"), "12 hours")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return s.select("user_id", stamp("began"), stamp("silent_at"), "events")


def job_daily(spark, sf_dir):
    return jobs.daily(_t(spark, sf_dir, "events")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 1).alias("total"))


def batch_metrics(spark, sf_dir):
    """Per event type: totals, extremes and safe rates."""
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("largest"), F.max_by("event_id", F.struct("value", "event_id")).alias("largest_id"), rate(F.count_if(F.col("value") > 10), F.count("*")).alias("share_over_10"))


def glossary_stats(spark, sf_dir):
    """Counts of terms in all, by brand and by type in one pass of grouping sets."""
    _t(spark, sf_dir, "part").createOrReplaceTempView("tidewater_part")
    return spark.sql("SELECT p_brand, p_type, count(*) AS n FROM tidewater_part GROUP BY GROUPING SETS ((), (p_brand), (p_type))")


def store_upsert(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    o = _t(spark, sf_dir, "orders")
    changes = o.select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1_000_000).otherwise(0)).alias("c_custkey"), F.lit("edited").alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("seq"))
    return sets.upsert(c, changes, ["c_custkey"], "seq")


def snapshot_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    old = o.where("o_orderkey % 11 <> 0")
    new = o.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, "X").otherwise(F.col("o_orderstatus")))
    return sets.snapshot_diff(old, new, "o_orderkey", F.col("o_orderstatus"))


def risk_view(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    gen = o.select(F.col("o_orderkey").alias("key"), F.lit("pending").alias("state"), (F.col("o_orderkey") % 3 > 0).alias("review_required"))
    auto = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 4 == 0, "resolved").when(F.col("o_orderkey") % 10 == 2, "failed").otherwise("pending").alias("auto_state"))
    review = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("key"), F.lit("done").alias("review_state"), F.concat(F.lit(" "), "o_orderstatus").alias("review_text"))
    return sets.merged_view(gen, auto, review)


def id_differences(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), _t(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 2).alias("id"))
    return sets.id_differences(c, o, "id")


def risk_reasons(spark, sf_dir):
    """Histogram of distinct first words of order comments' priority, each row counted once a reason."""
    o = _t(spark, sf_dir, "orders").select(F.split("o_orderpriority", "-").alias("r"))
    return o.select(F.explode(F.array_distinct("r")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def seeded_selection(spark, sf_dir):
    return sets.seeded_order(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "7", 50)


QUERIES = {f.__name__: f for f in (job_log_tail, job_events_after, job_last_activity, job_sessions, job_daily, batch_metrics, glossary_stats, store_upsert, snapshot_diff, risk_view, id_differences, risk_reasons, seeded_selection)}

SQL = {
    "job_log_tail": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 300",
    "job_events_after": "SELECT event_id, user_id, event_type FROM events WHERE event_id > 100",
    "job_last_activity": "SELECT user_id, max(event_id) FILTER (event_type <> 'view') AS last_event, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "job_sessions": """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS began, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS silent_at, count(*) AS events FROM s GROUP BY user_id, n""",
    "job_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(round(sum(value), 2), 1) AS total FROM events GROUP BY 1, 2",
    "batch_metrics": "SELECT event_type, count(*) AS n, max(value) AS largest, arg_max(event_id, (value, event_id)) AS largest_id, round(count(*) FILTER (value > 10) / count(*), 6) AS share_over_10 FROM events GROUP BY 1",
    "glossary_stats": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((), (p_brand), (p_type))",
    "store_upsert": """WITH h AS (SELECT o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1000000 ELSE 0 END AS c_custkey, o_totalprice AS c_acctbal, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) = 1)
        SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM h) UNION ALL SELECT c_custkey, 'edited' AS c_name, c_acctbal FROM h""",
    "snapshot_diff": """WITH a AS (SELECT o_orderkey, o_orderstatus AS a FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS b FROM orders WHERE o_orderkey % 13 <> 0)
        SELECT o_orderkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE a IS DISTINCT FROM b""",
    "risk_view": """SELECT o_orderkey AS key, a AS automatic_state, CASE WHEN o_orderkey % 5 = 0 THEN 'done' WHEN a = 'resolved' THEN 'auto_resolved' WHEN a = 'failed' THEN 'review' WHEN o_orderkey % 3 = 0 THEN 'advisory' ELSE 'pending' END AS state,
        CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE '' END AS manual_text FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'resolved' WHEN o_orderkey % 10 = 2 THEN 'failed' ELSE 'pending' END AS a FROM orders)""",
    "id_differences": """WITH o AS (SELECT DISTINCT o_custkey + o_orderkey % 2 AS id FROM orders), c AS (SELECT DISTINCT c_custkey AS id FROM customer)
        SELECT id, 'missing' AS side FROM (SELECT id FROM c EXCEPT SELECT id FROM o) UNION ALL SELECT id, 'extra' AS side FROM (SELECT id FROM o EXCEPT SELECT id FROM c)""",
    "risk_reasons": "WITH r AS (SELECT unnest(list_distinct(string_split(o_orderpriority, '-'))) AS reason FROM orders) SELECT reason, count(*) AS n FROM r GROUP BY 1",
    "seeded_selection": "SELECT c_custkey FROM customer ORDER BY sha256('7:' || c_custkey::VARCHAR), c_custkey LIMIT 50",
}
