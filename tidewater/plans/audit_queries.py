"""Queries over evidence stores: cues, documents as a memory, benchmark as held-out items, lineitem as usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit
from .cue_queries import _NORM, _WORDS, CUES, cues

#: Rates a million units, of the models that have one.
RATES = [("A", 0.15, 0.6), ("N", 2.5, 10.0)]


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def containment_pairs(spark, sf_dir):
    c = cues(spark, sf_dir).select("track", "pos", "start_ms", "end_ms").where("end_ms > start_ms")
    return audit.contained(c, c)


def adjacent_duplicates(spark, sf_dir):
    return audit.adjacent_repeats(_t(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type")).select("user_id", "event_id", "event_type")


def token_overlap_topk(spark, sf_dir):
    items, turns = _t(spark, sf_dir, "benchmark"), cues(spark, sf_dir)
    q = items.select(F.col("item_id").alias("id"), X.words(F.col("text")).alias("tokens"))
    m = turns.select((F.col("track") * 1000 + F.col("pos")).alias("id"), X.words(F.col("text")).alias("tokens"))
    return audit.closest_by_tokens(q, m, 5).withColumn("score", F.round("score", 6))


def leakage_audit(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").select("text")
    return audit.leaks(b, b.unionByName(_t(spark, sf_dir, "documents").select("text")), X.normalised(F.coalesce("text", F.lit(""))))


def duplicate_conflicts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "source")
    return audit.conflicts(d, ["lang", "digest"], "source")


def token_frequency_candidates(spark, sf_dir):
    known = _t(spark, sf_dir, "benchmark").select(F.explode(X.words(F.col("text"))).alias("token")).distinct()
    return audit.unknown_tokens(cues(spark, sf_dir), ["track", "pos"], X.words(F.col("text")), known, 3)


def model_cost(spark, sf_dir):
    use = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("sent"), F.sum("l_linenumber").alias("got"))
    rates = spark.createDataFrame(RATES, "model string, rate_in double, rate_out double")
    return audit.priced(use, rates, "l_returnflag", "sent", "got").withColumn("cost", F.round("cost", 6))


def ab_regression(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("k", F.concat_ws("|", "o_orderstatus", "o_orderpriority"))
    by = lambda keep: o.where(keep).groupBy("k").agg(F.max("o_totalprice").alias("top"))
    return audit.regressions(by("o_orderkey % 2 = 0 AND o_orderstatus <> 'P'"), by("o_orderkey % 2 = 1 AND o_orderpriority NOT LIKE '1%'"), "k", "top", higher_is_better=False)


def slowest_fastest(spark, sf_dir):
    """Of each return flag and line status the orders of the dearest and the cheapest line."""
    key, cost = F.struct("l_orderkey", "l_linenumber"), F.col("l_extendedprice")
    r = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.max(F.struct(cost, key.alias("k"))).alias("a"), F.min(F.struct(cost, key.alias("k"))).alias("b"))
    return r.select("l_returnflag", "l_linestatus", F.col("a.k.l_orderkey").alias("slowest"), F.col("b.k.l_orderkey").alias("fastest"), F.col("a.l_extendedprice").alias("most"), F.col("b.l_extendedprice").alias("least"))


QUERIES = {f.__name__: f for f in (containment_pairs, adjacent_duplicates, token_overlap_topk, leakage_audit, duplicate_conflicts, token_frequency_candidates, model_cost, ab_regression, slowest_fastest)}

_RATES = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in RATES)
SQL = {
    "containment_pairs": f"{CUES}, c AS (SELECT * FROM cues WHERE end_ms > start_ms) SELECT a.track, a.pos, b.pos AS inner_pos FROM c a JOIN c b ON a.track = b.track AND a.pos <> b.pos AND b.start_ms >= a.start_ms AND b.end_ms <= a.end_ms",
    "adjacent_duplicates": "SELECT user_id, event_id, event_type FROM events QUALIFY event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)",
    "token_overlap_topk": f"""{CUES}, q AS (SELECT item_id AS query_id, list_distinct({_WORDS.format('text')}) AS t FROM benchmark), m AS (SELECT track * 1000 + pos AS entry_id, list_distinct({_WORDS.format('text')}) AS t FROM cues),
        s AS (SELECT query_id, entry_id, len(list_intersect(q.t, m.t)) / greatest(len(q.t), len(m.t))::DOUBLE AS score FROM q JOIN m ON len(list_intersect(q.t, m.t)) > 0)
        SELECT query_id, entry_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id)::INTEGER AS place FROM s QUALIFY place <= 5""",
    "leakage_audit": f"""WITH b AS (SELECT {_NORM.format('text')} AS norm FROM benchmark), m AS (SELECT norm FROM b UNION ALL SELECT {_NORM.format("coalesce(text, '')")} FROM documents)
        SELECT norm, count(*) AS entries FROM m WHERE norm <> '' AND norm IN (SELECT norm FROM b) GROUP BY 1""",
    "duplicate_conflicts": """SELECT coalesce(lang, '?') AS lang, md5(coalesce(text, '')) AS digest, count(*) AS entries, count(DISTINCT source) AS "values", count(DISTINCT source) > 1 AS conflict FROM documents GROUP BY 1, 2 HAVING count(*) > 1""",
    "token_frequency_candidates": f"""{CUES}, k AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS token FROM benchmark), s AS (SELECT DISTINCT track, pos, unnest({_WORDS.format('text')}) AS token FROM cues)
        SELECT token, count(*) AS n FROM s WHERE token NOT IN (SELECT token FROM k) GROUP BY 1 HAVING count(*) >= 3""",
    "model_cost": f"""WITH r(model, rate_in, rate_out) AS (VALUES {_RATES}), u AS (SELECT l_returnflag, sum(l_quantity::BIGINT)::BIGINT AS sent, sum(l_linenumber)::BIGINT AS got FROM lineitem GROUP BY 1)
        SELECT l_returnflag, sent, got, round((sent * rate_in + got * rate_out) / 1000000, 6) AS cost, rate_in IS NOT NULL AS estimable FROM u LEFT JOIN r ON model = l_returnflag""",
    "ab_regression": """WITH o AS (SELECT *, o_orderstatus || '|' || o_orderpriority AS k FROM orders), a AS (SELECT k, max(o_totalprice) AS baseline FROM o WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P' GROUP BY 1),
        b AS (SELECT k, max(o_totalprice) AS candidate FROM o WHERE o_orderkey % 2 = 1 AND o_orderpriority NOT LIKE '1%' GROUP BY 1)
        SELECT k, baseline, candidate, CASE WHEN baseline IS NULL THEN 'new' WHEN candidate IS NULL THEN 'unobservable' WHEN candidate > baseline THEN 'regressed' WHEN candidate < baseline THEN 'improved' ELSE 'same' END AS outcome FROM a FULL JOIN b USING (k)""",
    "slowest_fastest": """SELECT l_returnflag, l_linestatus, arg_max(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS slowest, arg_min(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS fastest, max(l_extendedprice) AS most, min(l_extendedprice) AS least FROM lineitem GROUP BY 1, 2""",
}
