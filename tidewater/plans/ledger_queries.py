"""Queries over stores: envelopes written and read back with what can't be read, published groups, imported reviews; rows come from `orders` and `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import carry, reviews
from ..sources import published, stores


def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _risks(spark, sf_dir) -> DataFrame:
    o = _orders(spark, sf_dir)
    key = F.when(F.col("o_orderkey") % 97 == 5, "").otherwise(F.col("o_orderkey").cast("string"))
    return o.select((F.col("o_custkey") % 60).alias("file"), key.alias("key"), (F.col("o_orderkey") % 100).cast("int").alias("score"), F.split("o_orderpriority", "-").alias("reasons"), F.col("o_orderstatus").alias("severity"), (F.col("o_orderkey") % 3 == 0).alias("review_required"))


def written_envelopes(spark, sf_dir) -> str:
    """A folder of envelopes: some of another version, of another kind, cut off, with items of another form."""
    at = carry.folder(spark, "envelopes")
    whole = stores.envelopes(_risks(spark, sf_dir), "risk.generated", "file")
    text = F.expr("""CASE file % 20 WHEN 7 THEN replace(content, '"schema_version":2', '"schema_version":9') WHEN 11 THEN replace(content, 'risk.generated', 'review-state') WHEN 13 THEN substring(content, 1, length(content) - 9)
        WHEN 17 THEN replace(content, '"score":7', '"score":"high') ELSE content END""")
    text = F.when(F.col("file") % 20 == 17, F.regexp_replace("content", '"score":7([0-9]?),', '"score":"high$1",')).otherwise(text)
    whole.select("file", text.alias("value")).repartition(8, "file").write.partitionBy("file").text(at)
    return at


def store_items(spark, sf_dir):
    """Items of all envelopes, and by file what can't be read."""
    rows = stores.items(spark, written_envelopes(spark, sf_dir), "risk.generated")
    file = F.regexp_extract("file", "file=([0-9]+)", 1).cast("long")
    return rows.groupBy(file.alias("file"), F.coalesce("fault", F.lit("")).alias("fault")).agg(F.count("*").alias("rows"), F.sum("score").alias("score"), F.count_if("review_required").alias("required"), F.sum(F.size("reasons")).cast("long").alias("reasons"), F.max("severity").alias("severity"))


def published_orders(spark, sf_dir):
    """Orders by priority, published, published again as they are, and again with one priority changed and one gone: rows of the last commit, and which commit wrote each."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    store = published.Published(spark, carry.folder(spark, "published"), "o_orderkey long, o_orderstatus string, o_orderpriority string", "o_orderpriority")
    first = store.publish(o)
    again = store.publish(o.repartition(5))
    late = F.when(F.col("o_orderpriority").startswith("2"), "X").otherwise(F.col("o_orderstatus"))
    last = store.publish(o.where("NOT o_orderpriority LIKE '5%'").withColumn("o_orderstatus", late))
    before = store.manifest(first).select(F.col("group").alias("g"), F.col("folder").alias("f"))
    now = store.manifest(last).join(before, (F.col("group") == F.col("g")) & (F.col("folder") == F.col("f")), "left").select("group", F.when(F.col("f").isNull(), last).otherwise(first).alias("commit"))
    rows = store.read().groupBy(F.col("o_orderpriority").alias("group")).agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"), F.count_if(F.col("o_orderstatus") == "X").alias("changed"))
    return rows.join(now, "group").withColumn("idle", F.lit(again == first))


#: Entries, and reviews of them as they were seen: some stale, unknown, unsigned, undated, twice, done before.
ENTRIES = """doc_id::VARCHAR AS id, substr(text, 1, 40) AS canonical, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS gold, CASE WHEN doc_id % 4 = 0 THEN 'provisional' ELSE 'confirmed' END AS status,
    CASE WHEN doc_id % 13 = 0 THEN 'ann' ELSE '' END AS reviewer, CASE WHEN doc_id % 13 = 0 THEN 'seen' ELSE '' END AS evidence, CASE WHEN doc_id % 13 = 0 THEN '2024-05-01T10:00:00Z' ELSE '' END AS reviewed_at, '' AS notes"""
REVIEWS = """concat(CASE WHEN doc_id % 31 = 3 THEN 'no' ELSE '' END, doc_id::VARCHAR) AS id, CASE WHEN doc_id % 29 = 1 THEN 'fr' ELSE 'en' END AS language, concat(substr(text, 1, 40), CASE WHEN doc_id % 23 = 2 THEN '!' ELSE '' END) AS canonical,
    CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 19 = 4 THEN 'old' ELSE source END AS current_gold, CASE WHEN doc_id % 17 = 5 THEN 'draft' WHEN doc_id % 4 = 0 THEN 'provisional' ELSE 'confirmed' END AS status,
    CASE WHEN doc_id % 13 = 0 THEN 'keep' WHEN doc_id % 6 = 0 THEN 'Correct ' WHEN doc_id % 6 = 1 THEN 'keep' WHEN doc_id % 6 = 2 THEN 'reject' WHEN doc_id % 6 = 3 THEN 'skip' WHEN doc_id % 6 = 4 THEN '' ELSE 'maybe' END AS decision,
    CASE WHEN doc_id % 12 = 0 THEN 'gold' ELSE ' ' END AS corrected, CASE WHEN doc_id % 11 = 6 THEN ' ' ELSE 'ann' END AS reviewer, CASE WHEN doc_id % 37 = 7 THEN '' ELSE 'seen' END AS evidence,
    CASE WHEN doc_id % 41 = 8 THEN '2024-05-01 10:00' ELSE '2024-05-01T10:00:00Z' END AS reviewed_at, '' AS notes"""


def entries_and_reviews(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from .evidence_queries import _columns

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entries, rows = (d.selectExpr(*_columns(f"SELECT {x}".replace("::VARCHAR", "::string"))) for x in (ENTRIES, REVIEWS))
    return entries, rows.unionByName(rows.where("try_cast(id AS long) % 43 = 9"))


def review_import(spark, sf_dir):
    return reviews.imported(*entries_and_reviews(spark, sf_dir), "en")


QUERIES = {f.__name__: f for f in (store_items, published_orders, review_import)}
SQL = {
    "store_items": """WITH r AS (SELECT o_custkey % 60 AS file, o_orderkey AS k, o_orderkey % 100 AS score, len(string_split(o_orderpriority, '-')) AS reasons, o_orderstatus AS severity, o_orderkey % 3 = 0 AS required,
              CASE WHEN file % 20 = 7 THEN 'schema version 9' WHEN file % 20 = 11 THEN 'kind review-state' WHEN file % 20 = 13 THEN 'no JSON of this form' WHEN file % 20 = 17 AND (score = 7 OR score BETWEEN 70 AND 79) THEN 'no item of this kind' WHEN k % 97 = 5 THEN 'without key' ELSE '' END AS fault FROM orders)
        SELECT file, fault, CASE WHEN file % 20 IN (7, 11, 13) THEN 1 ELSE count(*) END AS rows, CASE WHEN fault = '' THEN sum(score)::BIGINT END AS score, CASE WHEN fault = '' THEN count(*) FILTER (required) ELSE 0 END AS required,
               CASE WHEN fault = '' THEN sum(reasons)::BIGINT END AS reasons, CASE WHEN fault = '' THEN max(severity) END AS severity FROM r GROUP BY file, fault""",
    "published_orders": """SELECT o_orderpriority AS "group", count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, CASE WHEN o_orderpriority LIKE '2%' THEN count(*) ELSE 0 END AS changed, CASE WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 1 END AS commit, true AS idle
        FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1""",
    "review_import": f"""WITH e AS (SELECT {ENTRIES} FROM documents), v AS (SELECT {REVIEWS} FROM documents), r0 AS (SELECT * FROM v UNION ALL SELECT * FROM v WHERE try_cast(id AS BIGINT) % 43 = 9),
        r AS (SELECT trim(id) AS id, language, coalesce(canonical, '') AS canonical, coalesce(current_gold, '') AS seen, trim(status) AS seen_status, lower(trim(decision)) AS decision, trim(corrected) AS corrected, trim(reviewer) AS signer, trim(evidence) AS ev, reviewed_at AS stamped, count(*) OVER (PARTITION BY id) AS times FROM r0),
        m AS (SELECT r.*, e.id IS NOT NULL AS known, coalesce(e.canonical, '') AS own, e.gold AS g, e.status AS s, e.reviewer AS er, e.evidence AS ee, e.reviewed_at AS ea, e.notes AS en, decision IN ('', 'skip') AS skips,
              CASE WHEN decision = 'correct' THEN corrected ELSE e.gold END AS ng, CASE WHEN decision = 'reject' THEN 'rejected' ELSE 'confirmed' END AS ns FROM r LEFT JOIN e ON e.id = r.id),
        w AS (SELECT *, coalesce(g, '') = coalesce(ng, '') AND s = ns AND er = signer AND ee = ev AND ea = stamped AS same FROM m),
        t AS (SELECT *, CASE WHEN times > 1 THEN 'duplicate review id' WHEN NOT known THEN 'unknown id' WHEN language <> 'en' THEN 'language mismatch' WHEN canonical <> own THEN 'stale canonical text' WHEN decision NOT IN ('correct', 'keep', 'reject', 'skip', '') THEN 'unknown decision'
              WHEN NOT skips AND signer = '' THEN 'reviewer is required' WHEN NOT skips AND ev = '' THEN 'evidence is required' WHEN NOT skips AND NOT contains(stamped, 'Z') THEN 'reviewed_at must be a time with its zone' WHEN NOT skips AND decision <> 'reject' AND coalesce(ng, '') = '' THEN 'no gold text'
              WHEN NOT skips AND NOT same AND seen_status <> s THEN 'stale status' WHEN NOT skips AND NOT same AND seen <> coalesce(g, '') THEN 'stale gold text' END AS reason FROM w),
        o AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN skips THEN 'skipped' WHEN same THEN 'already' ELSE 'applied' END AS outcome FROM t)
        SELECT id, outcome, reason, CASE WHEN outcome = 'applied' THEN ng ELSE CASE WHEN known THEN coalesce(g, '') END END AS gold, CASE WHEN outcome = 'applied' THEN ns ELSE s END AS status, CASE WHEN outcome = 'applied' THEN signer ELSE er END AS reviewer,
               CASE WHEN outcome = 'applied' THEN ev ELSE ee END AS evidence, CASE WHEN outcome = 'applied' THEN stamped ELSE ea END AS reviewed_at, CASE WHEN outcome = 'applied' THEN '' ELSE en END AS notes FROM o""",
}
