"""URL filters with DataFrame functions only.

A url becomes its host's suffixes crossed with its path's prefixes, of the label counts and lengths that occur among
the rules; a short prefix of each expression's digest meets the rules' in an equi-join, the full digest confirms, and
the longest rule wins.

Defined results: a null url, or one without ://, has empty host and path and gets the default verdict. Of fitting rules
the longest host and path together wins, then the longer host, then block over allow. Rules with a null part or an
empty host, and rules whose path is neither empty nor starts with a slash, fit nothing. Repeated rows stay repeated;
null ids are kept. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join uses.
SHORT = 8
#: Between host and path in what is digested: no host holds it.
APART = "/"
#: Rules up to this count (under 50 MB) are broadcast; more are joined by a shuffle, whose hot keys adaptive execution splits.
BROADCAST_RULES = 200_000


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a DataFrame."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("action", "host", "path"), r, strict=True)]) for r in rules]
    kind = "array<struct<action:string,host:string,path:string>>"
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows).cast(kind)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (null where none fits), verdict."""
    host, path = host_and_path(F.coalesce(F.col(f"`{url_col}`"), F.lit("")))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    clean = rules.select("action", F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).where("action is not null and r_host <> '' and (r_path = '' or startswith(r_path, '/'))")
    labels = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."))) + 1
    shape = clean.agg(F.count("*"), F.collect_set(labels(F.col("r_host"))), F.collect_set(F.length("r_path"))).first()
    counts, lengths = sorted(shape[1]), sorted(shape[2])
    suffixes = F.filter(F.array(*[F.when(labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in counts]), lambda s: s != "") if counts else F.array().cast("array<string>")
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda s: s.isNotNull()) if lengths else F.array().cast("array<string>")
    parts = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit(APART), p))))
    spread = urls.select("id", "host", "path", F.posexplode_outer(parts).alias("i", "part")).withColumn("digest", F.sha2("part", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("action"), F.concat("r_host", "r_path").alias("rule"))
    digest = F.sha2(F.concat(F.col("r_host"), F.lit(APART), F.col("r_path")), 256)
    listed = clean.distinct().select(F.substring(digest, 1, SHORT).alias("short"), F.struct(digest.alias("digest"), rank.alias("rank")).alias("r")).groupBy("short").agg(F.collect_list("r").alias("sharing"))
    listed = F.broadcast(listed) if shape[0] <= BROADCAST_RULES else listed.hint("merge")
    confirmed = F.array_max(F.transform(F.filter("sharing", lambda r: r["digest"] == F.col("digest")), lambda r: r["rank"]))
    found = spread.join(listed, "short", "left").withColumn("best", confirmed)
    first = F.when(F.coalesce(F.col("i"), F.lit(0)) == 0, 1).otherwise(0)  # once for each row of the input, also for repeated ones
    best = found.groupBy("id", "host", "path").agg(F.max("best").alias("best"), F.sum(first).cast("int").alias("n"))
    verdict = F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict")
    each = best.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    return each.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict)
