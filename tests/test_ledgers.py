"""Stores that are read with their faults, tables that are published whole, reviews that are imported once."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewater.operators import reviews
from tidewater.plans import ledger_queries as Q
from tidewater.sources import published, stores

SMALL = "/root/testdata/sf0.001"


def put(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


def test_items_and_faults(spark, tmp_path):
    at = tmp_path / "in"
    put(at, "a.json", '﻿{"schema_version": 2, "kind": "risk.generated", "items": [{"key": "k1", "score": 3, "reasons": ["x"], "other": {"a": 1}}, {"key": "k2", "score": "much"}, {"score": 1}, 7, null]}')
    put(at, "b.json", '{"schema_version": 1, "items": []}')
    put(at, "c.json", '{"schema_version": 2}')
    put(at, "d.json", "no json")
    put(at, "e.json", '{"schema_version": 2, "items": []}')
    put(at, "f.json", "")
    got = sorted((r.file.rsplit("/", 1)[1], str(r.place), str(r.key), str(r.score), str(r.fault)) for r in stores.items(spark, str(at), "risk.generated").collect())
    assert got[0] == ("a.json", "0", "k1", "3", "None") and [g[4] for g in got[1:5]] == ["no item of this kind", "without key", "no item of this kind", "no item of this kind"] or [g[4] for g in got[1:5]] == ["no item of this kind", "without key", "without key", "no item of this kind"]
    assert [(g[0], g[4]) for g in got[5:]] == [("b.json", "schema version 1"), ("c.json", "no items"), ("d.json", "no JSON of this form")]  # an empty file holds nothing
    assert stores.items(spark, str(tmp_path / "none"), "review-state").count() == 0


@pytest.mark.parametrize("kind", list(stores.KINDS))
def test_every_kind_reads_back(spark, tmp_path, kind):
    fields = [f.rsplit(" ", 1) for f in stores.KINDS[kind].schema.split(", ")]
    value = {"string": "s\"\n{é", "int": 3, "double": 0.5, "boolean": True, "array<string>": ["a", ""]}
    rows = spark.createDataFrame([(g, *[f"{value[t]}{i}" if t == "string" else value[t] for _, t in fields]) for g in (1, 2) for i in range(3)], "g int, " + stores.KINDS[kind].schema)
    stores.envelopes(rows, kind, "g").select("g", F.col("content").alias("value")).write.partitionBy("g").option("lineSep", "\x00").text(str(tmp_path / "out"))
    back = stores.items(spark, str(tmp_path / "out"), kind)
    assert back.where("fault IS NOT NULL").count() == 0
    names = [f for f, _ in fields]
    assert sorted(map(str, back.select(names).collect())) == sorted(map(str, rows.select(names).collect()))


def test_hearings_and_ids(spark, tmp_path):
    put(tmp_path / "h", "a.json", '{"gin gran": "Jingran", "": "x", "y": ""}')
    assert [tuple(r) for r in stores.hearings(spark, str(tmp_path / "h")).collect()] == [("gin gran", "Jingran")]
    for name, text in (("a", '["1", "2"]'), ("b", '{"ids": ["2", "3"]}'), ("c", "# all\n4 # four\n\n 5\r\n")):
        put(tmp_path / "i", name, text)
    assert sorted(r.id for r in stores.ids(spark, str(tmp_path / "i")).collect()) == ["1", "2", "3", "4", "5"]


SCHEMA = "g string, v long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_publication_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = published.Published(spark, str(tmp_path / "p"), SCHEMA, "g")
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert store.version() == 0 and store.read().count() == 0
    one = [("a", 1), ("a", 1), ("b", 2), (None, 9)]
    assert store.publish(frame(one)) == 1 and rows(store.read()) == one[:3]
    assert store.publish(frame(one[::-1])) == 1
    assert store.publish(frame([("a", 1), ("a", 1), ("b", 3), ("c", 4)])) == 2
    folders = {r.group: r.folder for r in store.manifest().collect()}
    assert folders["b"] == folders["c"] != folders["a"] == {r.group: r.folder for r in store.manifest(1).collect()}["a"]
    assert rows(store.read(1)) == one[:3] and rows(store.read()) == [("a", 1), ("a", 1), ("b", 3), ("c", 4)]
    # a write that dies before its last step
    with monkeypatch.context() as m:
        m.setattr(store, "_fs", lambda: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.publish(frame([("z", 0)]), start=0)
    assert store.version() == 2 and rows(store.read()) == [("a", 1), ("a", 1), ("b", 3), ("c", 4)]
    # two writers from one commit
    assert store.publish(frame([("a", 5)]), start=2) == 3
    with pytest.raises(Exception, match="(?i)exist"):
        store.publish(frame([("b", 6)]), start=2)
    assert rows(store.read()) == [("a", 5)]
    assert store.publish(frame([]).limit(0)) == 4 and store.read().count() == 0


def test_throttled_commits(spark, tmp_path):
    now = [0.0]
    store = published.Published(spark, str(tmp_path / "t"), SCHEMA, "g")
    out = published.Throttled(store, every=3, seconds=30, clock=lambda: now[0])
    batch = lambda *data: spark.createDataFrame(data, SCHEMA)
    assert not out.put(batch(("a", 1))) and not out.put(batch(("b", 1))) and store.version() == 0
    assert out.put(batch(("a", 2), ("c", 1))) and rows(store.read()) == [("a", 2), ("b", 1), ("c", 1)]
    assert out.put(batch(("b", 7)), "failed") and store.version() == 2
    now[0] = 31.0
    assert out.put(batch(("b", 7))) and store.version() == 2
    assert not out.put(batch(("d", 1))) and out.flush() == 3 and out.flush() == 3 and len(rows(store.read())) == 4


def test_a_second_import_changes_nothing(spark):
    entries, given = Q.entries_and_reviews(spark, SMALL)
    told = reviews.imported(entries, given, "en")
    before = {(r.outcome): r["rows"] for r in reviews.totals(told).groupBy("outcome").agg(F.sum("rows").alias("rows")).collect()}
    assert before["applied"] > 10 and sum(before.values()) == given.count()
    after = reviews.merged(entries, told)
    assert after.columns == entries.columns and after.count() == entries.count()
    again = reviews.imported(after, given, "en")
    second = {r.outcome: r["rows"] for r in reviews.totals(again).groupBy("outcome").agg(F.sum("rows").alias("rows")).collect()}
    assert second.get("applied", 0) == 0 and second["already"] == before["applied"] + before.get("already", 0)
    assert rows(reviews.merged(after, again).na.fill("")) == rows(after.na.fill(""))
    assert reviews.imported(entries, given.limit(0), "en").count() == 0
