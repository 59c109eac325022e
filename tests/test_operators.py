"""Cases of the reference's own kind on small rows: strict parsing, streams, and that the package stands without its optional part."""

import pytest

from tidewater.sources import srt
from tidewater.streaming import jobs

DOC = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nBye\r\n\r\nlone\r\n"


def test_srt_scan(spark):
    got = srt.parse(spark.createDataFrame([("a", DOC)], "track string, content string")).orderBy("pos").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.text) for r in got] == [(1, 1000, 2500, "Hello\nthere"), (2, 3000, 4000, "Bye")]


def test_srt_malformed_block(spark):
    bad = spark.createDataFrame([("a", "1\n00:61:00,000 --> 00:00:02,000\nx")], "track string, content string")
    assert srt.parse(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="malformed block"):
        srt.parse(bad).collect()


def test_streamed_days_match_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    folder = tmp_path / "in"
    spark.read.parquet(path).repartition(3).write.parquet(str(folder))
    q = jobs.daily(jobs.stream(spark, str(folder)), late="400 days").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.events) for r in spark.table("days").collect()} == {(r.event_type, r.events) for r in jobs.daily(spark.read.parquet(path)).collect()}
