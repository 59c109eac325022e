"""Fixed cases of batches, reports and translation memory."""

from pyspark.sql import functions as F

from tidewater.functions import public as P
from tidewater.operators import manifest, memory

EDIT = "seq int, source string, previous string, final string, game string, language string, target string, error_type string, approve boolean"


def test_states_count_entries_into_running(spark):
    rows = [(1, 1, "running", None), (1, 2, "running", None), (1, 3, "failed", "x"), (1, 4, "running", None), (2, 1, "failed", "y"), (2, 2, "pending", None), (3, 1, "success", "kept")]
    got = {r.batch: (r.state, r.attempts, r.error) for r in manifest.states(spark.createDataFrame(rows, "batch int, seq int, state string, error string")).collect()}
    assert got == {1: ("running", 2, None), 2: ("pending", 0, "y"), 3: ("success", 0, "kept")}


def test_usable_results(spark):
    kind = "b int, state string, ids array<int>, results array<struct<id:int,translated:string>>"
    rows = [(1, "success", [1, 2], [(1, "a"), (2, "b")]), (2, "success", [1, 2], [(1, "a"), (2, " ")]), (3, "failed", [1], [(1, "a"), (1, "z"), (9, "x")]), (4, "success", [], [(5, "a")]), (5, "success", [1], None)]
    got = {r.b: (r.whole, [(x.id, x.translated) for x in r.partial]) for r in manifest.usable(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (True, [(1, "a"), (2, "b")]), 2: (False, [(1, "a")]), 3: (False, [(1, "z")]), 4: (True, [(5, "a")]), 5: (False, [])}


def test_residual_words(spark):
    df = spark.createDataFrame([("看 Violet 和 boss 的 DPS ab",), ("说abc",), (None,), ("wow Wow yeah META",)], "t string")
    assert [r.w for r in df.select(manifest.residual_words(F.col("t")).alias("w")).collect()] == [["Violet"], [], [], []]


def test_edits_merge(spark):
    first = [(1, " A  b", "old", "new", "", "en", "zh-CN", "", True), (2, "a b", "x", "new", "", "en", "zh-CN", "name", False), (3, "a b", "new", "new", "", "en", "zh-CN", "", False), (4, " ", "x", "y", "", "en", "zh-CN", "", False)]
    base = memory.entries_of(spark.createDataFrame(first, EDIT))
    (e,) = base.collect()
    assert (e.source, e.source_normalized, e.game, e.error_type, e.approved, e.seen_count) == ("a b", "a b", "default", "name", True, 2)
    later = spark.createDataFrame([(9, "A B", "p", "new", "default", "en", "zh-CN", None, False), (10, "あ", "", "啊", "g", "ja", "zh-CN", "x", None)], EDIT)
    got = sorted((r.source, r.seen_count, r.approved, r.created_seq, r.updated_seq) for r in memory.merge_edits(base, later).collect())
    assert got == [("A B", 3, True, 1, 9), ("あ", 1, False, 10, 10)]
    assert memory.merge_edits(base.limit(0), later.limit(0)).count() == 0
    assert memory.retained(memory.merge_edits(base, later), 1).count() == 1


def test_punctuation_and_pairs(spark):
    texts = ["Hello, World.", "3.14 is. ok", "!!", "a... b!? c", "  ", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.full_width(F.col("t")).alias("v")).collect()]
    assert got[:2] == ["Hello，World", "3.14 is。ok"] and got[4:] == ["  ", None]
    pair = spark.range(1).select(P.language_pair(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("a"), P.language_pair(F.lit("fr"), F.lit("zh-CN")).alias("b")).first()
    assert tuple(pair.a) == ("en", "zh-CN") and pair.b is None
