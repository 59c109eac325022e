from difflib import SequenceMatcher
from itertools import groupby

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tidewater.functions import text as X
from tidewater.operators import folds
from tidewater.plans import catalog, fold_queries
from tidewater.plans.cue_queries import cues

SF = "/root/testdata/sf0.01"
FOLDS = {"rolling_overlaps": folds.rolling_overlaps, "micro_cues": folds.micro_cues, "fragment_merge": folds.fragment_openings, "export_clean": folds.export_clean, "rolling_dedupe": folds.rolling_dedupe, "minimum_duration": folds.minimum_duration}


#: Tested in test_retime, test_entities, test_similar and test_watch.
ELSEWHERE = {"retimed_cues", "joined_recordings", "glossary_extract", "entity_candidates", "heard_names", "names_put_right", "near_terms_ja", "job_watch", "job_changes"}


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF)


def test_queries_without_sql_have_a_test_here():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {*FOLDS, "semantic_units", "source_union_nested", "text_conflicts", "misheard_names", "reading_rhythm", "shown_cues"} | ELSEWHERE


@pytest.fixture(scope="module")
def captions(spark):
    rows = sorted(tuple(r) for r in fold_queries._captions(spark, SF).collect())
    return {track: [r[1:] for r in own] for track, own in groupby(rows, key=lambda r: r[0])}


def told(track, made):
    return [(track, c.pos, c.start, c.end, c.text) for c in made]


@pytest.mark.parametrize("name", list(FOLDS))
def test_folds_over_whole_tracks(spark, captions, name):
    want = [row for track, own in captions.items() for row in told(track, FOLDS[name](iter([folds.Cue(*r) for r in own])))]
    assert sorted(tuple(r) for r in catalog.queries()[name](spark, SF).collect()) == sorted(want) and want


def test_semantic_units_over_whole_tracks(spark, captions):
    want = []
    for track, own in captions.items():
        joined = list(folds.fragment_openings(iter([folds.Cue(*r) for r in own])))
        lengths = sorted(max(0, c.end - c.start) for c in joined)
        middle = (lengths[(len(lengths) - 1) // 2] + lengths[len(lengths) // 2]) / 2
        for c in joined:
            c.extra = (middle <= 2500 and len(joined) > 1,)
        want += told(track, folds.semantic_units(iter(joined)))
    assert sorted(tuple(r) for r in catalog.queries()["semantic_units"](spark, SF).collect()) == sorted(want)


def test_text_conflicts_against_all_rows(spark):
    rows = sorted(tuple(r) for r in cues(spark, SF).select("track", "pos", "text", X.normalised(F.col("text"))).collect())
    norm = {r[2]: r[3] for r in rows}
    near = {t: n for t, n in zip(norm, spark.createDataFrame([(f"{t} {t[:9]}",) for t in norm], "t string").select(X.normalised(F.col("t"))).toPandas().iloc[:, 0], strict=True)}
    got = {(r.track, r.pos): r.conflict for r in catalog.queries()["text_conflicts"](spark, SF).collect()}
    for i, (track, pos, text, a) in enumerate(rows):
        after = rows[i + 1] if i + 1 < len(rows) and rows[i + 1][0] == track else None
        b = (after[3] if after else "") if pos % 2 == 0 else near[text]
        held = (a in b or b in a) and min(len(a), len(b)) / max(len(a), len(b), 1) >= 0.72
        assert got[track, pos] == bool(a and b and a != b and not held and SequenceMatcher(None, a, b).ratio() < 0.78)


def test_nested_cues_against_a_walk(spark):
    rows = {}
    for r in cues(spark, SF).where("end_ms > start_ms").collect():
        rows.setdefault(r.track, []).append([r.start_ms, r.end_ms + (9000 if r.pos % 5 == 0 else 0), r.pos, "" if r.pos % 3 == 0 else r.text, r.text if r.pos % 4 == 0 else ""])
    want = []
    for track, own in rows.items():
        kept = []
        for start, end, pos, first, second in sorted(own):
            over = next((k for k in kept if k[0] <= start and end <= k[1]), None)
            if over is None:
                kept.append([start, end, pos, first, second])
                continue
            said = (first or second).strip()
            if not said:
                continue
            main, side = over[3].strip(), over[4].strip()
            if not main:
                over[3], less = said, ""
            elif len(said) > len(main):
                over[3], less = said, main
            else:
                less = said
            if less and less not in side:
                over[4] = f"{side} {less}".strip()
            more = second.strip()
            if more and more not in over[4] and more != over[3]:
                over[4] = f"{over[4]} {more}".strip()
        want += [(track, k[2], k[3], k[4]) for k in kept]
    got = catalog.queries()["source_union_nested"](spark, SF).select("track", "pos", "primary_evidence", "secondary_evidence").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) < sum(map(len, rows.values()))
