"""The training-data operators: against SQL, against brute force, and on edge cases."""

import hashlib
import zlib
from functools import partial

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from tidewater.llm import bpe_chunks, bpe_words, components, exact_dedup, language_id, minhash_dedup, mixing, queries, shared, token_files, topk_search, toxicity, url_filter, warc
from tidewater.llm.bpe_words import default_path, encoder

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, block string"
LONG = "wörd <|endoftext|> " * 3000
ROWS = [
    (1, "a b c d e f g", "en", "src0", 1, "x", "y"), (2, "a b c d e f g", None, None, None, None, None), (2, "a b c d e f g", None, None, None, None, None),
    (3, None, "en", "src1", 0, None, None), (4, "", "de", "src1", 0, None, None), (None, "null id", "en", "src2", 7, None, None), (None, None, None, None, None, None, None),
    (5, LONG, "fr", "other", len(LONG), None, None), (6, LONG, "fr", "src3", len(LONG), None, None), (7, " \t\n", "es", "src3", 3, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL)


def test_bpe_is_exact(spark):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    enc = encoder(default_path())
    for r in queries.op4_bpe(spark, SMALL).collect():
        ids = enc.exactly([texts[r.doc_id]])[0]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(enc.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edge_cases(odd, none):
    enc = encoder(default_path())
    got = sorted((r.n_tokens, r.ids) for r in bpe_chunks.encode(odd, output=("n_tokens", "ids")).collect())
    want = [enc.exactly([t or ""])[0] for _, t, *_ in ROWS]
    assert got == sorted((len(w), bytearray(np.array(w, "<u4").tobytes())) for w in want)
    assert bpe_chunks.encode(none).count() == 0


def test_bpe_joins_with_runs_of_space(spark):
    enc, rng = encoder(default_path()), np.random.default_rng(11)
    kinds = ["a\n\nb one  two the the the the ", "\n\n the\t \r\nthe  ", "the the the the the the", "x  y", "\n \n", "é\xa0\u2028\x85  ÉE\u0301 's <|endoftext|>  "]
    apart = 0
    for _ in range(400):
        text = "".join(kinds[i] for i in rng.integers(0, len(kinds), rng.integers(1, 12)))
        at = [0, *sorted({int(x) for x in rng.integers(1, len(text), rng.integers(1, 5))}), len(text)]
        chunks = [text[a:b].encode() for a, b in zip(at, at[1:])]
        coded = bpe_chunks._encoded(enc, chunks)
        assert bpe_chunks.join_chunks(enc, chunks, coded).tolist() == enc.exactly([text])[0], chunks
        apart += any(a[-2:] in (b"\n\n", b"  ") or b[:2] in (b"\n\n", b"  ") for a, b in zip(chunks, chunks[1:]))
    assert apart > 50
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 50, 9)) for _ in range(400)]
    texts = ["\n\n".join(lines), "  ".join(lines[:300]) + " \t\n" * 400, "\r\n\r\n".join(lines[100:]), "new " + "\n\n".join(lines)]
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in bpe_chunks.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), output=("n_tokens", "ids")).collect()}
    want = [enc.exactly([t])[0] for t in texts]
    assert got == {i: (len(w), np.array(w, "<u4").tobytes()) for i, w in enumerate(want)}


def test_cuts_follow_content():
    body = np.frombuffer(("lorem ipsum dolor " * 900 + "sit amet " * 400).encode(), np.uint8)
    rng = np.random.default_rng(3).integers(97, 123, 20_000).astype(np.uint8)
    a, b = bpe_chunks.cuts(rng), bpe_chunks.cuts(np.concatenate([rng[:100], rng]))
    assert len({bpe_chunks.digest(rng[s:e].tobytes()) for s, e in zip([0, *a], a)} & {bpe_chunks.digest(np.concatenate([rng[:100], rng])[s:e].tobytes()) for s, e in zip([0, *b], b)}) >= len(a) - 2
    assert bpe_chunks.cuts(body)[-1] == len(body)


def test_token_files(spark, odd, none):
    enc = encoder(default_path())
    rows = sorted(queries.table(spark, SMALL, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op8_token_files(spark, SMALL).collect()}
    at = 0
    for r in rows:
        ids = [*enc.exactly([r.text or ""])[0], 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    back = token_files.read(token_files.write(odd)).collect()
    assert sorted(str(r.doc_id) for r in back) == sorted(str(r[0]) for r in ROWS)
    assert sum(r.n_tokens for r in back) == sum(len(enc.exactly([t or ""])[0]) + 1 for _, t, *_ in ROWS)
    assert token_files.read(token_files.write(none)).count() == 0


def test_exact_dedup_edge_cases(odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(odd, counters=2).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (3, 4, 3, False), (4, 4, 3, True), (None, None, 1, True), (None, 4, 3, False), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True)} == got
    left = exact_dedup.survivors(odd)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "4", "6", "7", "None"]
    assert exact_dedup.decide(none).count() == exact_dedup.survivors(none).count() == 0


def test_near_dedup_edge_cases(odd, none):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.decide(odd).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 3, True), (5, 5, True), (6, 5, False), (7, 7, True)} <= got
    left = minhash_dedup.survivors(odd)
    assert left.columns == odd.columns and sorted(str(r.doc_id) for r in left.collect() if r.doc_id) == ["1", "3", "4", "5", "7"]
    assert minhash_dedup.decide(none).count() == 0


def test_near_dedup_keeps_one_of_null_or_repeated_ids(spark):
    base = {k: " ".join(f"{k}{i}" for i in range(80)) for k in "abcd"}
    ids = {"a": (None, None, None), "b": (7, 7, 9), "c": (None, 4, None), "d": (3, 2, 2)}
    docs = spark.createDataFrame([(i, f"{base[k]} end{n}") for k, own in ids.items() for n, i in enumerate(own)] + [(None, " "), (None, None), (8, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), (r.text or " ")[:1]) for r in minhash_dedup.survivors(docs).collect())
    assert got == [("2", "d"), ("4", "c"), ("7", "b"), ("8", " "), ("None", " "), ("None", " "), ("None", "a")]


def test_url_edge_cases(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.ORG/es/x"), (1, "http://A.Example.ORG/es/x"), (2, None), (None, "no scheme"), (3, "x://org"), (4, "x://example.org/en/123?q"), (5, "x://notexample.org/es/")], "page_id long, url string")
    rules = url_filter.rules_frame(spark, queries.RULES)
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect())
    assert got == sorted([("1", "example.org/es/", "block")] * 2 + [("2", None, "allow"), ("None", None, "allow"), ("3", None, "allow"), ("4", "example.org/en/1", "block"), ("5", "org/", "allow")])
    assert url_filter.judge(pages.limit(0), rules).count() == 0 and url_filter.judge(pages, rules.limit(0)).count() == 7


def test_toxicity(spark, odd, none):
    docs, labels = queries.table(spark, MID.replace("0.01", "0.1"), "documents"), queries.table(spark, MID.replace("0.01", "0.1"), "labels")
    model = queries.toxicity_model(docs, labels)
    r = toxicity.score(docs, model).join(labels, "doc_id").where(queries.fold("doc_id", 3) == 1).select("score", "toxic").toPandas()
    bad, good = r[r.toxic == 1].score.to_numpy(), r[r.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None]).mean() > 0.95 and (good >= 0.7).mean() < 0.01
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(ROWS)
    empty = toxicity.fit(none, labels.limit(0), F.lit(True))
    assert toxicity.score(odd, empty).count() == len(ROWS) and toxicity.score(none, model).count() == 0


def test_toxicity_sums_over_partitions(spark):
    """Counts, loss and gradient of the written sample against dense ones; the minimiser against Newton's steps."""
    texts = [("you are a moron and a clown", 1), ("moron!", 1), ("a nice day", 0), ("the clown is nice", 0), ("", 0), ("day by day by day", 0), ("moron", 1)] * 5
    rows = spark.createDataFrame(texts, "text string, toxic int").repartition(4)
    held = rows.mapInArrow(toxicity._rows, "grams binary, toxic int")
    n, y = 1 << toxicity.BITS, np.array([t for _, t in texts], float)
    x = np.zeros((len(texts), n), np.float32)
    for i, (t, _) in enumerate(texts):
        x[i, np.unique(toxicity.hashes(t)).astype(int)] = 1
    clean, toxic = x[y == 0].sum(axis=0), x[y == 1].sum(axis=0)
    counts = held.mapInArrow(toxicity._count, "gram long, clean long, toxic long").groupBy("gram").sum("clean", "toxic").toPandas()
    assert {(int(a), int(b), int(c)) for a, b, c in counts.itertuples(index=False)} == {(g, int(clean[g]), int(toxic[g])) for g in np.flatnonzero(clean + toxic)}
    ratio = toxicity.ratios(clean.astype(float), toxic.astype(float))
    assert (ratio[(clean == 0) & (toxic == 0)] == 0).all() and ratio[(clean == 0) & (toxic > 0)].min() > 0 > ratio[(clean > 0) & (toxic == 0)].max()
    w, b, share = np.random.default_rng(1).normal(0, 0.3, n), 0.2, (0.5 / (y == 0).sum(), 0.5 / (y == 1).sum())
    parts = held.mapInArrow(toxicity._slope(w, b, share), "loss double, bias double, slope binary").collect()
    z, each = x.astype(float) @ w + b, np.where(y == 1, share[1], share[0])
    err = each * (1 / (1 + np.exp(-z)) - y)
    np.testing.assert_allclose(sum(p.loss for p in parts), (each * (np.log1p(np.exp(z)) - y * z)).sum(), rtol=1e-9)
    np.testing.assert_allclose(sum(np.frombuffer(p.slope) for p in parts), x.T.astype(float) @ err, atol=1e-9)
    some = np.flatnonzero(clean + toxic)
    f = np.hstack([x[:, some] * ratio[some], np.ones((len(y), 1))]).astype(float)
    decay = np.append(np.full(len(some), 1e-2), 0.0)

    def slope(v):
        p = f @ v
        return float((each * (np.logaddexp(0, p) - y * p)).sum() + decay @ v**2 / 2), f.T @ (each * (1 / (1 + np.exp(-p)) - y)) + decay * v

    newton = np.zeros(f.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-f @ newton))
        newton -= np.linalg.solve(f.T @ (f * (each * p * (1 - p))[:, None]) + np.diag(decay) + 1e-12 * np.eye(len(newton)), slope(newton)[1])
    np.testing.assert_allclose(toxicity.least(slope, f.shape[1], steps=400), newton, atol=1e-3)


def test_toxicity_is_alike_under_other_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "least", partial(toxicity.least, steps=3))
    docs, labels = queries.table(spark, MID, "documents"), queries.table(spark, MID, "labels")
    a, b = (toxicity.fit(docs.repartition(k), labels, queries.fold("doc_id", 3) != 1) for k in (2, 5))
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-5)
    clash = docs.withColumns({"score": F.lit(1), "toxic": F.lit("x"), "grams": F.lit(2)})
    assert toxicity.score(clash, a).columns == ["doc_id", "score"] and toxicity.accepted(clash, a).columns == clash.columns


def test_language_id(spark, odd, none):
    docs = queries.table(spark, MID, "documents")
    got = queries.op10_language_id(spark, MID).join(docs, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() > 0.97 * got.count()
    model = language_id.fit(docs, queries.fold("doc_id", 4) != 2)
    r = {x.doc_id: x for x in language_id.predict(odd, model).collect()}
    assert r[3].lang_pred == r[4].lang_pred == r[7].lang_pred == "und" and r[5].lang_pred != "und"
    assert language_id.predict(none, model).count() == 0
    assert {x.lang_pred for x in language_id.predict(odd, language_id.fit(none, F.lit(True))).collect()} == {"und"}


def test_mixing(spark, odd, none):
    weights = {"a": 5, "b": 3, "c": 1}
    total, slots = 10, mixing.period(weights | {"*": 1})
    assert sorted(x for s in slots.values() for x in s) == list(range(total))
    for s, w in (weights | {"*": 1}).items():
        assert all(abs(sum(x < t for x in slots[s]) - t * w / total) < 1 for t in range(total + 1))
    got = mixing.arrange(odd, weights, block_size=2, prefix="mix_")
    assert got.count() == len(ROWS) and got.select("mix_slot", "mix_place").distinct().count() == len(ROWS)
    assert mixing.in_order(odd, weights).columns == odd.columns and mixing.in_order(none, weights).count() == 0
    mixed = queries.op7_mixing(spark, MID).collect()
    assert len(mixed) == 1000 and len({(r.slot, r.place) for r in mixed}) == 1000


def test_topk_edge_cases(spark):
    rows = [(0, [1.0, 0.5]), (0, [0.5, 0.5]), (20, [float("nan"), 1.0]), (40, None), (60, [None, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0]), (3, [1.0]), (80, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(df, F.col("vec_id") % 20 == 0, k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 4096), (0, 1, 1, 6144), (0, 2, 2, 4096), (0, 2, 2, 6144)]
    assert topk_search.search(df.limit(0), F.lit(True)).count() == 0


def test_search_block_proof():
    rng = np.random.default_rng(5)
    v, ids = rng.integers(-300, 300, (700, 16)), np.arange(700)
    v[:5] *= 50
    block = topk_search.build(ids, v)
    assert block.ends[-1] == len(block.postings) == (v != 0).sum()
    q_at, v_at, score, read = topk_search.search_block(ids[:40], v[:40], block, 9, np.full(40, -(1 << 62)))
    assert 0 < read <= len(block.postings)
    for i in range(40):
        want = sorted(((-int(v[i] @ v[j]), j) for j in range(700) if j != i))[:9]
        assert [(-int(s), int(j)) for a, j, s in zip(q_at, v_at, score) if a == i] == want


def test_search_reads_fewer_postings_than_it_holds():
    """Impacts as they fall off in practice: few large, many small; most postings stay unread, results are those of all."""
    rng = np.random.default_rng(6)
    v, ids = np.rint(rng.standard_normal((900, 48)) * 2).astype(np.int64), np.arange(900)
    v[np.arange(900), rng.integers(0, 48, 900)] = rng.integers(200, 4000, 900)
    block = topk_search.build(ids, v)
    q_at, v_at, score, read = topk_search.search_block(ids[:20], v[:20], block, 5, np.full(20, -(1 << 62)))
    assert read < 0.5 * len(block.postings)
    for i in range(20):
        want = sorted((-int(v[i] @ v[j]), j) for j in range(900) if j != i)[:5]
        assert [(-int(s), int(j)) for a, j, s in zip(q_at, v_at, score) if a == i] == want
    assert topk_search.search_block(ids[:20], v[:20], block, 5, np.full(20, 1 << 40))[3] == 0


def test_topk_over_several_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_ROWS", 7)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 2)
    rng = np.random.default_rng(8)
    v = rng.integers(-2, 3, (60, 4))
    v[30:] = v[:30]
    df = spark.createDataFrame([(i, [float(x) for x in r], i, "x") for i, r in enumerate(v)], "vec_id long, embedding array<double>, score long, block string")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search(df, F.col("vec_id") % 5 == 0, k=6).collect()]
    want = [(q, n + 1, j, -s) for q in range(0, 60, 5) for n, (s, j) in enumerate(sorted((-int(64 * 64 * (v[q] @ v[j])), j) for j in range(60) if j != q)[:6])]
    assert sorted(got) == sorted(want)


def test_few_edges_are_one_round(spark, monkeypatch):
    """A path of 500 nodes, out of order: one task joins it; dealt over many tasks it takes more rounds and has the same labels."""
    edges = spark.createDataFrame([((i * 37) % 500, ((i + 1) * 37) % 500) for i in range(499)], "u long, v long")
    rounds = []
    monkeypatch.setattr(components, "cut", lambda df: rounds.append(df.columns) or shared.cut(df))
    got = sorted(tuple(r) for r in components.components(edges).collect())
    assert got == [(i, 0) for i in range(1, 500)] and len(rounds) == 1
    monkeypatch.setattr(components, "SHARE", 50)
    assert sorted(tuple(r) for r in components.components(edges).collect()) == got and len(rounds) > 3


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, i) for i in range(500, 700)] + [(i, i + 1) for i in range(2000, 2200)] + [(3, 3), (None, 5), (5, None)]
    parent = list(range(3000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    nodes = {x for e in edges if None not in e for x in e}
    df = spark.createDataFrame(edges + edges[:50], "u long, v long")
    got = [(r.u, r.component) for r in components.components(df).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in nodes if find(x) != x)
    components.CHUNK, before = 7, components.CHUNK
    assert sorted((r.u, r.component) for r in components.components(df.coalesce(1)).collect()) == sorted(got)
    components.CHUNK = before
    assert components.components(df.limit(0)).count() == 0


def test_bpe_remembers_what_comes_again(monkeypatch):
    """Words that come once take no memory of a worker, those that come again take no more than the bounds; ids are the library's."""
    enc, rng = bpe_words.Encoder(default_path()), np.random.default_rng(3)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 9))
    common = [word() for _ in range(100)]
    texts = [" ".join([*common, *(word() for _ in range(900)), "Été <|endoftext|>x 's"]) for _ in range(12)]

    def check(some):
        ids, ends = enc.encode(pa.array(some, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == enc.exactly(some)

    for t in texts:
        check([t])
    assert set(common) <= set(enc.units) and len(enc.units) < 250  # some of the 10,800 may share a mark
    monkeypatch.setattr(bpe_words, "MOST_UNITS", 1000)
    for t in (*texts, *texts):
        check([t, t[:500]])
    assert len(enc.units) == 1000
    monkeypatch.setattr(bpe_words, "MOST_UNITS", 5000)
    monkeypatch.setattr(bpe_words, "MOST_BYTES", enc.bytes)
    check(texts)
    assert len(enc.units) == 1000


def test_toxicity_filter_takes_few_texts_at_a_time(spark):
    class Model:
        def score(self, texts):
            assert sum(map(len, texts)) <= shared_bytes
            return np.array([float(t[0] == "x") for t in texts])

    shared_bytes = shared.SLICE_BYTES
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 4 == 0, "x").otherwise("y"), F.repeat(F.lit("abcde "), 50_000)).alias("text"))
    kept = toxicity.accepted(docs, Model())
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [i for i in range(40) if i % 4]
    assert kept.where("length(text) = 300001").count() == 30


def test_bpe_with_another_tokenizer(spark):
    path = default_path().replace("word_bpe_49k", "byte_bpe_50k")
    enc, rng = encoder(path), np.random.default_rng(2)
    texts = [" ".join(f"w{x} é" for x in rng.integers(0, 500, n)) for n in (0, 3, 4000, 9000)]
    texts.append(texts[2] + "  \n" + texts[2])
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in bpe_chunks.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path=path, output=("n_tokens", "ids", "decoded")).collect()}
    want = [enc.exactly([t])[0] for t in texts]
    assert got == {i: (len(w), np.array(w, "<u4").tobytes(), enc.tokenizer.decode(w, skip_special_tokens=False)) for i, w in enumerate(want)}


def test_url_rules_that_fit_nothing(spark):
    rules = url_filter.rules_frame(spark, [("block", "org", "x"), ("allow", "net", ""), ("block", "", "/a"), ("block", None, "/a"), ("block", "com", None)])
    pages = spark.createDataFrame([(1, "h://orgx/", "r"), (2, "h://a.net/x", "r"), (3, "h://com/a", "r"), (4, "h://" + "a." * 500 + "org/" + "x/" * 50_000, "r"), (5, "h://org", None)], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules, default="allow").collect()}
    assert got == {1: (None, "allow"), 2: ("net", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_mixing_against_a_plain_schedule(spark):
    """Production weights: block, slot and place of every row against a schedule made source by source, and the one-block bound."""
    docs = queries.table(spark, MID.replace("0.01", "0.1"), "documents").select("doc_id", "source", "text")
    shares = {**queries.WEIGHTS, mixing.POOL: queries.OTHER_WEIGHT}
    total, own = sum(shares.values()), {}
    for r in docs.select("doc_id", "source").collect():
        own.setdefault(r.source if r.source in queries.WEIGHTS else mixing.POOL, []).append(r.doc_id)
    want, slots, blocks = {}, {}, max(len(x) for x in own.values()) // 4 + 1
    due = sorted((-(-j * total // w), s, j) for s, w in shares.items() for j in range(1, min(blocks, 4 * w) + 1))
    for t in range(4 * total):  # earliest deadline of the released blocks
        pick = next(x for x in due if (x[2] - 1) * total // shares[x[1]] <= t)
        due.remove(pick)
        slots[pick[1], pick[2] - 1] = t
    for s, ids in own.items():
        for n, i in enumerate(sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))):
            want[i] = (n // 4, slots.get((s, n // 4)), n % 4)
    got = {r.doc_id: (r.block, r.slot, r.place) for r in mixing.arrange(docs, queries.WEIGHTS, queries.OTHER_WEIGHT, 4).collect()}
    assert len(got) == len(want) and all(got[i][0] == b and got[i][2] == p and (t is None or got[i][1] == t) for i, (b, t, p) in want.items())
    assert sum(t is not None for _, t, _ in want.values()) > 1000


def test_mixing_with_clashing_columns(spark, odd):
    clash = odd.withColumns({"slot": F.lit(7), "__n": F.lit("n"), "__Cell": F.lit(None).cast("int")})
    got = mixing.arrange(clash, {"src0": 2, "src3": 1}, block_size=2)
    assert got.columns == [*clash.columns, "_block", "_slot", "place"] and got.where("slot = 7").count() == len(ROWS)
    assert mixing.in_order(clash, {"src0": 2}).columns == clash.columns
    assert minhash_dedup.survivors(odd.withColumn("__row_key", F.lit(1))).columns == [*odd.columns, "__row_key"]
    assert exact_dedup.survivors(odd.withColumn("__row_key", F.lit(1))).columns == [*odd.columns, "__row_key"]


def test_null_ids_are_held_out_of_nothing(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op3_toxicity", "op10_language_id"):
        got = queries.queries()[name](spark, str(tmp_path)).collect()
        assert len(got) == len(ROWS) and all(isinstance(r.held_out, bool) for r in got)


def test_warc_edge_cases(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a\nb", "same"), (2, None, "same"), (2, None, "same"), (None, "http://x.org/", "same"), (3, "http://b.org/?q#f", None), (4, "http://a.org", "é" * 50_000)], "page_id long, url string, html string")
    got = warc.read(warc.write(pages)).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted([("1", 4, "revisit", 2), ("2", 4, "response", None), ("2", 4, "response", None), ("None", 4, "revisit", 2), ("3", 0, "response", None), ("4", 100_000, "response", None)])
    archive = warc.write(pages)
    keys = [(r.url_key, r.ts) for r in archive.index.collect()]
    assert keys == sorted(keys) and warc.read(warc.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted((int(x),) for x in rng.integers(0, 9, rng.integers(0, 12))) for _ in range(k)]
    out = [runs[r][i] for r, i in warc.merge(runs)]
    assert out == sorted(x for r in runs for x in r)


def test_pipeline(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == odd.columns
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SMALL, "documents").collect()}
    got = [r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and len({texts[i] for i in got}) == len(got)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_returns_the_schedule(spark, odd, none, monkeypatch):
    monkeypatch.setattr(queries, "BLOCK_SIZE", 2)
    docs = queries.table(spark, MID, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src19").otherwise(F.col("source")))
    got = corpus_pipeline.encode(spark, docs, MID).collect()
    assert [(r.slot, r.place) for r in got] == sorted({(r.slot, r.place) for r in got}) and len(got) == docs.count()
    shares = {**queries.WEIGHTS, "*": queries.OTHER_WEIGHT}
    total, source = sum(shares.values()), {r.doc_id: r.source if r.source in shares else "*" for r in docs.select("doc_id", "source").collect()}
    held = {r.slot: source[r.doc_id] for r in got}
    assert all(held[r.slot] == source[r.doc_id] for r in got)
    full = next(t for t in range(len(got)) if t not in held)
    assert full > 50
    for t in range(full + 1):
        for s, w in shares.items():
            assert abs(sum(held[x] == s for x in range(t)) - t * w / total) < 1
    again = corpus_pipeline.encode(spark, odd, SMALL).collect()
    assert sorted(str(r.doc_id) for r in again) == sorted(str(r[0]) for r in ROWS) and len({(r.slot, r.place) for r in again}) == len(ROWS)
    assert corpus_pipeline.encode(spark, none, SMALL).count() == 0
