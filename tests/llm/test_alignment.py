"""Cross-tokenizer alignment against a plain computation over whole texts with the two libraries."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewater.llm import alignment, queries

SMALL = "/root/testdata/sf0.001"
LONG = "wörd <|endoftext|> " * 3000
TEXTS = [
    "a b c d e f g", "a b c d e f g", None, "", "  two  spaces \n\n new\tline  ", " ", "\n", "a▁b c", "▁", "é́ ﬁ \xa0z　全角 かな 한국어 👩‍👩‍👧 x", "<s> </s> <unk> <0x41> <|endoftext|>",
    "a\x1c b\x85 c d \x00 e", "don't we'll  it 's 12345 67,890.12 -- ... !!", "x" * 5000, LONG, "word " * 400, "a\n b\r\n c", "e᠎ f g​ h", "aḀ̶ zalgo ḀḀ", "a ▁ b", "a ▁b", " a", "a ",
]


def level() -> dict[str, int]:
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {**{chr(b): b for b in shown}, **{chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}}


def brute(texts: list[str | None]) -> list[tuple]:
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens, byte = True, level()
    made = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            made.append(None)
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in raw]).tolist(), range(1, len(raw) + 1))) for raw in (raw_a, raw_b)]
        both = sorted(ends[0].keys() & ends[1].keys())
        cut = [(0, 0), *((ends[0][e], ends[1][e]) for e in both)]
        groups = ";".join(f"{','.join(map(str, ids_a[i:k]))}|{','.join(map(str, ids_b[j:m]))}" for (i, j), (k, m) in zip(cut, cut[1:]))
        made.append((len(ids_a), len(ids_b), len(both), [(ids_a[i - 1], ids_b[j - 1]) for i, j in cut[1:]], hashlib.sha256(groups.encode()).hexdigest()))
    count = Counter(x for m in made if m for x in m[3])
    most: dict[int, int] = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    return [(m[0], m[1], m[2], len(m[3]), sum(count[x] == most[x[1]] for x in m[3]), sum(count[x] for x in m[3]), m[4]) if m else (0, 0, 0, 0, 0, 0, "") for m in made]


def found(df) -> list[tuple]:
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def test_alignment_of_a_table(spark):
    rows = queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert sorted(found(queries.op12_alignment(spark, SMALL))) == sorted((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows])))


@pytest.mark.parametrize("partitions", [1, 5])
def test_alignment_edge_cases(spark, partitions):
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a string, block long").repartition(partitions)
    want = sorted((str(i if i % 7 else None), *w) for i, w in enumerate(brute(TEXTS)))
    assert sorted((str(r[0]), *r[1:]) for r in found(alignment.align(docs))) == want
    assert sum(w[1] == 0 for w in want) >= 6
    assert alignment.align(docs.limit(0)).count() == 0


def test_alignment_with_narrow_stripes_and_a_forgetful_worker(spark, monkeypatch):
    """Many stripes, and segments that are encoded again."""
    rng = np.random.default_rng(1)
    words = ["the", "of", "Überraschung", "naïve", "x1", "tion", "and,", "foo\nbar", "  gap", "🙂"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), n)) for n in rng.integers(1, 900, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    want = sorted((i, *w) for i, w in enumerate(brute(texts)))
    assert sorted(found(alignment.align(docs, cells=1 << 22))) == want
    own = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "HELD_SEGMENTS", 5)
    sums = [own.encode([t]) for t in texts]
    assert [(int(s[0][0, 0]), s[1][0]) for s in sums] == [(w[1], w[7]) for w in want]
    own.by_segment = False
    own.forget()
    assert [own.encode([t])[1][0] for t in texts] == [w[7] for w in want]
