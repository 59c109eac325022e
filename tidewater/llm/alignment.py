"""Alignment of two tokenizers over a corpus: groups, links and how often two ids are linked.

Both tokenizers encode a space and the text. Byte offsets where a token of A and one of B both end cut the two sequences
into groups, and link the tokens that end there. An id pair's count is how many links the corpus has between its ids; a
link is best if its count is the highest of its B id.

Three passes, each over what the one before wrote:

1. encode: tasks cut texts at single spaces between other characters, where neither tokenizer ever joins, and encode
   each distinct segment once; a segment's tokens, groups and links serve all its occurrences. A task writes, for each
   block of texts, a row a document, and a row a stripe with the block's distinct pairs, their counts, and which document
   holds which pair how often. A stripe is the B ids of one remainder; pairs travel as (B id's place in the stripe, A id).
2. count: blocks' pairs are dealt by stripe (and, before that, by stripe and salt, so that no stripe is one task's work),
   np.add.at sums them into a dense matrix of the stripe's B ids by A's ids, and row maxima tell the best. CELLS bounds
   the matrix, whatever the corpus.
3. score: counts go to the stripe's tasks, where the links are dealt as well; sums a document come back by block.

Whether two tokenizers may be cut at spaces is read from their files (a byte-level A that splits before a space, a B
without normalisation and without pieces that reach over a space); others encode whole texts, with the same results.

Defined results: texts that are null, empty, or that either tokenizer doesn't give back byte by byte (with the space)
have no tokens: zeros and an empty groups_sha256. Repeated rows and null ids are rows of their own. Other columns are
not read. An empty table gives an empty result. A text is held whole in one task, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, table, text_or_empty

#: Cells of a stripe's matrix of 8 bytes each; 2 ** 24 at most, as places in it are packed.
CELLS = 1 << 24
#: Distinct segments, and their bytes, that a worker remembers.
HELD_SEGMENTS, HELD_BYTES = 250_000, 24 << 20
#: A space between characters that no tokenizer's table counts as white space.
CUT = re.compile("(?<=[^\\s᠎​]) (?=[^\\s᠎​])")
_SPACE = "▁"  # fixed value: how pieces of B write a space


class Tokenizers:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.n_a, self.n_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        level = self._byte_level()
        self.bytes_a = [bytes(level[c] for c in self.a.id_to_token(i)) if all(c in level for c in self.a.id_to_token(i)) else self.a.id_to_token(i).encode() for i in range(self.n_a)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(self.n_b))))]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([str(i) for i in range(n)] for n in (self.n_a, self.n_b))
        self.by_segment = self._cuts_at_spaces()
        self.forget()

    def _byte_level(self) -> dict[str, int]:
        """Character of each byte in A's entries: printable ones stand for themselves, the others follow from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _cuts_at_spaces(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = json.loads(self.a.to_str())
        split = spec.get("pre_tokenizer") or {}
        model = proto.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        normal, trainer = model.normalizer_spec, model.trainer_spec
        plain_a = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        plain_b = not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not trainer.treat_whitespace_as_suffix and trainer.model_type == 2
        own = any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in model.pieces)
        return bool(plain_a and plain_b and not own and not any(re.search(f"[^{_SPACE}]{_SPACE}", p.piece) for p in model.pieces))

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 0
        self.groups: list[str] = []  # '' for a segment that doesn't come back byte by byte
        self.numbers = np.zeros((1 << 12, 3), np.int64)  # of a segment: tokens of A, of B, groups
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.links = np.zeros(1 << 14, np.int64)  # id of A + id of B * n_a, segment by segment
        self.filled = 0

    def segments(self, text: str) -> list[str]:
        return CUT.split(text) if self.by_segment else [text]

    def learn(self, new: list[str]) -> None:
        """Encodes segments that aren't known yet, a space before each."""
        spaced = [f" {s}" for s in new]
        ids_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        want = [s.encode() for s in spaced]
        good = [b"".join([self.bytes_a[i] for i in x]) == w == b"".join([self.bytes_b[i] for i in y]) for x, y, w in zip(ids_a, ids_b, want, strict=True)]
        flat_a, flat_b = (np.array([i for x, ok in zip(ids, good, strict=True) if ok for i in x], np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b])
        _, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        links = flat_a[at_a] + flat_b[at_b] * self.n_a
        ends = np.cumsum([len(w) if ok else 0 for w, ok in zip(want, good, strict=True)])
        upto = np.searchsorted(end_a[at_a], ends, "right")  # links up to the end of each segment
        n_links = np.diff(upto, prepend=0)
        begin = len(self.known)
        size = begin + len(new)
        while size > len(self.start):
            self.numbers, self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.numbers, self.start, self.length))
        while self.filled + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.filled : self.filled + len(links)] = links
        self.start[begin:size], self.length[begin:size] = self.filled + upto - n_links, n_links
        self.filled += len(links)
        # group texts: each side's ids between two common ends
        text_a, text_b = self.text_a, self.text_b
        words_a, words_b = [text_a[i] for i in flat_a.tolist()], [text_b[i] for i in flat_b.tolist()]
        made, a, b = [], 0, 0
        for i, j in zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True):
            made.append(f"{words_a[a]}|{words_b[b]}" if i - a == j - b == 1 else f"{','.join(words_a[a:i])}|{','.join(words_b[b:j])}")
            a, b = i, j
        before = 0
        for k, (s, ok, x, y, to) in enumerate(zip(new, good, ids_a, ids_b, upto.tolist(), strict=True), begin):
            self.known[s] = k
            self.groups.append(";".join(made[before:to]) if ok else "")
            self.numbers[k] = (len(x), len(y), to - before) if ok else 0
            before = to
        self.used += sum(map(len, want))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text tokens of A, tokens of B and groups, and the digest of its groups; each link's text and its id pair."""
        if len(self.known) > HELD_SEGMENTS or self.used > HELD_BYTES:
            self.forget()
        cut = [self.segments(t) if t else [] for t in texts]
        known = self.known
        new = list({s: None for c in cut for s in c if s not in known})
        for lo in range(0, len(new), 50_000):
            self.learn(new[lo : lo + 50_000])
        numbers, digests, texts_at, links = np.zeros((len(texts), 3), np.int64), [""] * len(texts), [], []
        groups = self.groups
        for i, c in enumerate(cut):
            at = [known[s] for s in c]
            own = [groups[k] for k in at]
            if not own or not all(own):
                continue
            digests[i] = hashlib.sha256(";".join(own).encode()).hexdigest()
            place = np.array(at, np.int64)
            numbers[i] = self.numbers[place].sum(axis=0)
            n = self.length[place]
            shift = np.repeat(self.start[place] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            links.append(self.links[np.arange(int(n.sum())) + shift])
            texts_at.append(np.full(len(links[-1]), i, np.int64))
        none = [np.zeros(0, np.int64)]
        return numbers, digests, np.concatenate(none + texts_at), np.concatenate(none + links)


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def stripes_of(n_a: int, n_b: int, cells: int) -> int:
    """Stripes of B ids whose matrices have at most `cells` cells (one B id at least)."""
    if not max(n_a, cells) <= 1 << 24 or n_b >= 1 << 15:
        raise ValueError("at most 2 ** 24 cells and ids of A, and fewer than 2 ** 15 ids of B")
    return min(n_b, -(-n_b // max(1, cells // n_a)))


_DOC = ["place", "id", "n_a", "n_b", "n_groups", "n_links", "sha"]
_STRIPE = ["stripe", "pairs", "counts", "places", "ends", "which", "times"]
ENCODED = "block long, place int, id long, n_a long, n_b long, n_groups long, n_links long, sha string, stripe int, pairs binary, counts binary, places binary, ends binary, which binary, times binary"
_ENCODED_TYPES = pa.schema([("block", pa.int64()), ("place", pa.int32()), *[(c, pa.int64()) for c in ("id", "n_a", "n_b", "n_groups", "n_links")], ("sha", pa.string()), ("stripe", pa.int32()), *[(c, pa.binary()) for c in _STRIPE[1:]]])


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ENCODED_TYPES], schema=_ENCODED_TYPES)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _stripe_rows(block: int, doc: np.ndarray, link: np.ndarray, n_a: int, stripes: int) -> Iterator[pa.RecordBatch]:
    b, a = np.divmod(link, n_a)
    stripe = b % stripes
    found, which = np.unique((stripe << 40) + b // stripes * n_a + a, return_inverse=True)  # by stripe and place in its matrix
    first = np.searchsorted(found >> 40, np.arange(stripes + 1))
    key, times = np.unique((stripe << 48) + (doc << 24) + which - first[stripe], return_counts=True)
    stripe, doc, at = key >> 48, key >> 24 & 0xFFFFFF, key & 0xFFFFFF
    totals = np.bincount(first[stripe] + at, times, len(found)).astype(np.int64)
    edges = np.append(_firsts(stripe), len(stripe))
    out: dict[str, list] = {c: [] for c in ("block", *_STRIPE)}
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        s = int(stripe[lo])
        own = found[first[s] : first[s + 1]]
        begins = _firsts(doc[lo:hi])
        n = times[lo:hi]
        large = n > 254
        # a time above 254 is written as 255, and whole after the others
        kept = (own & ((1 << 40) - 1), totals[first[s] : first[s + 1]], doc[lo:hi][begins].astype("<u4"), np.append(begins[1:], hi - lo).astype("<u4"), at[lo:hi].astype("<u2" if len(own) <= 1 << 16 else "<u4"))
        values = (block, s, *(x.astype(x.dtype.newbyteorder("<")).tobytes() for x in kept), np.where(large, 255, n).astype("u1").tobytes() + n[large].astype("<u8").tobytes())
        for c, v in zip(out, values, strict=True):
            out[c].append(v)
    if out["block"]:
        yield _rows(**out)


def _encoder(path_a: str, path_b: str, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(path_a, path_b)
        stripes = stripes_of(own.n_a, own.n_b, cells)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, "text"):
                numbers, digests, doc, link = own.encode(some.column(1).to_pylist())
                yield _rows(block=[block] * len(some), place=np.arange(len(some)), id=some.column(0), n_a=numbers[:, 0], n_b=numbers[:, 1], n_groups=numbers[:, 2], n_links=np.bincount(doc, minlength=len(some)), sha=digests)
                yield from _stripe_rows(block, doc, link, own.n_a, stripes)
                block += 1

    return run


def _summer(n_a: int, n_b: int, stripes: int, last: bool):
    """Rows (stripe, pairs, counts) of one stripe after another -> one row a stripe; the last round adds what is best."""
    rows = -(-n_b // stripes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, matrix = None, np.zeros(0, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            pairs = np.flatnonzero(matrix)
            counts = matrix[pairs]
            most = matrix.reshape(rows, n_a).max(axis=1)
            best = [(counts == most[pairs // n_a]).astype("u1").tobytes()] if last else []
            values = [pa.array([at], pa.int32()), *(pa.array([x], pa.binary()) for x in (pairs.astype("<u8").tobytes(), counts.astype("<u8").tobytes(), *best))]
            yield pa.RecordBatch.from_arrays(values, ["stripe", "pairs", "counts", *["best"] * last])

        for batch in batches:
            for stripe, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stripe != at:
                    if at is not None:
                        yield from done()
                    at, matrix = stripe, np.zeros(rows * n_a, np.int64)
                np.add.at(matrix, np.frombuffer(pairs, "<u8").astype(np.int64), np.frombuffer(counts, "<u8").astype(np.int64))
        if at is not None:
            yield from done()

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (stripe, kind, block, pairs, counts or ends, ...), counts first -> (block, places, n_best, count_sum)."""
    pairs = counts = best = np.zeros(0, np.int64)
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for r in batch.to_pylist():
            if r["kind"] == 0:
                pairs, counts, best = np.frombuffer(r["pairs"], "<u8"), np.frombuffer(r["counts"], "<u8").astype(np.int64), np.frombuffer(r["best"], "u1").astype(np.int64)
                continue
            own = np.searchsorted(pairs, np.frombuffer(r["pairs"], "<u8"))
            ends = np.frombuffer(r["ends"], "<u4").astype(np.int64)
            which = np.frombuffer(r["which"], "<u2" if len(own) <= 1 << 16 else "<u4")
            times = np.frombuffer(r["times"], "u1", len(which)).astype(np.int64)
            times[times == 255] = np.frombuffer(r["times"], "<u8", offset=len(which))
            at = own[which]
            starts = np.concatenate([[0], ends[:-1]])
            for c, v in zip(out, (r["block"], r["places"], np.add.reduceat(best[at] * times, starts).astype("<u8").tobytes(), np.add.reduceat(counts[at] * times, starts).astype("<u8").tobytes()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["block", "places", "n_best", "count_sum"])


def _finished(id_col: str):
    """Rows of one block after another, sums (kind 0) before documents, which come by place -> the result's rows."""
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros((0, 2), np.int64)
        for batch in batches:
            kinds, blocks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.append(_firsts(blocks * 2 + kinds), len(blocks))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = batch.slice(lo, hi - lo)
                if blocks[lo] != at:
                    at, sums = blocks[lo], np.zeros((0, 2), np.int64)
                if kinds[lo] == 0:
                    for places, best, count in zip(*(own.column(own.schema.get_field_index(c)).to_pylist() for c in ("places", "best_sums", "count_sums")), strict=True):
                        p = np.frombuffer(places, "<u4").astype(np.int64)
                        if len(p) and p[-1] >= len(sums):
                            sums = np.concatenate([sums, np.zeros((int(p[-1]) + 1 - len(sums), 2), np.int64)])
                        sums[p, 0] += np.frombuffer(best, "<u8").astype(np.int64)
                        sums[p, 1] += np.frombuffer(count, "<u8").astype(np.int64)
                else:
                    p = np.asarray(own.column(own.schema.get_field_index("place")), np.int64)
                    all_sums = np.concatenate([sums, np.zeros((max(0, int(p.max()) + 1 - len(sums)), 2), np.int64)])[p]
                    column = lambda c: own.column(own.schema.get_field_index(c))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([*(column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), pa.array(all_sums[:, 0]), pa.array(all_sums[:, 1]), column("sha")], names)

    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row. id_col must be of an integer kind."""
    encoded, n_a, n_b = encode(docs, path_a, path_b, id_col, text_col, cells)
    return score(encoded, pair_counts(encoded, n_a, n_b, cells), stripes_of(n_a, n_b, cells), id_col)


def encode(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> tuple[DataFrame, int, int]:
    """The table of the first pass, and the two vocabularies' sizes."""
    if not (path_a and path_b):
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    own = tokenizers(path_a, path_b)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return table(rows.mapInArrow(_encoder(path_a, path_b, cells), ENCODED), "alignment", compression="zstd"), own.n_a, own.n_b


def _salts(df: DataFrame, stripes: int) -> int:
    return max(1, -(-2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // stripes))


def pair_counts(encoded: DataFrame, n_a: int, n_b: int, cells: int = CELLS) -> DataFrame:
    """stripe, pairs, counts, best: a row a stripe. pairs are places in its matrix of B ids (by remainder) by A ids."""
    stripes = stripes_of(n_a, n_b, cells)
    salts = _salts(encoded, stripes)
    parts = encoded.where("stripe is not null").select("stripe", "pairs", "counts", F.pmod("block", F.lit(salts)).cast("int").alias("salt"))
    if salts > 1:
        dealt = parts.repartitionById(stripes * salts, (F.col("stripe") * salts + F.col("salt")).cast("int")).select("stripe", "pairs", "counts").sortWithinPartitions("stripe")
        parts = dealt.mapInArrow(_summer(n_a, n_b, stripes, False), "stripe int, pairs binary, counts binary")
    dealt = parts.select("stripe", "pairs", "counts").repartitionById(stripes, F.col("stripe")).sortWithinPartitions("stripe")
    return table(dealt.mapInArrow(_summer(n_a, n_b, stripes, True), "stripe int, pairs binary, counts binary, best binary"), "alignment-counts")


def score(encoded: DataFrame, counted: DataFrame, stripes: int, id_col: str = "doc_id") -> DataFrame:
    salts = _salts(encoded, stripes)
    links = encoded.where("stripe is not null").select(F.lit(1).alias("kind"), "stripe", F.pmod("block", F.lit(salts)).cast("int").alias("salt"), "block", "pairs", "places", "ends", "which", "times")
    heads = counted.select(F.lit(0).alias("kind"), "stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "pairs", "counts", "best")
    dealt = links.unionByName(heads, allowMissingColumns=True).repartitionById(stripes * salts, (F.col("stripe") * salts + F.col("salt")).cast("int")).sortWithinPartitions("stripe", "kind")
    sums = dealt.mapInArrow(_scored, "block long, places binary, n_best binary, count_sum binary").select(F.lit(0).alias("kind"), "block", "places", F.col("n_best").alias("best_sums"), F.col("count_sum").alias("count_sums"))
    rows = encoded.where("place is not null").select(F.lit(1).alias("kind"), "block", "place", "id", "n_a", "n_b", "n_groups", "n_links", "sha")
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sums.unionByName(rows, allowMissingColumns=True).repartition(n, "block").sortWithinPartitions("block", "kind", "place")
    return met.mapInArrow(_finished(id_col), f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
