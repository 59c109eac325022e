"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts texts into chunks at places that depend on content alone, so copied passages
give equal chunks wherever they stand. Chunks that occur more than once are encoded once, by the row that owns their
first occurrence, and their ids are joined to all rows that hold them; other chunks are encoded where they lie. The
pieces that a cut divided are put together and encoded anew, in a window that grows until its outer pieces get exactly
the ids they had in their chunks.

What moves: 16-byte digests of chunks, one shuffle of the texts by row key (used twice), deflated ids of shared chunks. A chunk
that a third of the rows hold is one row on its own side of a plain join, whose hot partition adaptive execution splits.

Defined results: a null text counts as empty and has no ids. Rows that repeat id and text get equal results, one each;
null ids are kept. Texts of any length are processed whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_words import Encoder, default_path, encoder
from .shared import cut, mix64, row_key, slices, table, text_bytes, text_or_empty

#: Bytes: of the rolling window, the least and the largest chunk; the mean is the least plus 2 to the power CUT_BITS.
WINDOW, LEAST, LARGEST, CUT_BITS = 16, 512, 16384, 11
_SPACE = b" \t\n\r\x0b\x0c"
_GEAR = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567)) >> np.uint64(32)


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes; they never divide a character."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h, step = _GEAR.astype(np.uint32)[data], 1
    while step < WINDOW:  # h[i] becomes the hash of the WINDOW bytes that end at i
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h, step = longer, step * 2
    marks = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends, at, k = [], 0, 0
    while n - at > LEAST:
        k = int(np.searchsorted(marks, at + LEAST))
        to = min(int(marks[k]) if k < len(marks) else n, at + LARGEST, n)
        while to < n and data[to] & 0xC0 == 0x80:
            to += 1
        ends.append(to)
        at = to
    if at < n:
        ends.append(n)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[bytes]]]]:
    """Slices of a batch with column text, the slice's texts and their chunks."""
    for part in slices(batch, "text"):
        data, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
        texts, chunks = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = data[a:b]
            ends = cuts(own)
            whole = own.tobytes()
            texts.append(whole)
            chunks.append([whole[s:e] for s, e in zip([0, *ends], ends, strict=False)])
        yield part, texts, chunks


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, seq, digest) of each chunk."""
    for batch in batches:
        for part, _, chunks in _texts(batch):
            keys = part.column(0).to_pylist()
            rows = [(k, i, digest(c)) for k, own in zip(keys, chunks, strict=True) for i, c in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["key", "seq", "digest"])


def _encoded(enc: Encoder, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids of each chunk on its own, and the number of ids of each of its pieces."""
    ids, lengths, pieces = enc.words_of(pa.array([c.decode() for c in chunks], pa.large_string()))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = np.concatenate([[0], np.cumsum(pieces)])
    return [(ids[ends[a] : ends[b]], lengths[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _lengths(n: np.ndarray) -> bytes:
    """Numbers of ids as one byte each, or, after a byte that says so, two; deflated."""
    return zlib.compress(b"\1" + n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b"\2" + n.astype("<u2").tobytes())


def _read_lengths(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _own(path: str):
    """Of rows sorted by key, those that own shared chunks: digest, ids and piece lengths of each chunk owned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(path), None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            held = batch.column(batch.schema.get_field_index("held")).is_valid().to_pylist()
            # repeated rows stand together; one of them speaks for all
            fresh = [h and k != before for h, k, before in zip(held, keys, [last, *keys], strict=False)]
            last = keys[-1] if keys else last
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for part, _, chunks in _texts(batch):
                lists = part.column(part.schema.get_field_index("held")).to_pylist()
                mine = {h["digest"]: own[h["seq"]] for own, held in zip(chunks, lists, strict=True) for h in held}
                if mine:
                    done = _encoded(enc, list(mine.values()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.binary()), pa.array([zlib.compress(i.astype(np.uint32).astype(enc.dtype).tobytes()) for i, _ in done], pa.binary()), pa.array([_lengths(n) for _, n in done], pa.binary())], ["digest", "ids", "lens"])

    return run


def join_chunks(enc: Encoder, chunks: list[bytes], coded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ids of a text from those of its chunks, the pieces at the joins encoded anew."""
    if len(chunks) == 1:
        return coded[0][0]
    out: list[np.ndarray] = []
    words = [_pieces(enc, c.decode()) for c in chunks]
    i, last = 0, len(chunks) - 1
    head = 0  # pieces of chunk i that an earlier join has done
    while i <= last:
        ids, lens = coded[i]
        if i == last:
            out.append(ids[int(lens[:head].sum()) :])
            break
        # the join after chunk i: its last piece and the first of the next, over chunks that are one piece only
        j, middle = i + 1, words[i][-1]
        while j < last and len(words[j]) == 1:
            middle += words[j][0]
            j += 1
        middle += words[j][0]
        if len(words[i]) - 1 < head:  # chunk i was one piece and is part of the join before it
            raise AssertionError("chunks of one piece are joined at once")
        end = int(lens[-1])
        out.append(ids[int(lens[:head].sum()) : len(ids) - end])
        out.append(_repaired(enc, words[i][:-1], middle, words[j][1:], lens[:-1], coded[i][0][: len(ids) - end], lens=coded[j][1][1:], ids=coded[j][0][int(coded[j][1][0]) :]))
        i, head = j, 1
    return np.concatenate(out) if out else np.zeros(0, enc.dtype)


_RUN_OF_SPACE = re.compile(f"[{_SPACE.decode()}]+")


def _pieces(enc: Encoder, chunk: str) -> list[str]:
    """The pieces whose lengths words_of gives: between runs of white space, empty ones at the ends included."""
    return _RUN_OF_SPACE.split(chunk) if enc.by_word else [chunk]


def _repaired(enc: Encoder, left: list[str], middle: str, right: list[str], left_lens: np.ndarray, left_ids: np.ndarray, *, lens: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """ids of the divided piece, from a window that grows until the pieces around it get the ids of their chunks."""
    around = 1
    while True:
        a, b = left[len(left) - min(around, len(left)) :], right[:around]
        window = enc.exactly([" ".join([*a, middle, *b])])[0]
        n_left = int(left_lens[len(left_lens) - len(a) :].sum()) if len(a) else 0
        n_right = int(lens[: len(b)].sum())
        inner = window[n_left : len(window) - n_right]
        if len(window) >= n_left + n_right and window[:n_left] == left_ids[len(left_ids) - n_left :].tolist() and window[len(window) - n_right :] == ids[:n_right].tolist():
            return np.array(inner, enc.dtype)
        if around >= max(len(left), len(right)):
            raise ValueError("this tokenizer's pieces depend on more than their chunks")
        around *= 2


def _finish(path: str):
    """(id, key, text, shared: array of seq, ids, lens) to id, ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, texts, chunks in _texts(batch):
                given = part.column(part.schema.get_field_index("shared")).to_pylist()
                have = [{s["seq"]: (np.frombuffer(zlib.decompress(s["ids"]), enc.dtype), _read_lengths(s["lens"])) for s in g or ()} for g in given]
                todo = [c for own, h in zip(chunks, have, strict=True) for i, c in enumerate(own) if i not in h]
                done = iter(_encoded(enc, todo))
                rows = []
                for own, h in zip(chunks, have, strict=True):
                    coded = [h[i] if i in h else next(done) for i in range(len(own))]
                    rows.append(join_chunks(enc, own, coded) if own else np.zeros(0, enc.dtype))
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                ids = np.concatenate(rows) if rows else np.zeros(0, enc.dtype)
                decoded, decimal = enc.decode(ids, offsets), enc.decimal(ids, offsets)
                sha = lambda col: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in col.to_pylist()])
                columns = {"ids": lambda: pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary()), "decoded": lambda: decoded.cast(pa.string()), "n_tokens": lambda: pa.array(np.diff(offsets)), "ids_sha256": lambda: sha(decimal), "decoded_sha256": lambda: sha(decoded), "row_key": lambda: part.column(1)}
                yield part, columns

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, output: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """One row per row: id and the outputs asked for.

    n_tokens long; ids binary, little-endian unsigned 32-bit; decoded string; ids_sha256, decoded_sha256 hex strings;
    row_key binary, of id and text.
    """
    path = path or default_path()
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    # both sides of the joins on digests are cut, so that nothing but exchanges stands below them and hot partitions can be split
    chunks = table(keyed.select("key", "text").mapInArrow(_digests, "key binary, seq int, digest binary"), "chunks")
    shared = cut(chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "seq")).alias("first")).where("n > 1"))
    links = cut(chunks.join(shared.hint("merge"), "digest").select("key", "seq", "digest", (F.struct("key", "seq") == F.col("first")).alias("owner")))
    held = links.where("owner").groupBy("key").agg(F.collect_set(F.struct("seq", "digest")).alias("held"))
    own = keyed.join(held.hint("merge"), "key", "left").select("id", "key", "text", "held")
    coded = own.mapInArrow(_own(path), "digest binary, ids binary, lens binary")
    # no cut here: within one query both uses of the texts' exchange are one
    spread = links.select("key", "seq", "digest").join(coded.hint("merge"), "digest").groupBy("key").agg(F.collect_set(F.struct("seq", "ids", "lens")).alias("shared"))
    rows = keyed.join(spread.hint("merge"), "key", "left").select("id", "key", "text", "shared")
    kinds = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "row_key": T.BinaryType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, kinds[c]) for c in output]])
    finish = _finish(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in finish(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *[columns[c]() for c in output]], names=[id_col, *output])

    return rows.mapInArrow(run, schema)
