"""Whole-text BPE ids through the tokenizers library, each distinct word passing it once per worker.

Works for tokenizers whose pieces never reach across ASCII white space and that drop it, as normalisation to NFC and
lower case with a split on words does; check() states whether a tokenizer file is of that kind. Others are encoded
text by text.
"""

from __future__ import annotations

import json
import os
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker remembers the ids of so many units (pieces of simple words, or other words whole) of so many bytes, each from the
#: second slice of texts on that holds it (so many marks tell, a few units share one); others are encoded whenever they come.
MOST_UNITS, MOST_BYTES, MARKS = 100_000, 8 << 20, 1 << 21
# fixed value: the split of the tokenizer files whose simple words are divided here
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words of these characters alone need no Unicode tables: normalisation leaves them, lower case is one to one.
_SIMPLE = "^[!-&(-~À-ÖØ-öø-ÿ]*$"
_BREAKS = "([0-9]|[^a-z0-9ß-öø-ÿ]+)"
_WHOLE = "\x01"  # begins a unit that is a word as it came; no simple word holds it


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spec_text(path: str) -> str:
    """Patterns of the file's pre-tokenizer."""
    with open(path, encoding="utf-8") as f:
        split = json.load(f).get("pre_tokenizer") or {}
    return " ".join(p.get("pattern", {}).get("Regex", "") for p in split.get("pretokenizers", [split]))


def check(path: str) -> bool:
    """True if white space separates what is encoded and leaves no ids of its own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = json.dumps(spec.get("normalizer") or {})
    split = json.dumps(spec.get("pre_tokenizer") or {})
    plain = all(not (t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])) for t in spec.get("added_tokens", []))
    return plain and '"NFC"' in normal and '"Prepend"' not in normal and '"Removed"' in split and '"invert": true' in split and '^\\\\s' in split and '"add_prefix_space": false' in split and spec.get("post_processor") is None


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = check(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        with open(path, encoding="utf-8") as f:
            self.plain_decoder = json.load(f).get("decoder") is None
        self._strings: pa.Array | None = None
        self._numbers = pa.array([str(i) for i in range(size)])
        self._bytes = None
        if self.by_word and SPLIT in spec_text(path):
            byte_level = self.tokenizer.pre_tokenizer
            self._bytes = {c: "".join(x for x, _ in byte_level.pre_tokenize_str(chr(c))) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}
        self.units: dict[str, int] = {}
        self.bytes, self.used = 0, 0
        self.marks = np.zeros(MARKS, np.bool_)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    def _encoded(self, new: list[str]) -> list[list[int]]:
        """ids of units: of words by the library's whole pipeline, of simple words' pieces by its model."""
        model, out = self.tokenizer.model, []
        whole = iter(self.tokenizer.encode_batch_fast([u[1:] for u in new if u[:1] == _WHOLE], add_special_tokens=False))
        for u in new:
            if u[:1] == _WHOLE:
                out.append(next(whole).ids)
            else:
                out.append([t.id for t in model.tokenize(u if u.isascii() else u.translate(self._bytes))])
        return out

    def _numbers_of(self, units: list[str]) -> np.ndarray:
        """Places of units in start and length; those that no longer fit the memory are valid until the next call."""
        number = np.fromiter((self.units.get(u, -1) for u in units), np.int64, len(units))
        miss = np.flatnonzero(number < 0)
        if not len(miss):
            return number
        kept = self._kept([units[k] for k in miss])
        miss, n = np.concatenate([miss[kept], np.delete(miss, kept)]), len(kept)
        new = [units[k] for k in miss]
        ids = self._encoded(new)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        at, need = len(self.units), self.used + int(lengths.sum())
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(new) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : need] = np.fromiter(chain.from_iterable(ids), self.dtype, need - self.used)
        self.start[at : at + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + len(new)] = lengths
        number[miss] = np.arange(at, at + len(new))
        self.units.update(zip(new[:n], range(at, at + n), strict=True))
        self.used, self.bytes = self.used + int(lengths[:n].sum()), self.bytes + sum(map(len, new[:n]))
        return number

    def _kept(self, new: list[str]) -> np.ndarray:
        """Which new units to remember: those met before, as long as there is room."""
        if len(self.units) >= MOST_UNITS or self.bytes >= MOST_BYTES:
            return np.zeros(0, np.int64)
        mark = np.fromiter(map(hash, new), np.int64, len(new)) & (MARKS - 1)
        met = np.flatnonzero(self.marks[mark])
        self.marks[mark] = True
        return met[: MOST_UNITS - len(self.units)]

    def words_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, number of ids of each white-space separated piece (empty pieces included), number of pieces of each text."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), self.dtype, int(lengths.sum())), lengths, np.ones(len(ids), np.int64)
        pieces = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets = np.asarray(pieces.offsets, np.int64)
        coded = pieces.flatten().dictionary_encode()
        words = coded.dictionary
        whole = pc.binary_join_element_wise(pa.scalar(_WHOLE, pa.large_string()), words, pa.scalar("", pa.large_string()))
        if self._bytes is not None:
            simple = pc.and_not(pc.match_substring_regex(words, _SIMPLE), pc.match_substring(words, "<|"))
            whole = pc.if_else(simple, pc.replace_substring_regex(pc.utf8_lower(words), _BREAKS, r" \1 "), whole)
        parts = pc.ascii_split_whitespace(whole)
        unit = parts.flatten().dictionary_encode()
        number = self._numbers_of(unit.dictionary.to_pylist())[np.asarray(unit.indices, np.int64)]
        by_word, ends = _gather(self.flat, self.start[number], self.length[number])
        ends = np.concatenate([[0], ends])[np.asarray(parts.offsets, np.int64)]  # of each distinct word, in by_word
        which = np.asarray(coded.indices, np.int64)
        lengths = np.diff(ends)[which]
        return _gather(by_word, ends[:-1][which], lengths)[0], lengths, np.diff(offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts and n + 1 offsets into them."""
        ids, lengths, pieces = self.words_of(texts)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.concatenate([[0], np.cumsum(pieces)])]

    def exactly(self, texts: list[str]) -> list[list[int]]:
        """ids as the library gives them for whole texts."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Text of each document's ids, special tokens kept."""
        if not self.plain_decoder:
            return pa.array(self.tokenizer.decode_batch([ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], skip_special_tokens=False))
        if self._strings is None:
            self._strings = pa.array([self.tokenizer.id_to_token(i) for i in range(len(self._numbers))])
        return _joined(self._strings, ids, offsets)

    def decimal(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Decimal ids of each document, joined by one space."""
        return _joined(self._numbers, ids, offsets)


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of flat one after another, and where each ends."""
    ends = np.cumsum(length)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[np.repeat(start - (ends - length), length) + at], ends


def _joined(strings: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(ids))), " ")


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
