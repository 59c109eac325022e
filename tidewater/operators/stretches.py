"""Stretches of texts that share most letters, in order, with one of many names; what a task does with its part of the texts.

Narrow stretches come again and again, in all texts of a task: what each is near is kept, as many as a table of fixed size
holds, and the others are searched once a run of texts. They and wider ones are hashed with letters left out and met with
the names' forms (neighbours.py). Where there are too many ways to leave letters out, all names go through a text side by
side, a bit for each of their letters, with one row of bits for each number of letters left out of a name and of a
stretch. All let through what has letters enough in common, and matched() counts exactly. Letters are any characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa

from .neighbours import common, forms, least_shared, matched, pair_codes

STEP = 1 << 13  # strings that are hashed at once
RUN = 1 << 16  # letters of texts that are searched together, or one text
PLACES = 1 << 20  # pairs of a text and a name that are ranked together, or one text
WAYS = 60  # most ways to leave letters out; beyond, names go through the texts bit by bit
LONGEST = 63  # letters of a name that goes so
LANES = 2048  # most parts of a run that go side by side
WORDS = 1 << 13  # words of bits that go side by side
KEPT = 1 << 18  # stretches of each width that are kept
NEAR = 1 << 20  # names near them that are kept
WIDEST = 8  # of kept stretches
SPREAD = np.uint64(0x9E3779B97F4A7C15)
FINE = 1 << 30  # unlike ratios of a name of 16,383 letters or fewer differ by more than 1 / FINE
START = (1 << 30) - 1

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Kept:
    """Stretches of one width and what each is near: a table with one stretch at each place, and runs of names and their keys."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.stretch = np.full(KEPT, np.iinfo(np.uint64).max, np.uint64)
        self.first, self.many = np.zeros(KEPT, np.int32), np.zeros(KEPT, np.int32)
        self.names, self.keys, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    @staticmethod
    def place(stretch: np.ndarray) -> np.ndarray:
        return ((stretch * SPREAD) >> np.uint64(64 - KEPT.bit_length() + 1)).view(np.int64)

    def put(self, stretch: np.ndarray, first: np.ndarray, many: np.ndarray, names: np.ndarray, keys: np.ndarray) -> None:
        """Distinct stretches; of those of one place the last stays."""
        if self.held + len(names) > NEAR:
            self.clear()
            if len(names) > NEAR:
                return
        if self.held + len(names) > len(self.names):
            room = np.zeros(max(2 * len(self.names), self.held + len(names)), np.int64)
            self.names, self.keys = np.append(self.names[: self.held], room.astype(np.int32)), np.append(self.keys[: self.held], room)
        self.names[self.held : self.held + len(names)], self.keys[self.held : self.held + len(names)] = names, keys
        at = self.place(stretch)
        # a place that is written twice holds one and the same stretch in all three
        _, last = np.unique(at[::-1], return_index=True)
        last = len(at) - 1 - last
        self.stretch[at[last]], self.first[at[last]], self.many[at[last]] = stretch[last], first[last] + self.held, many[last]
        self.held += len(names)


class Rows:
    """Names of which as many letters may be left out: bits of all, in words of 64. A bit says that so many of a name's letters are met; the first always is set."""

    def __init__(self, ids: list[int], letters: list[np.ndarray], rules: dict[int, dict[int, tuple[int, int]]], n_letters: int):
        room: list[int] = []
        at = {}  # by name its word and first bit
        for k in sorted(ids, key=lambda k: -len(letters[k])):
            n = len(letters[k]) + 1
            word = next((x for x, free in enumerate(room) if free >= n), len(room))
            room += [64] * (word == len(room))
            at[k] = word, 64 - room[word]
            room[word] -= n
        self.words = len(room)
        slots = max(np.bincount([word for word, _ in at.values()]))
        self.low = np.zeros(self.words, np.uint64)
        self.match = np.zeros((n_letters, self.words), np.uint64)
        #: By word and slot: the name and its last bit.
        self.name, self.last = np.zeros((self.words, slots), np.int64), np.zeros((self.words, slots), np.uint64)
        used, self.ends = [0] * self.words, {}
        for k, (x, b) in at.items():
            n = len(letters[k])
            self.low[x] |= np.uint64(1 << b)
            for i, letter in enumerate(letters[k]):
                self.match[letter, x] |= np.uint64(1 << (b + i))
            last = np.uint64(1 << (b + n))
            self.name[x, used[x]], self.last[x, used[x]] = k, last
            used[x] += 1
            for width, left in rules[n].items():
                self.ends.setdefault((*left, width - n), np.zeros(self.words, np.uint64))[x] |= last
        self.widest = max(len(letters[k]) for k in ids) + 1
        self.left = tuple(max(e[i] for e in self.ends) for i in (0, 1))

    def found(self, letters: np.ndarray) -> Pairs:
        """Ends of stretches, names, and letters that the stretches have more than the names."""
        e_most, d_most = self.left
        lanes = max(1, min(LANES, WORDS // self.words, len(letters) // (4 * self.widest)))
        long = -(-len(letters) // lanes)
        # each part begins so far before its own letters that every stretch that ends in it is whole
        padded = np.concatenate([np.zeros(self.widest, letters.dtype), letters, np.zeros(lanes * long - len(letters), letters.dtype)])
        shape = (d_most + 1, lanes, self.words)
        rows = [np.broadcast_to(self.low, shape).copy() for _ in range(e_most + 1)]  # by letters left out of the name, then of the stretch
        spare, one, begins = np.zeros(shape, np.uint64), np.uint64(1), np.arange(lanes) * long
        told: list[tuple[np.ndarray, ...]] = []
        for t in range(self.widest + long):
            own = self.match[padded[begins + t]]
            for e in range(e_most + 1):
                made = np.bitwise_and(rows[e], own, out=spare)
                if e:
                    made |= rows[e - 1]
                # what leaves a name's last bit meets the next one's first
                made <<= one
                made[0] |= self.low
                made[1:] |= rows[e][:-1]
                rows[e], spare = made, rows[e]
            if t < self.widest:
                continue
            here = [(rows[e][d] & mask).ravel() for (e, d, _), mask in self.ends.items()]
            at = np.flatnonzero(np.bitwise_or.reduce(here))
            if len(at):
                told += [(at // self.words * long + (t - self.widest), at % self.words, bits[at], np.full(len(at), more)) for (_, _, more), bits in zip(self.ends, here, strict=True)]
        if not told:
            return (np.zeros(0, np.int64),) * 3
        end, word, bits, more = map(np.concatenate, zip(*told, strict=True))
        at, k = np.nonzero(bits[:, None] & self.last[word])
        within = end[at] < len(letters)
        return end[at][within], self.name[word[at], k][within], more[at][within]


class Stretches:
    """Names, of two letters or more, of which stretches of texts, one letter more or less at most, are sought that are alike by `least` or more."""

    def __init__(self, names: list[str], least: float):
        self.names, self.least = names, least
        self.lengths = np.array([len(n) for n in names], np.int64)
        points = [points_of(n) for n in names]
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *points]))
        self.kind = np.uint8 if len(self.alphabet) < 256 else np.uint32
        self.letters = [self._letters(p) for p in points]
        self.bits = max(1, len(self.alphabet).bit_length())
        rng = np.random.default_rng(1)
        #: A number for each letter; 0 stands for those that no name has.
        self.number = rng.integers(1, 1 << 63, len(self.alphabet) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        by_length: dict[int, list[int]] = {}
        for k, n in enumerate(self.lengths):
            if n:
                by_length.setdefault(int(n), []).append(k)
        #: By length: the letters of its names, in rows; and each name's place there.
        self.of_length = {n: np.stack([self.letters[k] for k in ids]) for n, ids in by_length.items()}
        self.place = np.zeros(len(names), np.int64)
        for ids in by_length.values():
            self.place[ids] = np.arange(len(ids))
        made: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        #: Widths and letters in common that some name's narrowest stretches have. A wider one whose first or last letter is in no
        #: matching block has the same blocks without it, and is more alike; so both are kept of those, if two are.
        narrow: set[tuple[int, int]] = set()
        rows: dict[tuple[int, int], list[int]] = {}
        rules: dict[int, dict[int, tuple[int, int]]] = {}
        #: By width: (name, number of its pairs that a stretch of this width holds at least), of names beyond LONGEST.
        self.counted: dict[int, list[tuple[int, int]]] = {}
        self.loose: dict[tuple[int, int], int] = {}
        for n, ids in by_length.items():
            shared = {w: m for w in range(max(2, n - 1), n + 2) if (m := least_shared(n, w, least)) <= min(n, w)}
            if all(max(comb(w, m), comb(n, m)) <= WAYS for w, m in shared.items()):
                columns, owners = list(self.number[self.of_length[n].T]), np.array(ids)
                for w, m in shared.items():
                    narrow |= set() if w - 1 in shared else {(w, m)}
                    made.setdefault((w, m), []).extend((h, owners) for h in forms(columns, n - m))
            elif n <= LONGEST:
                rules[n] = {w: (n - m, w - m) for w, m in shared.items()}
                left = tuple(max(x[i] for x in rules[n].values()) for i in (0, 1))
                rows.setdefault(left, []).extend(ids)
            else:
                for w, m in shared.items():
                    self.loose[w, n] = m
                    self.counted.setdefault(w, []).extend((k, n - 1 - 2 * (n - m) - (w - m)) for k in ids)
        self.rows = [Rows(ids, self.letters, rules, len(self.alphabet) + 1) for ids in rows.values()]
        #: By width: letters that are kept, sorted hashes, where each one's names begin, names, which hashes may be there, and their bits.
        self.hashed: dict[int, list[tuple]] = {}
        for (w, m), parts in made.items():
            h, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            bits = min(20, max(12, len(first).bit_length() + 4))
            marks = [np.zeros(1 << bits, bool) for _ in range(2)]
            for mark, shift in zip(marks, (64 - bits, 64 - 2 * bits), strict=True):
                mark[self._mark(h, shift, bits)] = True
            self.hashed.setdefault(w, []).append((m, m > 1 and (w, m) not in narrow, h[first], np.append(first, len(h)), owner, marks, bits))
        # a kept stretch is its letters' bits
        self.kept = {w: Kept() for w in self.hashed if w <= WIDEST and w * self.bits < 64}

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """Places in the alphabet, from 1; 0 of other letters."""
        if not len(self.alphabet):
            return np.zeros(len(points), self.kind)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(self.kind)

    @staticmethod
    def _mark(h: np.ndarray, shift: int, bits: int) -> np.ndarray:
        at = h >> np.uint64(shift)
        return (at & np.uint64((1 << bits) - 1) if shift + bits < 64 else at).view(np.int64)

    def _candidates(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Strings (by place) and names that the hashes let through, each pair once. columns: numbers of letters."""
        w, n, both = len(columns), len(self.names), [np.zeros(0, np.int64)]
        for m, inner, known, first, owner, marks, bits in self.hashed.get(w, []):
            places, hashes = [], []
            for h in forms(columns, w - m, inner):
                at = np.flatnonzero(marks[0].take(self._mark(h, 64 - bits, bits), mode="clip"))
                places.append(at)
                hashes.append(h[at])
            at, own = np.concatenate(places), np.concatenate(hashes)
            there = marks[1][self._mark(own, 64 - 2 * bits, bits)]
            at, own = at[there], own[there]
            k = np.minimum(np.searchsorted(known, own), len(known) - 1)
            right = known[k] == own
            at, k = at[right], k[right]
            many = first[k + 1] - first[k]
            both.append(np.repeat(at, many) * n + owner[spans(first[k], many)])
        pairs = np.unique(np.concatenate(both))
        return pairs // n, pairs % n

    def _share(self, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Letters in matching blocks of stretches (rows of letters, of one width) and the names found for them."""
        out = np.zeros(len(rows), np.int64)
        lengths = self.lengths[found]
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            names = self.of_length[int(n)][self.place[found[at]]]
            if m := self.loose.get((rows.shape[1], int(n))):
                near = common(rows[at], names) >= m
                at, names = at[near], names[near]
            out[at] = matched(rows[at], names)
        return out

    def _keys(self, w: int, rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are alike enough, and a number that ascends from the most alike to the least, then with the width, and leaves room for a start."""
        n = self.lengths[found]
        ratio = 2.0 * self._share(rows, found) / (n + w)
        near = np.flatnonzero(ratio >= self.least)
        fine = FINE - np.floor(ratio[near] * FINE).astype(np.int64)
        return near, (fine << 32) | ((w - n[near] + 1) << 30)

    def _near(self, w: int, letters: list[np.ndarray], numbers: list[np.ndarray], ends: np.ndarray | None = None) -> Pairs:
        """Strings (by place) that end by their text's end, names that they are near, and keys of both. letters, and numbers of them: columns."""
        parts = []
        for lo in range(0, len(numbers[0]), STEP):
            at, who = self._candidates([c[lo : lo + STEP] for c in numbers])
            parts.append((at + lo, who))
        places, found = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        if ends is not None:
            within = places + w <= ends[places]
            places, found = places[within], found[within]
        kept = [(np.zeros(0, np.int64),) * 3]
        for lo in range(0, len(places), RUN):
            at, who = places[lo : lo + RUN], found[lo : lo + RUN]
            near, key = self._keys(w, np.stack([c[at] for c in letters], 1), who)
            kept.append((at[near], who[near], key))
        return tuple(map(np.concatenate, zip(*kept, strict=True)))

    def _of_kept(self, w: int, stretch: np.ndarray, places: np.ndarray) -> Iterator[Pairs]:
        """Where stretches stand, the names they are near, and keys of both."""
        kept = self.kept[w]
        at = kept.place(stretch)
        there = kept.stretch[at] == stretch
        known, many = np.flatnonzero(there), kept.many[at]
        known = known[many[known] > 0]
        often = many[known]
        own = spans(kept.first[at[known]], often)
        yield np.repeat(places[known], often), kept.names[own], kept.keys[own]
        new = np.flatnonzero(~there)
        if not len(new):
            return
        distinct, back = np.unique(stretch[new], return_inverse=True)
        mask = np.uint64((1 << self.bits) - 1)
        columns = [((distinct >> np.uint64(self.bits * (w - 1 - k))) & mask).astype(self.kind) for k in range(w)]
        which, found, keys = self._near(w, columns, [self.number[c] for c in columns])
        many = np.bincount(which, minlength=len(distinct))
        first = np.cumsum(many) - many
        kept.put(distinct, first, many, found, keys)
        own = spans(first[back], many[back])
        yield np.repeat(places[new], many[back]), found[own], keys[own]

    def _in_run(self, letters: np.ndarray, ends: np.ndarray) -> Iterator[Pairs]:
        """Starts of stretches, the names they are near, and keys of both. ends: by letter, where its text ends."""
        n, most = len(letters), max([*self.hashed, *self.counted, 2])
        after = np.append(letters, np.zeros(most, letters.dtype))
        if self.kept:
            # letters' bits of ever wider stretches
            stretch = np.zeros(n, np.uint64)
            for w in range(1, max(self.kept) + 1):
                stretch = (stretch << np.uint64(self.bits)) | after[w - 1 : w - 1 + n].astype(np.uint64)
                if w in self.kept:
                    for lo in range(0, n, RUN):
                        places = np.arange(lo, min(n, lo + RUN))
                        places = places[places + w <= ends[places]]
                        yield from self._of_kept(w, stretch[places], places)
        if wide := self.hashed.keys() - self.kept.keys():
            numbers = self.number[after]
            for w in wide:
                yield self._near(w, [after[k : k + n] for k in range(w)], [numbers[k : k + n] for k in range(w)], ends)
        for rows in self.rows:
            end, found, more = rows.found(letters)
            width = self.lengths[found] + more
            yield from self._checked(after, end - width + 1, found, width, ends)
        if self.counted:
            numbers = pair_codes(self.number[after])
            for w, names in self.counted.items():
                for k, floor in names:
                    upto = np.append(0, np.cumsum(np.isin(numbers, np.unique(pair_codes(self.number[self.letters[k]])))))
                    at = np.flatnonzero(upto[w - 1 : w - 1 + n] - upto[:n] >= floor)
                    yield from self._checked(after, at, np.full(len(at), k), np.full(len(at), w), ends)

    def _checked(self, letters: np.ndarray, start: np.ndarray, found: np.ndarray, width: np.ndarray, ends: np.ndarray) -> Iterator[Pairs]:
        within = (start >= 0) & (start + width <= ends[np.maximum(start, 0)])
        start, found, width = start[within], found[within], width[within]
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            for lo in range(0, len(own), RUN):
                at = own[lo : lo + RUN]
                near, key = self._keys(int(w), letters[start[at][:, None] + np.arange(w)], found[at])
                yield start[at[near]], found[at[near]], key

    def best(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.StringArray, np.ndarray, np.ndarray]]:
        """texts (by place), names, surfaces, letters in matching blocks, and letters of a name and a stretch together: the stretch of a text that is most like a name; of several the shortest, then the first; of no name that stands in the text."""
        if not self.names:
            return
        most = np.iinfo(np.int64).max
        for lo, hi in runs_of(texts, max(1, PLACES // len(self.names))):
            points, lengths = points_of("".join(texts[lo:hi])), np.array([len(t) for t in texts[lo:hi]])
            upto = np.cumsum(lengths)
            begin = np.repeat(upto - lengths, lengths)
            row = np.repeat(np.arange(hi - lo) * len(self.names), lengths)
            key = np.full((hi - lo) * len(self.names), most)
            for place, found, keys in self._in_run(self._letters(points), np.repeat(upto, lengths)):
                np.minimum.at(key, row[place] + found, keys | (place - begin[place]))
            at = np.flatnonzero(key < most)
            at = at[(key[at] >> 32) > 0]  # only the name itself is wholly alike
            text, name, key = at // len(self.names), at % len(self.names), key[at]
            n = self.lengths[name]
            width = n + ((key >> 30) & 3) - 1
            share = np.rint((FINE - (key >> 32)) / FINE * (n + width) / 2).astype(np.int64)
            start = (upto - lengths)[text] + (key & START)
            yield text + lo, name, cut(points, start, width), share, n + width


def points_of(text: str) -> np.ndarray:
    """The code point of each character."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def cut(points: np.ndarray, start: np.ndarray, width: np.ndarray) -> pa.StringArray:
    """Stretches of a text, given by its code points."""
    size = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    upto = np.append(0, np.cumsum(size))
    first, many = upto[start], upto[start + width] - upto[start]
    text = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
    offsets = np.append(0, np.cumsum(many)).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(text[spans(first, many)]))


def spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, `many` of each."""
    upto = np.cumsum(many)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - upto + many, many)


def runs_of(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of `most` texts with RUN letters together, or one text."""
    lo, held = 0, 0
    for k, text in enumerate(texts):
        if k > lo and (held + len(text) > RUN or k - lo == most):
            yield lo, k
            lo, held = k, 0
        held += len(text)
    if lo < len(texts):
        yield lo, len(texts)
