"""Strings that share most letters, in order, with one of many names; what a task does with its part of the texts.

Two strings of w and n letters with m letters in common, in order, are one string when the right w - m letters of the one and
n - m of the other are left out. The names' shorter forms are hashed once a task; the forms of many strings are hashed by
array and looked up. Where there are too many ways to leave letters out, strings are
taken by their number of a name's pairs of letters. Both let through more than is alike, never less; matched() then counts
exactly. Letters are any characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import combinations
from math import ceil, comb

import numpy as np

STEP = 1 << 13  # strings that are hashed at once
WAYS = 300  # most ways to leave letters out; beyond, pairs are counted
BITS = 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
POWERS = [np.uint64(pow(BASE, k, 1 << 64)) for k in range(512)]

#: Letters that a name of n letters and a string of w share at least, or None if the lengths don't meet.
Shared = Callable[[int, int], "int | None"]
Columns = list[np.ndarray]


def least_shared(n: int, w: int, ratio: float) -> int:
    """Letters in matching blocks from which on 2 m / (n + w) is `ratio` or more."""
    m = max(0, ceil(ratio * (n + w) / 2) - 1)
    while 2.0 * m / (n + w) < ratio:
        m += 1
    return m


def codes(text: str) -> np.ndarray:
    """One number a character; different characters have different ones."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    c ^= c >> np.uint64(29)
    return c * np.uint64(0x94D049BB133111EB)


def forms(columns: Columns, drop: int, inner: bool = False) -> Iterator[np.ndarray]:
    """Hashes of the strings whose letters the columns hold, with `drop` letters left out, in every way, or every way that keeps the first and the last."""
    w, sums = len(columns), []
    for s in range(drop + 1):
        total = [np.zeros(len(columns[0]), np.uint64)]
        for k, c in enumerate(columns):
            total.append(total[-1] + c * POWERS[max(0, k - s) % 512])
        sums.append(total)
    if not drop:
        yield sums[0][w]
        return
    # what leaving out a letter as the first, second and so on changes; the last has the rest
    left = [[sums[s][i] - sums[s + 1][i + 1] for i in range(w)] for s in range(drop)]
    for i in range(w):
        left[-1][i] += sums[drop][w]
    at, made = (), []
    for out in combinations(range(1, w - 1) if inner else range(w), drop):
        same = 0
        while same < len(at) and at[same] == out[same]:
            same += 1
        made = made[:same]
        for s in range(same, drop - 1):
            made.append(made[-1] + left[s][out[s]] if made else left[s][out[s]])
        at = out[: drop - 1]
        yield made[-1] + left[-1][out[-1]] if made else left[-1][out[-1]]


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters in matching blocks of each row of a and of b, as SequenceMatcher counts them (a first)."""
    total = np.zeros(len(a), np.int64)
    w, n = a.shape[1], b.shape[1]
    if max(w, n) > 100:
        text = lambda row: [int(x) for x in row]
        return np.array([sum(m.size for m in SequenceMatcher(None, text(x), text(y)).get_matching_blocks()) for x, y in zip(a, b, strict=True)], np.int64)
    # size and place in one number: of the longest the first of a, then of b
    small = w * n <= 256
    one, kind = (8, np.uint16) if small else (16, np.int32)
    last = (1 << one) - 1
    places = (last - np.arange(w * n)).astype(kind).reshape(w, n, 1)
    for at in range(0, len(a), 2048):
        # the pairs lie along the last axis
        first, second = np.ascontiguousarray(a[at : at + 2048].T), np.ascontiguousarray(b[at : at + 2048].T)
        same = (first[:, None] == second[None]).view(np.int8)
        k = same.shape[2]
        who, box, here = np.arange(k), np.tile(np.array([[0], [w], [0], [n]]), (1, k)), same.copy()
        rows, cols = np.arange(w)[:, None], np.arange(n)[:, None]
        while len(who):
            for i in range(1, w):
                here[i, 1:] *= here[i - 1, :-1] + np.int8(1)
            best = (here.astype(kind) << kind(one) | places).reshape(w * n, -1).max(0).astype(np.int64)
            size, place = best >> one, last - (best & last)
            np.add.at(total, at + who, size)
            i, j = place // n + 1, place % n + 1
            who = np.concatenate([who, who])
            box = np.concatenate([[box[0], i - size, box[2], j - size], [i, box[1], j, box[3]]], 1)
            more = np.concatenate([size > 0] * 2) & (box[0] < box[1]) & (box[2] < box[3])
            who, box = who[more], box[:, more]
            inside = ((rows >= box[0]) & (rows < box[1])).astype(np.int8)[:, None] * ((cols >= box[2]) & (cols < box[3])).astype(np.int8)[None]
            here = same[:, :, who] * inside
    return total


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most letters that each row of a and of b have in common, in order."""
    out = [np.zeros(0, np.int16)]
    for at in range(0, len(a), 2048):
        first, second = np.ascontiguousarray(a[at : at + 2048].T), np.ascontiguousarray(b[at : at + 2048].T)
        above = np.zeros((len(second) + 1, first.shape[1]), np.int16)
        for letter in first:
            above[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + (second == letter)), 0)
        out.append(above[-1])
    return np.concatenate(out)


class Names:
    """Names of which strings may hold most letters. reach: letters that a string has more or less at most."""

    def __init__(self, names: list[str], shared: Shared, reach: int):
        self.names = names
        self.codes = [codes(n) for n in names]
        by_length: dict[int, list[int]] = {}
        for k, name in enumerate(names):
            if name:
                by_length.setdefault(len(name), []).append(k)
        made: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        #: By width: (name, number of its pairs that a string of this width holds at least).
        self.counted: dict[int, list[tuple[int, int]]] = {}
        #: By width and length: letters in common that pairs alone don't vouch for.
        self.loose: dict[tuple[int, int], int] = {}
        for n, ids in by_length.items():
            columns, owners = list(np.stack([self.codes[k] for k in ids], 1)), np.array(ids)
            for w in range(max(1, n - reach), n + reach + 1):
                m = shared(n, w)
                if m is None or m > min(n, w):
                    continue
                m = max(m, 0)
                if max(comb(w, m), comb(n, m)) > WAYS:
                    self.loose[w, n] = m
                    self.counted.setdefault(w, []).extend((k, n - 1 - 2 * (n - m) - (w - m)) for k in ids)
                else:
                    made.setdefault((w, m), []).extend((h, owners) for h in forms(columns, n - m))
        #: By width: letters that are kept, sorted hashes, where each one's names begin, names, and which hashes may be there.
        self.hashed: dict[int, list[tuple]] = {}
        for (w, m), parts in made.items():
            h, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            there = np.zeros(1 << BITS, bool)
            there[(h >> np.uint64(64 - BITS)).view(np.int64)] = True
            self.hashed.setdefault(w, []).append((m, h[first], np.append(first, len(h)), owner, there))
        every = [k for pairs in self.counted.values() for k, _ in pairs]
        self.pairs = {k: np.unique(pair_codes(self.codes[k])) for k in set(every)}
        self.known_pairs = np.unique(np.concatenate([*self.pairs.values(), np.zeros(0, np.uint64)]))

    @property
    def widths(self) -> list[int]:
        return sorted({*self.hashed, *self.counted})

    def candidates(self, columns: Columns) -> tuple[np.ndarray, np.ndarray]:
        """Strings (by place) and names that the hashes let through; a pair may come twice."""
        w, places, found = len(columns), [], []
        for m, known, first, owner, there in self.hashed.get(w, []):
            for h in forms(columns, w - m):
                at = np.flatnonzero(there[(h >> np.uint64(64 - BITS)).view(np.int64)])
                if not len(at):
                    continue
                own = h[at]
                k = np.minimum(np.searchsorted(known, own), len(known) - 1)
                at, k = at[known[k] == own], k[known[k] == own]
                many = first[k + 1] - first[k]
                places.append(np.repeat(at, many))
                found.append(owner[np.repeat(first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())])
        none = np.zeros(0, np.int64)
        return np.concatenate([*places, none]), np.concatenate([*found, none])

    def counted_in(self, columns: Columns) -> tuple[np.ndarray, np.ndarray]:
        """Strings and names that share enough pairs of letters."""
        w, none = len(columns), np.zeros(0, np.int64)
        if w not in self.counted or w < 2:
            ids = [k for k, _ in self.counted.get(w, [])]
            return np.tile(np.arange(len(columns[0])), len(ids)), np.repeat(np.array(ids, np.int64), len(columns[0]))
        number = [self._numbers(columns[k] * POWERS[1] + columns[k + 1]) for k in range(w - 1)]
        places, found = [none], [none]
        for k, floor in self.counted[w]:
            own = self._flags(k)
            at = np.flatnonzero(sum(own[x].astype(np.int16) for x in number) >= floor)
            places.append(at)
            found.append(np.full(len(at), k))
        return np.concatenate(places), np.concatenate(found)

    def _numbers(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known_pairs, pairs), len(self.known_pairs) - 1)
        return np.where(self.known_pairs[at] == pairs, at, len(self.known_pairs))

    def _flags(self, k: int) -> np.ndarray:
        own = np.zeros(len(self.known_pairs) + 1, bool)
        own[np.searchsorted(self.known_pairs, self.pairs[k])] = True
        return own

    def share(self, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Letters in matching blocks of strings (rows of codes, of one width) and the names found for them."""
        out = np.zeros(len(rows), np.int64)
        lengths = np.array([len(self.names[k]) for k in range(len(self.names))])[found] if len(found) else found
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            distinct, back = np.unique(found[at], return_inverse=True)
            names = np.stack([self.codes[k] for k in distinct])
            if m := self.loose.get((rows.shape[1], int(n))):
                kept = common(rows[at], names[back]) >= m
                at, back = at[kept], back[kept]
            out[at] = matched(rows[at], names[back])
        return out

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """words (by place), names and the letters in their matching blocks, of whole words."""
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        for w in self.widths:
            own = np.array(by_length.get(w, []), np.int64)
            for lo in range(0, len(own), STEP):
                part = own[lo : lo + STEP]
                rows = codes("".join(words[k] for k in part)).reshape(len(part), w)
                columns = list(np.ascontiguousarray(rows.T))
                places, found = map(np.concatenate, zip(self.candidates(columns), self.counted_in(columns), strict=True))
                places, found = distinct_pairs(places, found, len(self.names))
                yield part[places], found, self.share(rows[places], found)


def pair_codes(letters: np.ndarray) -> np.ndarray:
    return letters[:-1] * POWERS[1] + letters[1:]


def distinct_pairs(places: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(places.astype(np.int64) * n + found)
    return both // n, both % n
