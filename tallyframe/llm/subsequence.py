"""Gap-weighted subsequence kernel between short strings and a fixed set of landmarks.

A string's features are its subsequences of three characters, each occurrence weighing
DECAY to the power of the stretch it spans; the kernel is the cosine of two such vectors.
So an insult with a character put in or left out still shares most of its weight with the
plain one. Stretches of over SPAN characters weigh nothing: that is part of the kernel.
The two borders of a word count as characters of their own, so that it matters whether a
stem stands at the beginning of a word or inside it.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

DECAY, SPAN, LONGEST = 0.8, 8, 24  # LONGEST without the borders
BEGIN, END = "\x02", "\x03"
#: Words, and subsequences of words, that are taken together: for the bounds, and for the exact values of what they leave.
_BOUNDED, _EXACT = (4096, 1 << 18), (512, 1 << 15)


@cache
def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, middle, last place) of all subsequences of a string of n characters, and their weights."""
    found = [(i, j, k) for i, j, k in combinations(range(n), 3) if k - i < SPAN]
    at = np.array(found, np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def _rows(most: tuple[int, int], each: int) -> int:
    """How many words of ``each`` subsequences are taken together."""
    return max(1, min(most[0], most[1] // max(1, each)))


def windows(word: str) -> list[str]:
    """A long word as overlapping pieces, so that all of it is seen."""
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def bordered(word: str) -> str:
    return BEGIN + word + END


def features(word: str) -> dict[str, float]:
    """Unit vector of a word's subsequences."""
    at, weights = places(len(word))
    out: dict[str, float] = {}
    for (i, j, k), w in zip(at.tolist(), weights.tolist(), strict=True):
        key = word[i] + word[j] + word[k]
        out[key] = out.get(key, 0.0) + w
    norm = sum(w * w for w in out.values()) ** 0.5
    return {k: w / norm for k, w in out.items()}


def kernel(a: str, b: str) -> float:
    """The kernel of two strings, for tests and small sets."""
    x, y = features(a), features(b)
    return sum(w * y.get(k, 0.0) for k, w in x.items())


class Landmarks:
    """Kernel values of many words against the landmarks, where at least ``floor``."""

    def __init__(self, words: list[str], floor: float) -> None:
        self.words, self.floor = words, floor
        own = [features(w) for w in words]
        letters = sorted({c for w in words for c in w})
        self.base = len(letters) + 1
        self.code = np.zeros(0x110000 if any(ord(c) >= 0x3000 for c in letters) else 0x3000, np.int64)
        for k, c in enumerate(letters):
            self.code[ord(c)] = k + 1
        number = {c: k + 1 for k, c in enumerate(letters)}
        keys = sorted({k for f in own for k in f})
        self.row = np.zeros(self.base**3, np.int32)
        self.values = np.zeros((len(keys) + 1, len(words)))
        place = {}
        for k, key in enumerate(keys):
            a, b, c = (number[x] for x in key)
            self.row[(a * self.base + b) * self.base + c] = place[key] = k + 1
        for m, f in enumerate(own):
            for key, w in f.items():
                self.values[place[key], m] = w
        # the same by key: which landmarks have it, and with what weight
        key, self.who = np.nonzero(self.values)
        self.weight = self.values[key, self.who]
        self.ends = np.cumsum(np.bincount(key, minlength=len(self.values)))
        self.begins = np.append(0, self.ends[:-1])
        self.most = self.values.max(axis=1)[self.row].astype(np.float32) if len(words) else np.zeros(self.base**3, np.float32)

    def _triples(self, words: list[str], n: int) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n)
        codes = np.where(points < len(self.code), self.code[np.minimum(points, len(self.code) - 1)], 0)
        at, _ = places(n)
        return (codes[:, at[:, 0]] * self.base + codes[:, at[:, 1]]) * self.base + codes[:, at[:, 2]]

    def against(self, words: list[str]) -> dict[str, np.ndarray]:
        """The words that reach ``floor`` with any landmark, and their values with all; values
        under the floor are zero.

        Most words are ruled out by a bound: each subsequence counts as what the best landmark
        has for it, over the least norm that a string of this length can have.
        """
        by_length: dict[int, list[str]] = {}
        for w in words:
            if 3 <= len(w) <= LONGEST + 2:
                by_length.setdefault(len(w), []).append(w)
        out = {}
        for n, same in by_length.items():
            at, weights = places(n)
            least = np.sqrt((weights**2).sum())
            many, few = _rows(_BOUNDED, len(at)), _rows(_EXACT, len(at))
            for low in range(0, len(same), many):
                part = same[low : low + many]
                triples = self._triples(part, n)
                bound = self.most[triples] @ weights.astype(np.float32) / least
                near = np.flatnonzero(bound >= self.floor * 0.999)
                for k in range(0, len(near), few):
                    rows = near[k : k + few]
                    found = self._exact([part[r] for r in rows.tolist()], triples[rows], n)
                    found[found < self.floor] = 0.0
                    for r in np.flatnonzero(found.any(axis=1)).tolist():
                        out[part[rows[r]]] = found[r].copy()
        return out

    def _exact(self, words: list[str], triples: np.ndarray, n: int) -> np.ndarray:
        at, weights = places(n)
        # norms: equal subsequences of a word add up before they are squared
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.int64)
        keys = (points[:, at[:, 0]] << 42) | (points[:, at[:, 1]] << 21) | points[:, at[:, 2]]
        order = np.argsort(keys, axis=1, kind="stable")
        keys = np.take_along_axis(keys, order, 1)
        fresh = np.ones(keys.shape, bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        sums = np.bincount(np.cumsum(fresh.ravel()) - 1, weights[order].ravel())
        norms = np.sqrt(np.bincount(np.nonzero(fresh)[0], sums**2, len(words)))
        # products: only the subsequences that some landmark has, each with the landmarks that have it
        rows = self.row[triples]
        word, which = np.nonzero(rows)
        key = rows[word, which]
        times = self.ends[key] - self.begins[key]
        pair = np.repeat(self.begins[key] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        cell = np.repeat(word * len(self.words), times) + self.who[pair]
        found = np.bincount(cell, np.repeat(weights[which], times) * self.weight[pair], len(words) * len(self.words)).reshape(len(words), -1)
        return found / norms[:, None]
