"""Which titles of one list have a ratio of some least with which of another, all of a block at once."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

from newsmill.functions.recent import common_length


class Alike:
    """The titles that others are held against.

    The letters that two titles share bound the ratio from above (letters of one class count as equal), then their longest
    common subsequence does, by its bit-parallel algorithm for many pairs at once; what is left is judged.
    """

    #: Classes of letters; characters below which equal titles are known to have a ratio of one; characters of titles whose subsequences are found at once; how many pairs, and how many words of masks, at once.
    CLASSES, PLAIN, LONG, PAIRS, MASKS = 64, 200, 256, 1 << 14, 1 << 21

    def __init__(self, titles: list[str], least: float):
        self.titles, self.least = titles, least
        points = [self._points(t) for t in titles]
        self.sizes = np.array([len(p) for p in points], np.int64)
        longest = int(self.sizes.max(initial=0))
        self.letters = np.zeros((self.CLASSES, len(titles)), np.uint8 if longest < 256 else np.int32)
        self.known = np.unique(np.concatenate(points)) if points else np.zeros(0, np.int64)
        self.text = np.full((min(longest, self.LONG), len(titles)), len(self.known), np.int32)  # a row a place, so that a step reads one row
        for i, p in enumerate(points):
            self.letters[:, i] = np.bincount(p % self.CLASSES, minlength=self.CLASSES)
            if len(p) <= self.LONG:
                self.text[: len(p), i] = np.searchsorted(self.known, p)

    @staticmethod
    def _points(title: str) -> np.ndarray:
        return np.frombuffer(title.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)

    def _may(self, size: int, points: np.ndarray) -> np.ndarray:
        need = self.least * (self.sizes + size)
        kind = self.letters.dtype
        shared = np.zeros(len(self.titles), kind)  # no more than a title has letters, so a byte is enough where letters are bytes
        counts = np.minimum(np.bincount(points % self.CLASSES, minlength=self.CLASSES), np.iinfo(kind).max).astype(kind)
        for k in np.flatnonzero(counts):
            shared += np.minimum(self.letters[k], counts[k])
        return np.flatnonzero((2.0 * np.minimum(self.sizes, size) >= need) & (2.0 * shared >= need - 1e-9))

    def _common(self, points: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The lengths of longest common subsequences of pairs: ``points`` of places u with this side's titles at v; none is long."""
        letters, words = len(self.known) + 1, max(1, -(-max(map(len, points)) // 64))
        masks, ones = np.zeros((words, len(points) * letters), np.uint64), np.zeros((words, len(points)), np.uint64)
        for k, p in enumerate(points):
            at = np.searchsorted(self.known, p)
            here = np.flatnonzero(np.r_[self.known, -1][at] == p)
            place = np.arange(len(p))
            np.bitwise_or.at(masks, (here // 64, k * letters + at[here]), np.uint64(1) << (here % 64).astype(np.uint64))
            np.bitwise_or.at(ones, (place // 64, np.full(len(p), k)), np.uint64(1) << (place % 64).astype(np.uint64))
        base, left = u * letters, [x[u] for x in ones]
        for row in self.text[: int(self.sizes[v].max(initial=0))]:
            at, carry = base + row[v], None
            for w in range(words):
                m, x = masks[w][at], left[w]
                s = x + (x & m)
                over = s < x
                if carry is not None:
                    s += carry
                    over |= s < carry
                left[w] = s | (x & ~m)
                carry = over.astype(np.uint64)
        open_ = sum(np.bitwise_count(x & o[u]).astype(np.int64) for x, o in zip(left, ones))
        return np.array([len(p) for p in points], np.int64)[u] - open_

    def links(self, others: list[str], judged: bool = True) -> Iterator[tuple[int, np.ndarray]]:
        """(place in ``others``, places here) of titles with a ratio of ``least``, ``others`` first; unless ``judged``, of all whose common subsequence doesn't rule that out."""
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        pairs = 0
        most = max(1, self.MASKS // (len(self.known) + 1))
        for k, title in enumerate(others):
            points = self._points(title)
            may = self._may(len(points), points)
            if len(may):
                held.append((k, points, may))
                pairs += len(may)
            if pairs >= self.PAIRS or len(held) * max(1, self.LONG // 64) >= most:
                yield from self._left(others, held, judged)
                held, pairs = [], 0
        if held:
            yield from self._left(others, held, judged)

    def _left(self, others: list[str], held: list, judged: bool) -> Iterator[tuple[int, np.ndarray]]:
        u = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
        v = np.concatenate([x[2] for x in held])
        sizes = np.array([len(x[1]) for x in held])[u]
        common = np.zeros(len(u), np.int64)
        short = (sizes <= self.LONG) & (self.sizes[v] <= self.LONG)
        if short.any():
            common[short] = self._common([x[1] if len(x[1]) <= self.LONG else x[1][:0] for x in held], u[short], v[short])
        for i in np.flatnonzero(~short).tolist():
            common[i] = common_length(others[held[u[i]][0]], self.titles[v[i]])
        near = 2.0 * common >= self.least * (sizes + self.sizes[v]) - 1e-9
        u, v = u[near], v[near]
        for i in np.unique(u).tolist():
            k, found = held[i][0], v[u == i]
            if judged:
                found = found[[self._same(others[k], self.titles[j]) for j in found.tolist()]]
            if len(found):
                yield k, found

    def _same(self, title: str, other: str) -> bool:
        if len(title) < self.PLAIN and title == other:
            return self.least <= 1.0
        return SequenceMatcher(None, title, other).ratio() >= self.least
