"""Repeated phrases as an Arrow function: a pattern with a back-reference is quadratic on long texts."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a phrase at least, and how often it stands in a row at least.
PHRASE, TIMES = 10, 3
#: Two hashes modulo a prime each, so that two different stretches are taken for equal once in 2^60 comparisons.
HASHES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_812_433_253))
#: Blocks that are compared at once.
BLOCKS = 1 << 20
#: Characters of a line up to which looking for its pieces costs less than sorting them.
SHORT = 4_000


class _Stretches:
    """Compares stretches of a line by prefix sums of its characters times powers of a base."""

    def __init__(self, codes: np.ndarray):
        self.kinds = []
        for prime, base in HASHES:
            powers = np.ones(len(codes) + 1, np.uint64)
            filled = 1
            while filled < len(powers):  # doubled each time
                more = min(filled, len(powers) - filled)
                powers[filled : filled + more] = powers[:more] * np.uint64(pow(base, filled, prime)) % np.uint64(prime)
                filled += more
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes % np.uint64(prime) * powers[:-1] % np.uint64(prime), out=sums[1:])
            self.kinds.append((np.uint64(prime), powers, sums % np.uint64(prime)))

    def equal(self, at: np.ndarray, size: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Whether the ``size`` characters from ``at`` are those from ``at + apart``."""
        same = np.ones(len(at), bool)
        for prime, powers, sums in self.kinds:
            one = (sums[at + size] + prime - sums[at]) % prime
            other = (sums[at + apart + size] + prime - sums[at + apart]) % prime
            same &= one * powers[apart] % prime == other
        return same


def _periods(codes: np.ndarray) -> np.ndarray:
    """Distances at which a phrase may stand again: those of places whose first characters are the same."""
    n = len(codes) - PHRASE + 1
    h = np.zeros(n, np.uint64)
    for k in range(PHRASE):
        h = h * np.uint64(0x100000001B3) + codes[k : k + n]
    order = np.argsort(h, kind="stable")
    first = np.r_[True, h[order][1:] != h[order][:-1]]
    sizes = np.diff(np.r_[np.flatnonzero(first), n])
    longest = len(codes) // TIMES
    often = sizes[sizes >= TIMES]
    if not len(often):
        return np.empty(0, np.int64)
    if (often * often).sum() > 8 * len(codes):
        return np.arange(PHRASE, longest + 1)
    within = np.repeat(sizes, sizes)
    found = []
    for k in range(1, int(often.max())):
        i = np.flatnonzero((within[k:] >= TIMES) & (np.cumsum(first)[k:] == np.cumsum(first)[:-k]))
        found.append(order[i + k] - order[i])
    every = np.unique(np.concatenate(found))
    return every[(every >= PHRASE) & (every <= longest)]


def _runs(codes: np.ndarray, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """(first place, last place, period): from all these places a phrase of that length stands three times in a row.

    A line that repeats with period s over 3 s characters has, from one multiple of s, a block that equals the next one;
    all blocks of all periods are n log n. Equal blocks side by side are one run, whose ends are found by halving.
    """
    n, stretches, found = len(codes), _Stretches(codes), []
    counts = n // periods - 1
    ends = np.cumsum(counts)
    for part in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(ends // BLOCKS)) + 1):
        s = np.repeat(periods[part], counts[part])
        place = (np.arange(len(s)) - np.repeat(np.r_[0, np.cumsum(counts[part])[:-1]], counts[part])) * s
        equal = stretches.equal(place, s, s)
        goes_on = np.zeros(len(s), bool)
        goes_on[1:] = equal[1:] & equal[:-1] & (s[1:] == s[:-1])
        heads = np.flatnonzero(equal & ~goes_on)
        tails = np.flatnonzero(equal & ~np.r_[goes_on[1:], False])
        p, left, right = s[heads], place[heads], place[tails] + s[tails]
        # To the left and to the right less than a block goes on: halve what may be equal.
        for back in (True, False):
            low = np.zeros(len(p), np.int64)
            high = np.minimum(p - 1, left) if back else np.minimum(p - 1, n - p - right)
            while (open_ := low < high).any():
                middle = (low + high + 1) // 2
                good = stretches.equal(left - middle if back else right, middle, p)
                low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
            left, right = (left - low, right) if back else (left, right + low)
        enough = right - left >= (TIMES - 1) * p
        found += zip(left[enough].tolist(), (right - (TIMES - 1) * p)[enough].tolist(), p[enough].tolist())
    return sorted(found)


def _may_repeat(line: str) -> bool:
    """False where no phrase can stand three times in a row.

    In three repeats of period s, one of the pieces of ten characters that begin at a multiple of ten stands
    again s places later, and from a period of twenty on once more 2 s places later.
    """
    for i in range(0, len(line) - PHRASE + 1, PHRASE):
        piece = line[i : i + PHRASE]
        j = line.find(piece, i + PHRASE)
        while j >= 0:
            if j - i < 2 * PHRASE or line.startswith(piece, 2 * j - i):
                return True
            j = line.find(piece, j + 1)
    return False


def repeated_in_line(line: str) -> int:
    """How often, from left to right and without overlap, the shortest phrase that begins at a place stands three times in a row.

    The work grows with n log n of the line's length, whatever it holds.
    """
    if len(line) < PHRASE * TIMES or len(line) <= SHORT and not _may_repeat(line):
        return 0
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    periods = _periods(codes)
    if not len(periods):
        return 0
    runs = _runs(codes, periods)
    found, at, i = 0, 0, 0
    open_: list[tuple[int, int]] = []  # (period, last place)
    while open_ or i < len(runs):
        if not open_:
            at = max(at, runs[i][0])
        while i < len(runs) and runs[i][0] <= at:
            heappush(open_, (runs[i][2], runs[i][1]))
            i += 1
        while open_ and open_[0][1] < at:
            heappop(open_)
        if open_:
            size, last = open_[0]
            found += 1
            at += ((last - at) // size + TIMES) * size  # all repeats that follow belong to it
    return found


def repeated_phrases(text: Column) -> Column:
    """The number of repeated phrases in a text's lines; none in null."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([sum(map(repeated_in_line, (t or "").split("\n"))) for t in texts.to_pylist()], pa.int64())

    return run(text)
