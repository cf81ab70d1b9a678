"""The articles that were kept last, and which of them an arriving one resembles: a fold in arrival order."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

class Common:
    """How long a common subsequence a title has with each of many others, all at once.

    Each of the others has a field of bits in one whole number, a bit a character; a step a character of the title does for all fields what
    the bit-parallel algorithm of the longest common subsequence does for one.
    """

    def __init__(self, fields: int):
        self.titles, self.width = [""] * fields, 64
        self._fill()

    def _fill(self) -> None:
        self.at, self.ones = {}, 0
        for i, t in enumerate(self.titles):
            self._set(i, t)

    def _set(self, i: int, title: str) -> None:
        place = i * self.width
        self.ones |= (1 << len(title)) - 1 << place
        for k, c in enumerate(title):
            self.at[c] = self.at.get(c, 0) | 1 << place + k

    def put(self, i: int, title: str) -> None:
        old, self.titles[i] = self.titles[i], title
        if len(title) >= self.width:  # a bit more for what is carried
            self.width = 64 * (len(title) // 64 + 1)
            self._fill()
            return
        gone = (1 << self.width) - 1 << i * self.width
        self.ones &= ~gone
        for c in set(old):
            self.at[c] &= ~gone
        self._set(i, title)

    def lengths(self, title: str) -> np.ndarray:
        v, ones = self.ones, self.ones
        for c in title:
            if m := self.at.get(c):
                u = v & m
                v = (v + u | v & ~m) & ones
        left = np.frombuffer(v.to_bytes(len(self.titles) * self.width // 8, "little"), np.uint64).reshape(len(self.titles), -1)
        return np.array([len(t) for t in self.titles]) - np.bitwise_count(left).sum(1, dtype=np.int64)


def _masks(a: str) -> dict[str, int]:
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    return at


def common_length(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """The length of a longest common subsequence; ``at`` are the places of a's letters, if they are known."""
    at = _masks(a) if at is None else at
    ones = v = (1 << len(a)) - 1
    for c in b:
        if m := at.get(c):
            u = v & m
            v = (v + u | v & ~m) & ones
    return len(a) - v.bit_count()


class Near:
    """Which of the titles before one have a ratio of ``least`` with it; null titles have none.

    The letters that two titles share bound the ratio from above, for all at once (letters of one class count as equal);
    then a longest common subsequence does, and what is left is judged.
    """

    #: Classes of letters, and characters below which equal titles are known to have a ratio of one.
    CLASSES, PLAIN = 64, 200

    def __init__(self, titles: list[str | None], least: float):
        self.titles, self.least = titles, least
        self.sizes = np.array([-1 if t is None else len(t) for t in titles], np.int64)
        self.letters = np.zeros((len(titles), self.CLASSES), np.uint8 if max(self.sizes, default=0) < 256 else np.int32)
        for i, t in enumerate(titles):
            if t:
                self.letters[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % self.CLASSES, minlength=self.CLASSES)

    def before(self, i: int, since: int) -> list[int]:
        title, size = self.titles[i], int(self.sizes[i])
        if title is None or since >= i:
            return []
        sizes = self.sizes[since:i]
        needed = self.least * (sizes + size)
        may = np.flatnonzero((sizes >= 0) & (2.0 * np.minimum(sizes, size) >= needed))
        shared = np.minimum(self.letters[since:i][may], self.letters[i]).sum(1, dtype=np.int64)
        may = may[2.0 * shared >= needed[may] - 1e-9]
        at, found = None, []
        for j, need in zip((may + since).tolist(), needed[may].tolist()):
            other = self.titles[j]
            if size < self.PLAIN and other == title:
                same = self.least <= 1.0
            else:
                at = at or _masks(title)
                same = 2.0 * common_length(title, other, at) >= need - 1e-9 and SequenceMatcher(None, title, other).ratio() >= self.least
            if same:
                found.append(j)
        return found


class Close:
    """Which of the vectors before one may have a product of ``least`` with it: all that do, and some that miss it by a rounding."""

    def __init__(self, vectors: list[list[float] | None], least: float):
        self.least, self.at, self.of = least, {}, {}
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v is not None:
                by_size.setdefault(len(v), []).append(i)
        for size, places in by_size.items():
            m = np.array([vectors[i] for i in places], np.float64).reshape(len(places), size)
            self.of[size] = (np.array(places), m, np.sqrt((m * m).sum(1)))
            self.at |= {i: (size, k) for k, i in enumerate(places)}

    def before(self, i: int, since: int) -> list[int]:
        if i not in self.at:
            return []
        size, k = self.at[i]
        places, m, norms = self.of[size]
        first = int(np.searchsorted(places, since))
        with np.errstate(invalid="ignore", over="ignore"):
            far = m[first:k] @ m[k] < self.least - 1e-9 * (1.0 + norms[first:k] * norms[k])
        return places[first:k][~far].tolist()


class Recent:
    """At most ``most`` kept articles of the last ``hours``; times are microseconds.

    An arrival duplicates the newest kept one of a similar title, else the kept one of the
    most similar vector (of equal ones the newest). Only what duplicates nothing is kept.
    Null titles are empty; null vectors resemble nothing, nor do vectors of different lengths.
    """

    def __init__(self, hours: int, most: int, title_threshold: float, embed_threshold: float):
        self.span, self.most, self.title_threshold, self.embed_threshold = hours * 3_600_000_000, most, title_threshold, embed_threshold
        self.ids, self.times, self.titles = [None] * most, np.full(most, np.iinfo(np.int64).min), [""] * most
        self.sizes, self.common = np.zeros(most, np.int64), Common(most)
        self.vectors: dict[int, np.ndarray] = {}  # by length; a row without a vector is null
        self.next, self.filled = 0, 0

    def entries(self, now: int | None = None) -> list[tuple]:
        """(id, time, title, vector) from the oldest on, of those that an arrival at ``now`` would meet."""
        at = [(self.next - self.filled + k) % self.most for k in range(self.filled)]
        found = []
        for i in at:
            if now is None or self.times[i] >= now - self.span:
                vec = next((m[i].tolist() for m in self.vectors.values() if not np.isnan(m[i, 0])), None)
                found.append((self.ids[i], int(self.times[i]), self.titles[i], vec))
        return found

    def met(self, now: int) -> list:
        """The ids of :meth:`entries`."""
        at = [(self.next - self.filled + k) % self.most for k in range(self.filled)]
        return [self.ids[i] for i in at if self.times[i] >= now - self.span]

    def keep(self, id_: int, time: int, title: str | None, vector) -> None:
        i = self.next
        self.ids[i], self.times[i], self.titles[i] = id_, time, title or ""
        self.sizes[i] = len(title or "")
        self.common.put(i, title or "")
        for m in self.vectors.values():
            m[i] = np.nan
        if vector is not None and len(vector):
            self.vectors.setdefault(len(vector), np.full((self.most, len(vector)), np.nan))[i] = vector
        self.next, self.filled = (i + 1) % self.most, min(self.filled + 1, self.most)

    def like(self, time: int, title: str | None, vector) -> tuple[int, int] | None:
        """(layer, id) of the kept article that an arrival duplicates."""
        age = (self.next - 1 - np.arange(self.most)) % self.most
        open_ = (age < self.filled) & (self.times >= time - self.span)
        title = title or ""
        # The blocks that the ratio counts are a common subsequence, so its length bounds them.
        may = np.flatnonzero(open_ & (2.0 * self.common.lengths(title) >= self.title_threshold * (self.sizes + len(title))))
        for i in may[np.argsort(age[may])].tolist():
            if SequenceMatcher(None, title, self.titles[i]).ratio() >= self.title_threshold:
                return 2, self.ids[i]
        if vector is not None and (m := self.vectors.get(len(vector))) is not None:
            with np.errstate(invalid="ignore", over="ignore"):  # a matrix product rounds by a row's place, so equal vectors might differ
                scores = np.where(open_, (m * np.asarray(vector, np.float64)).sum(1), -np.inf)
            scores[np.isnan(scores)] = -np.inf
            best = scores.max()
            if best >= self.embed_threshold:
                at = np.flatnonzero(scores == best)
                return 3, self.ids[at[np.argmin(age[at])]]
        return None

    def arrive(self, id_: int, time: int, title: str | None, vector) -> tuple[int, int] | None:
        """:meth:`like`, and keeps what is like nothing."""
        found = self.like(time, title, vector)
        if found is None:
            self.keep(id_, time, title, vector)
        return found


class Whole(Recent):
    """All kept articles of the last ``hours``, however many: there are more places as long as the oldest one is still met."""

    def __init__(self, hours: int, title_threshold: float, embed_threshold: float, places: int = 8):
        super().__init__(hours, places, title_threshold, embed_threshold)
        self.hours = hours

    def keep(self, id_: int, time: int, title: str | None, vector) -> None:
        if self.filled == self.most and self.times[self.next] >= time - self.span:
            met = self.entries(time)
            self.__init__(self.hours, self.title_threshold, self.embed_threshold, 2 * self.most)
            for e in met:
                super().keep(*e)
        super().keep(id_, time, title, vector)


class Vectors:
    """Vectors of one length that were kept in the last ``span``, in the order of their times."""

    def __init__(self, size: int, span: int, least: float):
        self.span, self.least, self.low, self.high = span, least, 0, 0
        self.ids, self.times, self.m, self.norms = np.zeros(8, np.int64), np.zeros(8, np.int64), np.zeros((8, size)), np.zeros(8)

    def _open(self, time: int) -> None:
        self.low += int(np.searchsorted(self.times[self.low : self.high], time - self.span))

    def best(self, time: int, vector: np.ndarray) -> int | None:
        """The id of the greatest product of ``least`` or more, of equal ones the newest."""
        self._open(time)
        m, norms = self.m[self.low : self.high], self.norms[self.low : self.high]
        with np.errstate(invalid="ignore", over="ignore"):
            far = m @ vector < self.least - 1e-9 * (1.0 + norms * np.sqrt((vector * vector).sum()))
            may = np.flatnonzero(~far)
            scores = (m[may] * vector).sum(1)  # a matrix product rounds by a row's place, so equal vectors might differ
        scores[np.isnan(scores)] = -np.inf
        if not len(may) or (best := scores.max()) < self.least:
            return None
        return int(self.ids[self.low + may[np.flatnonzero(scores == best)[-1]]])

    def keep(self, id_: int, time: int, vector: np.ndarray) -> None:
        if self.high == len(self.ids):
            self._open(time)
            held = self.high - self.low
            for name in ("ids", "times", "m", "norms"):
                old = getattr(self, name)
                new = np.zeros((max(8, 2 * held), *old.shape[1:]), old.dtype)
                new[:held] = old[self.low : self.high]
                setattr(self, name, new)
            self.low, self.high = 0, held
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.sqrt((vector * vector).sum())
        self.ids[self.high], self.times[self.high], self.m[self.high], self.norms[self.high] = id_, time, vector, norm
        self.high += 1


class Grouped:
    """:class:`Recent` over all kept articles of the last ``hours``, where it is known which titles can't resemble one another: those of different groups."""

    def __init__(self, hours: int, title_threshold: float, embed_threshold: float):
        self.hours, self.span, self.title_threshold, self.embed_threshold = hours, hours * 3_600_000_000, title_threshold, embed_threshold
        self.titles: dict[int, tuple[int, Whole]] = {}  # the newest time of a group, and what it kept
        self.vectors: dict[int, Vectors] = {}
        self.many = 64

    def arrive(self, id_: int, time: int, title: str | None, vector, group: int) -> tuple[int, int] | None:
        """(layer, id) of the kept article that an arrival duplicates; keeps what is like nothing."""
        kept = self.titles.get(group)
        found = kept[1].like(time, title, None) if kept else None
        if found is not None:
            return found
        if vector is not None and len(vector):
            vector = np.asarray(vector, np.float64)
            near = self.vectors.setdefault(len(vector), Vectors(len(vector), self.span, self.embed_threshold))
            if (like := near.best(time, vector)) is not None:
                return 3, like
            near.keep(id_, time, vector)
        whole = kept[1] if kept else Whole(self.hours, self.title_threshold, self.embed_threshold, 2)
        whole.keep(id_, time, title, None)
        self.titles[group] = time, whole
        if len(self.titles) > self.many:  # groups that the window has left
            self.titles = {k: x for k, x in self.titles.items() if x[0] >= time - self.span}
            self.many = max(64, 2 * len(self.titles))
        return None
