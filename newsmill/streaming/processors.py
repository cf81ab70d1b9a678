"""Keyed state of the sequential jobs: what a key's fold carries from one trigger to the next.

Rows of a key and trigger are taken in the order of (time, id), so equal times have an order; a trigger's size
is bounded at the source (``maxFilesPerTrigger``), and the state holds what the rule can still ask for.

Keys are few where a window or a breaker belongs to a language or a source, so a trigger may bring a key many rows. Those
processors take and give frames of bounded size: a row waits for its turn as a few numbers in arrays, not as an object, and what is decided leaves at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from newsmill.functions.recent import Recent

KEPT = "id long, time long, title string, vec array<double>"
#: Rows of a frame that a processor gives.
CHUNK = 10_000


class _Pieces:
    """Many short pieces of bytes in one piece of memory."""

    def __init__(self):
        self.bytes, self.ends = bytearray(), [np.zeros(1, np.int64)]

    def put(self, coded: list[bytes]) -> None:
        self.ends.append(np.cumsum([len(x) for x in coded], dtype=np.int64) + len(self.bytes))
        self.bytes += b"".join(coded)

    def done(self) -> _Pieces:
        self.ends = np.concatenate(self.ends)
        return self

    def piece(self, i: int) -> bytes:
        return bytes(self.bytes[self.ends[i] : self.ends[i + 1]])


class _Texts(_Pieces):
    """Texts, null ones among them."""

    def add(self, texts: list) -> None:
        self.put([b"\xff" if t is None else t.encode("utf-8", "surrogatepass") for t in texts])  # no text has that byte

    def __getitem__(self, i: int) -> str | None:
        x = self.piece(i)
        return None if x == b"\xff" else x.decode("utf-8", "surrogatepass")


class _Vectors(_Pieces):
    """Vectors of any lengths; null ones are empty. What four bytes an entry hold exactly takes no more."""

    def add(self, vectors: list) -> None:
        self.put([b"" if v is None else self._coded(np.asarray(v, np.float64)) for v in vectors])

    @staticmethod
    def _coded(v: np.ndarray) -> bytes:
        with np.errstate(over="ignore", invalid="ignore"):
            short = v.astype(np.float32)
        return b"f" + short.tobytes() if (short == v).all() else b"d" + v.tobytes()

    def __getitem__(self, i: int) -> np.ndarray | None:
        x = self.piece(i)
        return np.frombuffer(x, x[:1].decode(), offset=1).astype(np.float64) if len(x) > 1 else None


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    found = np.concatenate(parts) if parts else np.zeros(0, kind)
    parts.clear()
    return found


class _Expiring(StatefulProcessor):
    """One timer a key, for the time at which its state has nothing left that counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def expire_at(self, millis: int, timers) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(millis, timers.getCurrentWatermarkInMs() + 1))


class RecentDuplicates(_Expiring):
    """Titles and vectors of the last kept articles of a key; rows (article_id, time, title_original, embedding) to (article_id, layer, like)."""

    def __init__(self, hours: int, most: int, title_threshold: float, embed_threshold: float):
        self.rule = (hours, most, title_threshold, embed_threshold)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getListState("kept", KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window, last = Recent(*self.rule), None
        for e in self.kept.get() if self.kept.exists() else ():
            window.keep(*e)
        ids, times, titles, vectors = [], [], _Texts(), _Vectors()
        for f in rows:
            ids.append(f["article_id"].to_numpy(np.int64))
            times.append(f["time"].to_numpy(np.int64))
            titles.add([None if t is None or t != t else t for t in f["title_original"]])
            vectors.add([None if v is None or isinstance(v, float) else v for v in f["embedding"]])
        ids, times, titles, vectors = _joined(ids, np.int64), _joined(times, np.int64), titles.done(), vectors.done()
        order = np.lexsort((ids, times))
        for start in range(0, len(order), CHUNK):
            part = order[start : start + CHUNK]
            found = [window.arrive(int(ids[i]), int(times[i]), titles[i], vectors[i]) or (None, None) for i in part.tolist()]
            last = int(times[part[-1]])
            yield pd.DataFrame({"article_id": ids[part], "layer": pd.array([x for x, _ in found], "Int32"), "like": pd.array([x for _, x in found], "Int64")})
        entries = window.entries(last)
        if entries:
            self.kept.put(entries)
            self.expire_at(entries[-1][1] // 1000 + self.rule[0] * 3_600_000 + 1, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())


class Caps(_Expiring):
    """Accepted times and kinds of a user; rows (user_id, article_id, action, time) to the same and accepted."""

    def __init__(self, by_type: dict[str, int], overall: int, hours: int):
        self.by_type, self.overall, self.span = by_type, overall, hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getListState("accepted", "time long, kind string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        live = [(t, k) for t, k in self.accepted.get()] if self.accepted.exists() else []
        for r in sorted(rows, key=lambda r: (r.time, r.article_id is not None, r.article_id or 0, r.action)):
            live = [(t, k) for t, k in live if r.time - t < self.span]
            ok = len(live) < self.overall and sum(k == r.action for _, k in live) < self.by_type.get(r.action, self.overall)
            if ok:
                live.append((r.time, r.action))
            yield Row(user_id=r.user_id, article_id=r.article_id, action=r.action, time=r.time, accepted=ok)
        if live:
            self.accepted.put(live)
            self.expire_at((max(t for t, _ in live) + self.span) // 1000 + 1, timerValues)
        else:
            self.accepted.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.accepted.clear()
        return iter(())


class Breaker(StatefulProcessor):
    """A source's breaker; rows (source_id, attempt_id, time, ok) to (source_id, time, state). Its state stays: it is three values a source."""

    def __init__(self, most_failures: int, open_seconds: int):
        self.most_failures, self.open_for = most_failures, open_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "now string, failures int, opened long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, failures, opened = self.state.get() if self.state.exists() else ("closed", 0, 0)
        times, ids, good = [], [], []
        for f in rows:
            times.append(f["time"].to_numpy(np.int64))
            ids.append(f["attempt_id"].to_numpy(np.int64))
            good.append(f["ok"].to_numpy(bool))
        times, ids, good = _joined(times, np.int64), _joined(ids, np.int64), _joined(good, bool)
        order = np.lexsort((ids, times))
        del ids
        for start in range(0, len(order), CHUNK):
            part = order[start : start + CHUNK]
            at, states = times[part], []
            for time, ok in zip(at.tolist(), good[part].tolist()):
                if now == "open" and time - opened >= self.open_for:
                    now = "half_open"
                if now != "open":
                    if ok:
                        now, failures = "closed", 0
                    else:
                        failures += 1
                        if now == "half_open" or failures >= self.most_failures:
                            now, opened = "open", time
                states.append(now)
            yield pd.DataFrame({"source_id": np.full(len(at), key[0], np.int64), "time": at, "state": states})
        self.state.update((now, failures, opened))
