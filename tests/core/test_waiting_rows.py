"""Rows of a large key wait for their turn in few bytes."""

import math
import tracemalloc

import numpy as np
import pandas as pd

from newsmill.streaming import processors
from newsmill.streaming.processors import RecentDuplicates


class Handle:
    def __init__(self):
        self.value = None

    def getListState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = value

    def listTimers(self):
        return []

    def registerTimer(self, millis):
        pass

    def getCurrentWatermarkInMs(self):
        return 0


def test_vectors_come_back_as_they_were():
    made = [None, [], [0.5, -2.0], np.array([0.1, 1e300]), [math.inf, math.nan], np.array([1.0, None], object), np.full(3, np.float32(0.1)), [1e39, 1.0]]
    kept = processors._Vectors()
    kept.add(made[:3])
    kept.add(made[3:])
    kept.done()
    for i, v in enumerate(made):
        want = None if v is None or not len(v) else np.asarray(v, np.float64)
        assert (kept[i] is None) == (want is None) and (want is None or np.array_equal(kept[i], want, equal_nan=True))


def test_waiting_vectors_take_little_more_than_their_entries():
    n, size = 20_000, 64
    vectors = np.random.default_rng(3).standard_normal((n, size)).astype(np.float32).astype(np.float64)
    frames = (
        pd.DataFrame({"article_id": np.arange(i, i + 1000), "time": np.arange(i, i + 1000) * 1_000_000, "title_original": [f"{k * 7919:012d}" for k in range(i, i + 1000)], "embedding": list(vectors[i : i + 1000])})
        for i in range(0, n, 1000)
    )
    processor, handle = RecentDuplicates(1, 5, 1.0, 1e9), Handle()
    processor.init(handle)
    found = processor.handleInputRows(("vi",), frames, handle)
    tracemalloc.start()
    rows = len(next(found))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    rows += sum(map(len, found))
    assert rows == n and held < n * (4 * size + 150)
