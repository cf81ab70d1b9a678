"""Embedding near-dedup of vectors that have a direction in common, near the threshold."""

import numpy as np
import pytest
from test_chunks_and_vectors import brute, found


@pytest.mark.parametrize("d, offset, falling", [(64, 0.9, False), (64, 0.9, True), (384, 0.8, True)])
def test_recall_with_a_common_offset(spark, d, offset, falling):
    rng = np.random.default_rng(d)
    scale = 1.0 / np.arange(1, d + 1) if falling else np.ones(d)
    x = rng.standard_normal((150, d)) * scale / np.linalg.norm(scale) * np.sqrt(1 - offset)
    x[:, -1] += np.sqrt(offset)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = x[rng.permutation(150)] - x  # towards another vector, where the data spread most
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True) + 1e-12
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * away
    rows = [(i, v, 1 + i % 2) for i, v in enumerate(x.tolist())] + [(150 + i, v, 1 + i % 2) for i, v in enumerate(y.tolist())]
    exact, got = brute(rows), found(spark, rows)
    links = sum(n for n, _ in exact.values())
    assert links >= 200
    assert sum(n for n, _ in got.values()) >= 0.98 * links
