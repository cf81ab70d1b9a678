"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from newsmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string"


def plain(vectors, most=16):
    """{row: (n, deviation, explained, whitened up to sign)} of the rows that count, and the eigenvalues; whole numbers of any size."""
    rows = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, rows.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums)])
    c = np.array([centred(x) for x in fit])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    trace = (c * c).sum() / n
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), e / trace, centred(x) @ v / np.sqrt(e)) for i, x in rows.items()}, e


def check(found, vectors, ids, rank=16, places=1e-7):
    want, _ = plain(vectors, rank)
    rows = {}
    for r in found:
        rows.setdefault(r[0], {})[r[1]] = r
    assert set(rows) == {ids[i] for i in want}
    signs = None
    for i, (n, deviation, explained, whitened) in want.items():
        got = rows[ids[i]]
        assert sorted(got) == list(range(1, rank + 1))
        assert {(r[2], r[3]) for r in got.values()} == {(n, deviation)}
        here = np.array([got[k][4] for k in range(1, rank + 1)])
        signs = np.sign(here * whitened) if signs is None else signs
        assert np.abs(here * signs - whitened).max() < places * max(1, np.abs(whitened).max())
        assert np.abs([got[k][5] / explained[k - 1] - 1 for k in range(1, rank + 1)]).max() < 1e-9
        assert got[1][6] < 1e-9


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((900, 40)) * np.linspace(3, 0.2, 40) @ rng.standard_normal((40, 40)) / 8 + 0.3).astype(np.float32).tolist()
    x += x[:300] * 2 + [None, [None] + x[0][1:], [float("nan")] + x[0][1:], [float("inf")] + x[1][1:], [3e38] + x[1][1:]]
    x[-1] = None
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in enumerate(x)], SCHEMA).repartition(6)
    check(whitening.whiten(df).collect(), x, list(range(len(x))))


def test_few_dimensions_constant_columns_and_odd_tables(spark):
    rng = np.random.default_rng(2)
    flat = rng.standard_normal((50, 3)) @ rng.standard_normal((3, 12))  # rank 3 before rounding
    x = np.column_stack([flat, np.ones(50)]).tolist()  # a constant entry has no variance
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), x, list(range(50)), 12, 1e-6)
    exact = [[float(i), 2.0 * i, -float(i)] for i in range(20)]  # rank 1, also after rounding
    found = whitening.whiten(spark.createDataFrame(list(enumerate(exact)), "vec_id long, embedding array<double>")).collect()
    assert len(found) == 20 and {r[1] for r in found} == {1} and abs(found[0].explained - 1) < 1e-12
    for odd in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(None, [1.0])]):
        assert whitening.whiten(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).count() == 0


def test_lengths_are_fits_of_their_own_and_numbers_may_be_great(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((60, 5)).tolist(), (rng.standard_normal((70, 20)) * 2.0**50).tolist()
    rows = [(i, v) for i, v in enumerate(a + b)] + [(1000, [1e300] * 5)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    check([r for r in found if r.id < 60], a, list(range(60)), 5)
    great = [r for r in found if r.id >= 60]
    assert {r.id for r in great} == set(range(60, 130)) and {r.deviation for r in great} == {None}
    want, _ = plain(b)
    assert abs(max(r.whitened for r in great if r.component == 1 and r.id == 60).__abs__() - abs(want[0][3][0])) < 1e-6


@pytest.mark.parametrize("d,most_basis", [(1, 960), (17, 960), (200, 960), (300, 100)])
def test_lanczos_finds_the_leading_space(d, most_basis):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.sort(np.r_[rng.exponential(1, d - d // 3), np.zeros(d // 3)])[::-1] + 0.0
    e[:3] = e[0] + 1  # equal eigenvalues
    m = (q * e) @ q.T
    s = whitening.Lanczos(d, most_basis=most_basis)
    while not s.done:
        assert s.basis.shape[1] <= max(most_basis, d) and s.steps < 400
        s.feed(m @ s.block)
    k = min(16, d)
    assert np.abs(s.values - e[:k]).max() < 1e-12 * e[0]
    assert np.abs(m @ s.vectors - s.vectors * s.values).max() < 1e-11 * e[0]
    assert np.abs(s.vectors.T @ s.vectors - np.eye(k)).max() < 1e-12


def test_breakdown_restarts_with_new_directions():
    """A start inside an invariant space: the basis must leave it."""
    d = 60
    e = np.r_[np.zeros(40), np.linspace(1, 5, 20)]
    s = whitening.Lanczos(d, components=4, block=4)
    s.block = np.eye(d)[:, :4]  # the null space
    while not s.done:
        s.feed(e[:, None] * s.block)
    assert np.abs(s.values - e[::-1][:4]).max() < 1e-12


def test_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, 18)).astype(np.float32).tolist() + [None]
    spark.createDataFrame([(i, v, 0, "", "") for i, v in enumerate(x)], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.query(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(got.collect(), x, list(range(41)))
