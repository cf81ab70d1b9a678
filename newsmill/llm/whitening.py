"""Embedding whitening: leading eigenvectors of the covariance by matrix-free block Lanczos.

Entries become whole numbers x = floor(64 c) + 1,000,000, so that counts, sums S and deviations are exact. The fit
list is each distinct x vector once: a distributed distinct of packed vectors, written to the shared folder. The
covariance V is never made: a pass over the fit list centres its rows, (n x - S) / n, multiplies them by a block of
directions and back, and adds up the products (a row a dimension and task, added by Spark), so the driver and
the tasks hold blocks of a few columns alone.

The driver keeps an orthonormal basis Q and V Q. Each step orthogonalises the last products against the whole
basis, twice; columns that vanish there (a breakdown: the basis holds an invariant space) restart as random
directions orthogonal to it. Ritz vectors come from Q' V Q; the search ends when the leading ones' residuals
|V u - e u| are ``TOLERANCE`` of the greatest eigenvalue, or the basis spans the whole space. A basis that
grows beyond ``MOST_BASIS`` columns starts again from its leading Ritz vectors, with their products. The trace comes
from the deviations, as V = sum of deviations / n^3, and gives the explained shares.

Vectors of one length are a fit of their own; all lengths share each pass.

Defined cases: a vector that is null or holds null, non-finite or unrepresentable (beyond +-2^62 / 64) entries has no
rows; an empty vector has no component, so no rows either; components without variance (of ``LEAST`` of the greatest
eigenvalue or less) aren't given, so equal vectors alone give no rows; a deviation beyond a long is null; a null id
stays null; rows that repeat an id are rows of their own; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.session import materialize, ship_package

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, BLOCK = 16, 24
TOLERANCE, LEAST = 1e-14, 1e-12
#: Columns of a basis, in blocks, before it starts again from its leading vectors.
MOST_BASIS = 40 * BLOCK
LONG = 1 << 62


def pack(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, x): the vectors that count, their whole numbers packed with 4 or 8 bytes each."""
    ship_package(vectors.sparkSession)

    def run(batches):
        for b in batches:
            ids, dims, packed = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                c = v.values
                if c is None or c.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(c.to_numpy().astype(np.float64) * SCALE)
                if not len(x) or not (np.abs(x) < LONG).all():  # also where it isn't a number
                    continue
                x = x.astype(np.int64) + SHIFT
                narrow = x.astype("<i4")
                ids.append(i)
                dims.append(len(x))
                packed.append((narrow if (narrow == x).all() else x.astype("<i8")).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["id", "dim", "x"])

    vec = F.col(vec_col)
    if vectors.schema[vec_col].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).mapInArrow(run, "id long, dim int, x binary")


def by_length(batch: pa.RecordBatch):
    """(dim, row numbers, matrix of whole numbers) for each length of a batch (dim, x)."""
    dims, raw = batch.column("dim").to_numpy(), batch.column("x").to_pylist()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        rows = np.empty((len(at), d), np.int64)
        for width in (4, 8):
            own = [k for k, i in enumerate(at) if len(raw[i]) == width * d]
            rows[own] = np.frombuffer(b"".join(raw[at[k]] for k in own), f"<i{width}").reshape(-1, d)
        yield d, at, rows


@dataclass(frozen=True)
class Centre:
    """Number of distinct vectors and their sums, exact."""

    n: int
    sums: tuple[int, ...]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S: whole numbers, of any size where they need it."""
        n, most = self.n, max(map(abs, self.sums))
        if self.n * int(np.abs(x).max(initial=0)) < LONG and most < LONG:
            return n * x - np.array(self.sums, np.int64)
        return n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.apart(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        y = self.apart(x)
        if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < LONG:
            return (y * y).sum(1).tolist()
        y = y.astype(object)
        return (y * y).sum(1).tolist()


def centres(fit: DataFrame) -> dict[int, Centre]:
    """The centre of each length: sums of high and low halves, added up in tasks, then by Spark."""

    def run(batches):
        for b in batches:
            for d, at, x in by_length(b):
                high, low = x >> 32, x & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([len(at)] * d, pa.int64()), pa.array(high.sum(0)), pa.array(low.sum(0))], ["dim", "j", "n", "high", "low"]
                )

    sums = fit.mapInArrow(run, "dim int, j int, n long, high long, low long")
    sums = sums.groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(20)")).alias("high"), F.sum(F.col("low").cast("decimal(20)")).alias("low"))
    found: dict[int, list] = {}
    for r in sums.orderBy("dim", "j").collect():  # a row a dimension
        found.setdefault(r.dim, []).append((r.n, (int(r.high) << 32) + int(r.low)))
    return {d: Centre(rows[0][0], tuple(s for _, s in rows)) for d, rows in found.items()}


def added(fit: DataFrame, rows: Callable[[int, np.ndarray], np.ndarray], width: int) -> dict[int, np.ndarray]:
    """For each length the sum over the fit list's batches of ``rows(dim, x)``, a matrix of at most ``width`` columns."""
    names = [f"c{i}" for i in range(width)]

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in by_length(b):
                totals[d] = totals.get(d, 0) + rows(d, x)
        for d, y in totals.items():
            y = np.pad(y, ((0, 0), (0, width - y.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(y), pa.int32()), pa.array(range(len(y)), pa.int32()), *map(pa.array, y.T)], ["dim", "j", *names])

    sums = fit.mapInArrow(run, "dim int, j int, " + ", ".join(f"{c} double" for c in names)).groupBy("dim", "j").agg(*(F.sum(c).alias(c) for c in names))
    found: dict[int, list] = {}
    for r in sums.orderBy("dim", "j").collect():  # a row a dimension, a column a direction
        found.setdefault(r.dim, []).append(r[2:])
    return {d: np.array(y) for d, y in found.items()}


class Lanczos:
    """The leading eigenvectors of a symmetric matrix that is known by its products with blocks."""

    def __init__(self, d: int, components: int = COMPONENTS, block: int = BLOCK, most_basis: int = MOST_BASIS, tolerance: float = TOLERANCE, seed: int = 0):
        self.d, self.want, self.width, self.tolerance = d, min(components, d), min(max(block, components), d), tolerance
        self.most = max(most_basis, 3 * self.width)
        self.rng = np.random.default_rng([seed, d])
        self.basis, self.products = np.empty((d, 0)), np.empty((d, 0))
        self.block = self._orthonormal(np.empty((d, 0)))
        self.values, self.vectors, self.done, self.steps = np.empty(0), np.empty((d, 0)), False, 0

    def _orthonormal(self, candidates: np.ndarray) -> np.ndarray:
        """Candidates without what the basis holds, of unit length; what vanishes restarts as random directions."""
        room = min(self.width, self.d - self.basis.shape[1])
        found: list[np.ndarray] = []
        scale = np.abs(self.products).max(initial=0.0)
        for k in range(room + self.width):
            if len(found) == room:
                break
            v = candidates[:, k] if k < candidates.shape[1] else None
            while True:
                restart = v is None
                if restart:
                    v = self.rng.standard_normal(self.d)
                held = np.column_stack([self.basis, *found]) if found else self.basis
                before = np.linalg.norm(v)
                for _ in range(2):  # full reorthogonalisation, twice
                    v = v - held @ (held.T @ v)
                size = np.linalg.norm(v)
                least = 1e-8 * before if restart else max(1e-10 * before, 1e-15 * scale)
                if size > least:
                    v = v / size
                    v = v - held @ (held.T @ v)
                    found.append(v / np.linalg.norm(v))
                    break
                v = None
        return np.column_stack(found) if found else np.empty((self.d, 0))

    def feed(self, product: np.ndarray) -> None:
        """Takes the matrix's product with ``block`` and sets the next block, or ``done``."""
        self.steps += 1
        self.basis, self.products = np.column_stack([self.basis, self.block]), np.column_stack([self.products, product])
        small = self.basis.T @ self.products
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        lead = turns[:, : self.want]
        self.values, self.vectors = values[: self.want], self.basis @ lead
        residuals = self.products @ lead - self.vectors * self.values
        whole = self.basis.shape[1] == self.d
        self.done = whole or self.basis.shape[1] > self.want and (np.linalg.norm(residuals, axis=0) <= self.tolerance * max(values[0], 0.0) * np.sqrt(self.d)).all()
        if self.done:
            self.vectors /= np.linalg.norm(self.vectors, axis=0)
            return
        if self.basis.shape[1] + self.width > self.most:
            keep = turns[:, : 2 * self.want]
            self.basis, self.products = self.basis @ keep, self.products @ keep
            self.block = self._orthonormal(residuals)
            return
        self.block = self._orthonormal(product)


@dataclass(frozen=True)
class Model:
    """What whitens the vectors of a length."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit_models(fit: DataFrame, components: int = COMPONENTS, block: int = BLOCK, most_basis: int = MOST_BASIS) -> dict[int, Model]:
    """The whitening of each length, from the distinct vectors (dim, x)."""
    known = centres(fit)
    if not known:
        return {}
    # The sum of deviations over n^2, a row a length.
    trace = {d: y[0, 0] / known[d].n for d, y in added(fit, lambda d, x: np.array([[sum(known[d].deviations(x)) / known[d].n ** 2]], float), 1).items()}
    searches = {d: Lanczos(d, components, block, most_basis) for d in known}
    while open_ := {d: s.block for d, s in searches.items() if not s.done}:

        def products(d: int, x: np.ndarray) -> np.ndarray:
            c = known[d].centred(x)
            return c.T @ (c @ open_[d]) / known[d].n

        waiting = fit.where(F.col("dim").isin(list(open_)))
        for d, y in added(waiting, products, max(b.shape[1] for b in open_.values())).items():
            searches[d].feed(y[:, : open_[d].shape[1]])
    models = {}
    for d, s in searches.items():
        n = int((s.values > LEAST * max(s.values[0], 0.0)).sum()) if trace[d] > 0 else 0
        models[d] = Model(known[d], s.values[:n], s.vectors[:, :n], s.values[:n] / trace[d] if n else s.values[:0])

    def moments(d: int, x: np.ndarray) -> np.ndarray:
        w = models[d].whiten(x)
        return np.vstack([w.T @ w, w.sum(0)]) / models[d].centre.n

    errors = {}
    for d, y in added(fit, moments, components).items():
        k = len(models[d].values)
        mean = y[-1, :k]
        errors[d] = float(np.abs(y[:k, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return {d: Model(m.centre, m.values, m.vectors, m.explained, errors.get(d, 0.0)) for d, m in models.items()}


RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, **options) -> DataFrame:
    """A row for each vector that counts and each component."""
    packed = materialize(pack(vectors, id_col, vec_col), "packed-vectors")
    models = fit_models(materialize(packed.select("dim", "x").distinct(), "fit-list"), components, **options)

    def run(batches):
        for b in batches:
            ids = b.column("id")
            for d, at, x in by_length(b):
                m = models[d]
                k = len(m.values)
                deviation = pa.array([y if y < 1 << 63 else None for y in m.centre.deviations(x)], pa.int64())
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))
                repeat = pa.array(np.repeat(np.arange(len(at)), k))
                one = np.ones(len(number))
                columns = [ids.take(pa.array(at)).take(repeat), pa.array(number), pa.array((one * m.centre.n).astype(np.int64)), deviation.take(repeat), pa.array(m.whiten(x).ravel())]
                columns += [pa.array(np.tile(m.explained, len(at))), pa.array(one * m.identity_error)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return packed.mapInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
