"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking.

Vectors are compared only within a label. Equal vectors of a label are one row with a weight.
Iterative quantisation centres a bounded sample, projects it on its principal components and
turns these by the rotation that brings them closest to their own signs; several rotations
from different starts give ``CODE_BITS`` balanced bits. These tell vectors apart well, but the
angle around the mean is wider than the vectors' own where they have a common direction. So
``ANGLE_BITS`` more are the signs of the uncentred vectors along random orthogonal directions.
The code is cut into substrings; each is a table, and vectors that agree on a substring are
candidates. Two vectors of cosine c differ in an angle bit with probability acos(c) / pi,
whatever the other vectors are; at 0.98 a 16-bit substring agrees with probability 0.35, one of
16 with probability 0.999. Candidates first meet with their codes alone: a pair whose angle bits
differ in more places than a linked pair's do (by eight deviations) goes, and only vectors that
still have a candidate travel. These are reranked with the original vectors in double precision; a
link counts in the first table that holds it, so links of a vector are sums over tables, without
any list of pairs.

The fit reads at most ``SAMPLE`` vectors (those of the smallest hashes) of each of the ``FITTED``
commonest vector lengths; all vectors are indexed. Vectors of other lengths have more angle bits
in the place of learned ones.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components,
and one with a null label, links with nothing; vectors of different lengths aren't compared;
rows with a null id get their vector's component but name none; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.llm.linking import candidate_groups, components, link_groups, meeting
from newsmill.session import materialize, ship_package

#: Vectors that the fit reads at most, whatever the table's size.
SAMPLE = 8192
CODE_BITS, ANGLE_BITS, TABLE_BITS, ROUNDS = 256, 256, 16, 30
#: Vector lengths that get a quantiser of their own, the commonest.
FITTED = 64


def quantiser(sample: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection with a column a bit), learned from the rows of ``sample``."""
    d = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    width = min(d, 64)
    basis = vectors[:, ::-1][:, :width]
    projected = centred @ basis
    rng = np.random.default_rng(seed)
    columns: list[np.ndarray] = []
    while sum(c.shape[1] for c in columns) < CODE_BITS:
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(ROUNDS):
            codes = np.where(projected @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(codes.T @ projected)
            turn = vt.T @ u.T
        columns.append(basis @ turn)
    return mean, np.concatenate(columns, axis=1)[:, :CODE_BITS]


def directions(d: int, bits: int = ANGLE_BITS, seed: int = 0) -> np.ndarray:
    """Random directions as columns, orthogonal as far as there are dimensions; those of a length are always the same."""
    rng = np.random.default_rng([d, seed])
    frames = [np.linalg.qr(rng.standard_normal((d, min(d, bits))))[0] for _ in range(-(-bits // d))]
    return np.concatenate(frames, axis=1)[:, :bits]


def most_apart(cosine: float) -> int:
    """Angle bits in which vectors of at least this cosine differ at most, up to eight deviations."""
    p = np.arccos(min(max(cosine, -1.0), 1.0)) / np.pi
    return int(np.ceil(ANGLE_BITS * p + 8 * np.sqrt(ANGLE_BITS * p * (1 - p))))


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length, as doubles, from packed floats or doubles."""
    rows = column.to_pylist()
    kind = "<f4" if rows and len(rows[0]) == 4 * dim else "<f8"
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _fit(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").toArrow()
    return quantiser(_matrix(sample.column("vec"), dim))


def _pack(vectors: DataFrame) -> DataFrame:
    """Arrays of numbers to packed numbers of their own width."""
    ship_package(vectors.sparkSession)
    width = 4 if vectors.schema["vec"].dataType.elementType.typeName() == "float" else 8

    def run(batches):
        for b in batches:
            packed = [np.array(v, f"<f{width}").tobytes() for v in b.column("vec").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([len(p) // width for p in packed], pa.int32()), pa.array(packed, pa.binary())], ["id", "label", "dim", "vec"])

    return vectors.mapInArrow(run, "id long, label string, dim int, vec binary")


def encode(rows: DataFrame) -> DataFrame:
    """``rows`` (with dim, vec) and their code as bytes, the angle bits last."""
    common = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(FITTED).collect()
    models = {r.dim: _fit(rows, r.dim) for r in common}
    names = rows.columns

    def run(batches):
        for b in batches:
            code = np.empty((b.num_rows, (CODE_BITS + ANGLE_BITS) // 8), np.uint8)
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                mean, projection = models.get(d) or (0.0, directions(d, CODE_BITS, 1))
                x = _matrix(b.column("vec").take(pa.array(at)), d)
                bits = np.concatenate([(x - mean) @ projection >= 0, x @ directions(d) >= 0], axis=1)
                code[at] = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary())], [*names, "code"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", code binary")


def angle_check(least: float):
    """Pairs that may be linked, by their angle bits."""
    most = most_apart(least)

    def check(table: pa.Table):
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), "<u8").reshape(table.num_rows, -1)[:, CODE_BITS // 64 :]
        return lambda a, b: np.bitwise_count(codes[a] ^ codes[b]).sum(1, dtype=np.int64) <= most

    return check


def cosine_check(least: float):
    step = TABLE_BITS // 8

    def check(table: pa.Table):
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1, step)
        of = table.column("table").to_numpy()
        # A colliding bucket name may bring other lengths or labels together; they are told apart.
        kind = np.array([hash(k) for k in zip(table.column("label").to_pylist(), table.column("dim").to_pylist())])
        dims = table.column("dim").to_numpy()
        by_dim, place = {}, np.zeros(table.num_rows, np.int64)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            by_dim[d] = _matrix(table.column("vec").take(pa.array(at)).combine_chunks(), int(d))
            place[at] = np.arange(len(at))

        def linked(a, b):
            same = kind[a] == kind[b]
            cosine = np.full(len(a), -2.0)
            for d, x in by_dim.items():
                at = np.flatnonzero(same & (dims[a] == d))
                for part in np.array_split(at, max(1, len(at) * int(d) >> 22)):
                    cosine[part] = np.einsum("ij,ij->i", x[place[a[part]]], x[place[b[part]]])
            link = cosine >= least
            counted = np.zeros(len(a), bool)
            at = np.flatnonzero(link)
            first = (codes[a[at]] == codes[b[at]]).all(2).argmax(1)
            counted[at] = first == of[a[at]]
            return link, counted

        return linked

    return check


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least_cosine: float = 0.98) -> DataFrame:
    """(id, links, component) of every row: vectors linked directly, and the smallest id that links reach."""
    floats = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    vec = F.col(vec_col) if floats else F.col(vec_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    valid = F.col("label").isNotNull() & _valid(F.col("vec"))
    # Null components would fail the packing; such rows never get there.
    packed = materialize(_pack(named.where(valid)), "vectors")
    same = packed.groupBy("label", "dim", "vec").agg(F.min("id").alias("member"), F.count(F.lit(1)).alias("weight"))
    coded = materialize(encode(materialize(same, "distinct-vectors")), "codes")
    tables = F.transform(
        F.sequence(F.lit(0), F.lit((CODE_BITS + ANGLE_BITS) // TABLE_BITS - 1)),
        lambda t: F.struct(t.alias("t"), F.substring(F.hex("code"), t * (TABLE_BITS // 4) + 1, F.lit(TABLE_BITS // 4)).alias("k")),
    )
    keys = coded.where("member IS NOT NULL").select("label", "dim", "member", F.explode(tables).alias("x"))
    keys = keys.select(F.xxhash64("label", "dim", "x.t", "x.k").alias("bucket"), F.struct("member", F.col("x.t").alias("t")).alias("member"))
    groups = candidate_groups(keys).select("bucket", "first", "second", "block", F.col("member.member").alias("member"), F.col("member.t").alias("table"))
    may = materialize(meeting(groups.join(coded.select("member", "code"), "member"), angle_check(least_cosine)), "candidates")
    groups = may.join(coded, "member")
    linked = materialize(link_groups(groups, cosine_check(least_cosine), weighted=True), "stars")
    counts = linked.groupBy("member").agg(F.sum("links").alias("n"))
    found = components(linked.select(F.col("member").alias("u"), F.col("root").alias("v")))
    own = coded.select("label", "dim", "vec", "member", "weight").join(counts, "member", "left")
    own = own.join(found.withColumnRenamed("node", "member"), "member", "left")
    own = own.select("label", "dim", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "member").alias("component"))
    own = materialize(own, "vector-components")
    inside = packed.join(own, ["label", "dim", "vec"]).select("id", "links", "component")
    outside = named.where(~valid | valid.isNull()).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return inside.unionByName(outside)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(
        F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON l.a = reach.r
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT reach.vec_id::BIGINT AS vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(r)::BIGINT AS component_id, reach.vec_id = min(r) AS kept
FROM reach LEFT JOIN n ON n.a = reach.vec_id GROUP BY reach.vec_id
"""
