"""SimHash near-dedup over tables of bit segments, with pivot distances as a filter.

A text's fingerprint has the bits that over half of its shingles' hashes have. Documents of
one fingerprint are one row from then on. Candidates come from agreeing bit segments, not from
pivots:

- ``most`` differing bits touch at most ``most`` segments of the 64 bits, so two linked
  fingerprints agree on the other ones. There is a table for each choice of that many
  segments, keyed by the fingerprint's own bits there;
- pivots only discard: every fingerprint gets its Hamming distances to full-width reference
  fingerprints, once; where the distances of two fingerprints to any of them differ by more
  than ``most``, so do the fingerprints (triangle inequality). Candidates of a table are
  discarded by the largest such difference; the rest are verified bit by bit.

Pivots can't make candidates: distances of 64-bit fingerprints lie around 32 with a deviation
of 4, so most pairs agree within 4 on any one of them.

The number of segments follows the number of fingerprints, so that a table's buckets hold
few by chance; every choice finds every pair. Linked fingerprints form components.

Defined cases: a null text is empty; a text without words has fingerprint zero; a text of
fewer words than a shingle is one shingle; a row without an id gets its fingerprint's
component but links nothing; an empty table gives an empty table; other columns stay out.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm.linking import candidate_groups, components, link_groups
from newsmill.session import materialize, ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED, BITS = 42, 64
#: Full-width pivots: pseudo-random references.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(16)], np.uint64)
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    joined = " ".join(w).encode()
    digest = xxhash.xxh64_intdigest
    lengths = np.array([len(x.encode()) for x in w] if not joined.isascii() else [len(x) for x in w], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(w) - words + 1)].tolist()
    stops = ends[min(words, len(w)) - 1 :].tolist()
    over = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], "<u8")
        over += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * over > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, row, fp): ``row`` is the XXH64 of the text, which tells rows of one id apart; the fingerprint is a signed long."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "row", "fp"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, row long, fp long")


def segment_masks(segments: int) -> list[int]:
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]


def table_masks(count: int, most: int) -> list[int]:
    """The bits whose local pivots key each table; a table's buckets hold about 64 by chance, or fewer."""
    segments = most + 2
    while count >> int(BITS * (segments - most) / segments) > 64 and segments < most + 6:
        segments += 1
    return [sum(c) for c in itertools.combinations(segment_masks(segments), segments - most)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def pivot_check(most: int):
    def check(table: pa.Table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        coordinates = table.column("coordinates").combine_chunks()
        coordinates = np.frombuffer(b"".join(coordinates.to_pylist()), np.int8).reshape(len(fp), -1)

        def linked(a, b):
            near = np.abs(coordinates[a] - coordinates[b]).max(1) <= most
            near[near] = np.bitwise_count(fp[a[near]] ^ fp[b[near]]) <= most
            return near, near

        return linked

    return check


def _pack_coordinates(fps: DataFrame) -> DataFrame:
    """Adds the distances to the full-width pivots, a byte each."""
    near = [F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p)))))), 2, "0") for p in PIVOTS]
    return fps.withColumn("coordinates", F.unhex(F.concat(*near)))


def fingerprint_components(fps: DataFrame, most: int = 4) -> DataFrame:
    """(fp, component) of every fingerprint in ``fps`` (id, fp): the smallest id that links reach."""
    rows = fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(_pack_coordinates(rows), "fingerprints")
    masks = table_masks(distinct.count(), most)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    keys = distinct.where(F.col("rep").isNotNull()).select("fp", F.explode(tables).alias("x"))
    keys = keys.select(F.xxhash64("x.t", "x.k").alias("bucket"), F.col("fp").alias("member"))
    groups = candidate_groups(keys).withColumnRenamed("member", "fp")
    groups = groups.hint("merge").join(distinct.select("fp", "coordinates", F.col("rep").alias("member")), "fp")
    edges = link_groups(groups, pivot_check(most)).select(F.col("member").alias("u"), F.col("root").alias("v"))
    found = components(edges)
    return distinct.hint("merge").join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, most: int = 4) -> DataFrame:
    """(id, row, fp, component) of every row."""
    fps = materialize(fingerprints(docs, id_col, text_col, words), "document-fingerprints")
    found = materialize(fingerprint_components(fps, most), "fingerprint-components")
    return fps.hint("merge").join(found, "fp").select("id", "row", "fp", "component")


def keepers(found: DataFrame) -> DataFrame:
    """(id, row, copies): the row that stays of each component, and how many rows equal it in id and text.

    It is the row of the smallest id (a null id is the greatest), of these the one of the smallest
    text hash. A fingerprint that only rows without an id have is a component of its own.
    """
    alone = F.when(F.col("component").isNull(), F.col("fp"))
    rows = found.groupBy("component", alone.alias("alone"), "id", "row").agg(F.count(F.lit(1)).alias("copies"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "copies")).alias("k")
    return rows.groupBy("component", "alone").agg(best).select("k.id", "k.row", "k.copies")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
