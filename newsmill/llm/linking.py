"""What the near-duplicate operators share: candidate groups of bounded size, links within them, components.

A row of a key table names a bucket and a member. Buckets of one member go. A bucket larger
than a block is cut into blocks by a hash of the member, and each pair of blocks is a group
of its own, so no task holds a large bucket and every pair of members still meets once.
Groups return a row a member (the least member that its links reach there, and how many links it
has), never their pairs.

Tables here grow with the input, so none is broadcast: joins are hinted to merge. Spark takes an exploded
table for no larger than what it was exploded from, and files for no larger than they are compressed, and would send both through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.operators.components import STARS, Stars, components  # noqa: F401
from newsmill.session import materialize

#: A block has this many members at least, four times the root of the bucket's size else, and not over the last.
BLOCK, LARGEST_BLOCK = 128, 4096
#: Pairs that one vectorised check takes.
PAIRS = 1 << 18


def candidate_groups(keys: DataFrame) -> DataFrame:
    """(bucket, first, second, block, member): the members of each pair of blocks, from (bucket, member).

    ``first`` and ``second`` are the blocks that a group compares, ``block`` the member's own.
    """
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes, "bucket-sizes")  # the join then stands on plain exchanges, whose hot keys Spark splits
    most = F.least(F.greatest(F.lit(BLOCK), F.ceil(4 * F.sqrt("n"))), F.lit(LARGEST_BLOCK))
    rows = keys.hint("merge").join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / most).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "member"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("bucket", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "member")


def grouped(rows: DataFrame) -> DataFrame:
    """Each group's rows side by side in one partition."""
    group = ("bucket", "first", "second")
    return rows.repartition(*group).sortWithinPartitions(*group)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that end where a group ends, of about as many rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        new = _changes(table)
        if not new.any():
            continue
        cut = int(np.flatnonzero(new)[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        size = table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def _changes(table: pa.Table) -> np.ndarray:
    """Whether a row's successor is of another group."""
    cols = [table.column(c).to_numpy() for c in ("bucket", "first", "second")]
    return np.logical_or.reduce([c[1:] != c[:-1] for c in cols]) if table.num_rows > 1 else np.zeros(0, bool)


def pairs_in(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs to compare: all pairs within a block, or those between two blocks."""
    ends = np.r_[np.flatnonzero(_changes(table)) + 1, table.num_rows]
    starts = np.r_[0, ends[:-1]]
    first, second, block = (table.column(c).to_numpy() for c in ("first", "second", "block"))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    for size in np.unique(ends - starts):
        same = starts[ends - starts == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, PAIRS // max(1, len(i)))
        for at in range(0, len(same), step):
            base = same[at : at + step, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            across = first[a] != second[a]
            keep = ~across | (block[a] != block[b])
            left.append(a[keep])
            right.append(b[keep])
            held += len(left[-1])
            if held >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def link_groups(rows: DataFrame, check: Callable[[pa.Table], Callable], weighted: bool = False) -> DataFrame:
    """(member, root, links) from grouped rows.

    ``check(table)`` gives a function of row numbers (a, b) that returns which pairs are linked,
    and which of the links count here.
    """

    def run(batches):
        for table in whole_groups(batches):
            test = check(table)
            weight = table.column("weight").to_numpy() if weighted else None
            stars = Stars(table.column("member").to_numpy().copy(), weight)
            for a, b in pairs_in(table):
                linked, counted = test(a, b)
                if linked.any():
                    stars.add(a[linked], b[linked], counted[linked].astype(np.int64))
            yield stars.rows()

    return grouped(rows).mapInArrow(run, STARS)


def meeting(rows: DataFrame, check: Callable[[pa.Table], Callable]) -> DataFrame:
    """The rows of candidate groups that pass ``check`` with at least one other row of their group (bucket, first, second, block, member, table)."""
    names = ["bucket", "first", "second", "block", "member", "table"]

    def run(batches):
        for table in whole_groups(batches):
            test = check(table)
            keep = np.zeros(table.num_rows, bool)
            for a, b in pairs_in(table):
                near = test(a, b)
                keep[a[near]] = keep[b[near]] = True
            yield from table.select(names).filter(pa.array(keep)).to_batches()

    return grouped(rows).mapInArrow(run, "bucket long, first int, second int, block int, member long, table int")
