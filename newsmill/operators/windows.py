"""Articles with all earlier ones of a time window, however many these are, in groups of bounded size.

The arrival order is cut into blocks. A block meets itself and each block before it that the window reaches: a group each,
so no task holds a window, and a window of any size is judged whole. The comparisons grow with articles times those
of a window; what a task holds are two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions.alike import Alike
from newsmill.operators.components import Stars

#: Places of a block at least and at most, and how many blocks there are between these. Pairs that leave at once, those that leave with their vectors, and cells of a product of vectors.
PLACES, LARGEST, BLOCKS, PAIRS, VECTORS, CELLS = 4_000, 16_000, 192, 1 << 16, 1 << 13, 1 << 22
HOUR = 3_600_000_000
Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def block_size(articles: int) -> int:
    return min(max(PLACES, -(-articles // BLOCKS)), LARGEST)


def groups(rows: DataFrame, places: int, hours: int) -> DataFrame:
    """``rows`` (n, at, …) by (later, earlier), the blocks that a group compares, with each row's own block; sorted by n. Rows without a time are in none."""
    own = rows.where("at IS NOT NULL").withColumn("block", F.floor((F.col("n") - 1) / places))
    spans = own.groupBy("block").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    starts = spans.select(F.col("first").alias("t"), F.col("block").alias("starts"), F.lit(None).cast("bigint").alias("ends"))
    ends = spans.select((F.col("last") + hours * HOUR).alias("t"), F.lit(None).cast("bigint").alias("starts"), F.col("block").alias("ends"))
    upto = Window.orderBy("t", F.col("ends").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # two rows a block
    reach = starts.unionByName(ends).withColumn("reach", F.max("starts").over(upto)).where("ends IS NOT NULL").select(F.col("ends").alias("earlier"), F.explode(F.sequence("ends", "reach")).alias("later"))
    met = reach.select(F.col("earlier").alias("block"), "later", "earlier").unionByName(reach.where("later <> earlier").select(F.col("later").alias("block"), "later", "earlier"))
    met = met.groupBy("block").agg(F.collect_list(F.struct("later", "earlier")).alias("met"))  # a row a block
    dealt = own.join(met, "block").withColumn("met", F.explode("met")).select("met.*", *own.columns)
    tasks = min(max(1, reach.count()), 2_000)
    return dealt.repartition(tasks, "later", "earlier").sortWithinPartitions("later", "earlier", "n")


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A table a group."""
    held, key = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("later", "earlier")])
        borders = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(borders[:-1], borders[1:]):
            if a == b:
                continue
            if held and tuple(keys[:, a]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(keys[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Group:
    """The articles of two blocks, or of one, as row numbers; pairs are of a later and an earlier row within the window."""

    def __init__(self, table: pa.Table, hours: int):
        self.n, self.at, self.block = (table.column(c).to_numpy() for c in ("n", "at", "block"))
        self.since = self.at - hours * HOUR
        self.sides = [np.flatnonzero(self.block == table.column(c)[0].as_py()) for c in ("later", "earlier")]

    def _in_window(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.n[i] > self.n[j]) & (self.at[j] >= self.since[i])

    def classes(self, titles: list[str | None]) -> None:
        """Notes the rows of equal titles, by side; rows without a title are in none."""
        self.titles, self.rows = [], []
        for side in self.sides:
            found: dict[str, list[int]] = {}
            for i in side.tolist():
                if titles[i] is not None:
                    found.setdefault(titles[i], []).append(i)
            self.titles.append(list(found))
            self.rows.append([np.array(x) for x in found.values()])

    def alike(self, least: float, judged: bool) -> Iterator[tuple[int, np.ndarray]]:
        return Alike(self.titles[1], least).links(self.titles[0], judged)

    def expanded(self, u: int, found: np.ndarray) -> Pairs:
        """The pairs of a title's rows with those of titles before."""
        for v in found.tolist():
            i, j = self.rows[0][u], self.rows[1][v]  # both by n, and so by time
            low = np.searchsorted(self.at[j], self.since[i])
            size = np.maximum(np.searchsorted(self.n[j], self.n[i]) - low, 0)
            some = np.flatnonzero(size)
            at = 0
            while at < len(some):
                upto = at + max(1, int(np.searchsorted(np.cumsum(size[some[at:]]), PAIRS, "right")))
                part = some[at:upto]
                count = size[part]
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield np.repeat(i[part], count), j[np.repeat(low[part], count) + place]
                at = upto

    def close(self, vectors: list, least: float) -> Pairs:
        """Pairs that may have a product of ``least``: all that do, and some that miss it by a rounding, or whose product is no number."""
        sides = []
        for side in self.sides:
            sized: dict[int, list[int]] = {}
            for i in side.tolist():
                if vectors[i] is not None:
                    sized.setdefault(len(vectors[i]), []).append(i)
            sides.append({k: (np.array(x), np.array([vectors[i] for i in x], np.float64).reshape(len(x), k)) for k, x in sized.items()})
        for size, (i, a) in sides[0].items():
            if size not in sides[1]:
                continue
            j, b = sides[1][size]
            step = max(1, CELLS // max(1, len(j)))
            norms = np.sqrt((b * b).sum(1))
            for at in range(0, len(i), step):
                part, m = i[at : at + step], a[at : at + step]
                with np.errstate(invalid="ignore", over="ignore"):
                    far = m @ b.T < least - 1e-9 * (1.0 + np.sqrt((m * m).sum(1))[:, None] * norms)
                x, y = np.nonzero(~far)
                x, y = part[x], j[y]
                keep = self._in_window(x, y)
                if keep.any():
                    yield x[keep], y[keep]


def judged_pairs(rows: DataFrame, places: int, hours: int, title_threshold: float, embed_threshold: float, schema: str) -> DataFrame:
    """The pairs of ``rows`` (article_id, n, at, title_original, embedding): titles are judged here, vectors only as far as rules them out."""

    def run(batches):
        for table in by_group(batches):
            group = Group(table, hours)
            ids, vectors = table.column("article_id").combine_chunks(), table.column("embedding").combine_chunks()
            group.classes(table.column("title_original").to_pylist())
            titled = []

            def out(i: np.ndarray, j: np.ndarray, by_title: bool) -> pa.RecordBatch:
                both = [pa.nulls(len(i), vectors.type)] * 2 if by_title else [vectors.take(pa.array(k)) for k in (i, j)]
                columns = [*(ids.take(pa.array(k)) for k in (i, j)), *(pa.array(group.n[k]) for k in (i, j)), pa.array(np.full(len(i), by_title)), *both]
                return pa.RecordBatch.from_arrays(columns, ["later", "earlier", "later_n", "earlier_n", "titled", "a", "b"])

            held, size = [], 0
            for u, found in group.alike(title_threshold, True):
                titled.append(u * len(group.titles[1]) + found)
                for pair in group.expanded(u, found):
                    held.append(pair)
                    size += len(pair[0])
                    if size >= PAIRS:
                        yield out(*map(np.concatenate, zip(*held)), True)
                        held, size = [], 0
            if size:
                yield out(*map(np.concatenate, zip(*held)), True)
            if vectors.null_count < len(vectors):
                of = [np.full(table.num_rows, -1), np.full(table.num_rows, -1)]
                for side, rows_of in zip(of, group.rows):
                    for k, x in enumerate(rows_of):
                        side[x] = k
                same = np.concatenate(titled) if titled else np.zeros(0, np.int64)
                for i, j in group.close(vectors.to_pylist(), embed_threshold):
                    keep = (of[0][i] < 0) | (of[1][j] < 0) | ~np.isin(of[0][i] * len(group.titles[1]) + of[1][j], same)
                    i, j = i[keep], j[keep]
                    for at in range(0, len(i), VECTORS):
                        yield out(i[at : at + VECTORS], j[at : at + VECTORS], False)

    return groups(rows, places, hours).mapInArrow(run, schema)


def stars(rows: DataFrame, places: int, hours: int, title_threshold: float, embed_threshold: float) -> DataFrame:
    """(member, root, titled) by n: edges that join all articles whose titles, or else vectors, may resemble one another within the window, two rows an article and group at most; null titles are empty."""

    def run(batches):
        for table in by_group(batches):
            group = Group(table, hours)
            group.classes([t or "" for t in table.column("title_original").to_pylist()])
            links = [(x[:-1], x[1:]) for side in group.rows for x in side]
            first = np.array([x[0] for x in group.rows[1]], np.int64)
            links += [(group.rows[0][u][:1].repeat(len(near)), first[near]) for u, near in group.alike(title_threshold, False)]
            by_title, by_vector = Stars(group.n.copy()), Stars(group.n.copy())
            if links:
                i, j = map(np.concatenate, zip(*links))
                by_title.add(i[i != j], j[i != j])
            vectors = table.column("embedding")
            if vectors.null_count < len(vectors):
                for i, j in group.close(vectors.to_pylist(), embed_threshold):
                    by_vector.add(i, j)
            for found, titled in ((by_title, True), (by_vector, False)):
                rows = found.rows()
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(np.full(rows.num_rows, titled))], ["member", "root", "titled"])

    return groups(rows, places, hours).mapInArrow(run, "member long, root long, titled boolean")
