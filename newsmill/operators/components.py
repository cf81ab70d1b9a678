"""Components of a graph: links within a group as stars, and the components of all stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.session import drop_shared, materialize


class Stars:
    """Collects links between rows; gives each linked row the least member of what it reaches here.

    Components are kept up to date link by link (union by the least member, paths compressed over the
    whole table at once), so neither a chain's length nor the number of links costs memory.
    """

    def __init__(self, member: np.ndarray, weight: np.ndarray | None = None):
        self.member, self.weight = member, np.ones(len(member), np.int64) if weight is None else weight
        self.by_rank = np.argsort(member, kind="stable")
        self.rank = np.empty(len(member), np.int64)
        self.rank[self.by_rank] = np.arange(len(member))
        self.parent = np.arange(len(member))  # of ranks; a root is its component's least
        self.links = np.zeros(len(member), np.int64)
        self.linked = np.zeros(len(member), bool)

    def add(self, a: np.ndarray, b: np.ndarray, counted: np.ndarray | None = None) -> None:
        for x, y in ((a, b), (b, a)):
            self.linked[x] = True
            weight = self.weight[y] if counted is None else self.weight[y] * counted
            self.links += np.bincount(x, weight, len(self.links)).astype(np.int64)
        u, v = self.rank[a], self.rank[b]
        while True:
            u, v = self.parent[u], self.parent[v]
            apart = u != v
            if not apart.any():
                return
            u, v = u[apart], v[apart]
            np.minimum.at(self.parent, np.maximum(u, v), np.minimum(u, v))
            while (self.parent != (up := self.parent[self.parent])).any():
                self.parent = up

    def rows(self) -> pa.RecordBatch:
        """(member, root, links) of the linked rows: edges with the same components as the links."""
        root = self.member[self.by_rank[self.parent[self.rank]]]
        at = np.flatnonzero(self.linked)
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (self.member, root, self.links)], ["member", "root", "links"])


STARS = "member long, root long, links long"


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component's name is its least node.

    Alternates large and small stars: each node hands its larger, then its smaller neighbours
    the least node it knows, until the edges are stars. Rounds grow with the logarithm of a
    component's size. Minima are partial aggregates and are written before they are joined, so
    a hub's edges can be split. Each round cuts the lineage with a table in the shared folder.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, state = _round(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").hint("merge").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, _ = _round(large)
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "below")
        apart = large.hint("merge").join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small, after = _round(apart.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        for x in (e, low, large, below):
            drop_shared(x)
        e, done = small, after == state
        state = after
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _round(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and checksum."""
    kept = materialize(e, "edges")
    return kept, tuple(kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
