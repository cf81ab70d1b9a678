"""Best-fit packing of token pieces into sequences, with a swap-based local search.

A document is its ids and an end id; only a document longer than a sequence is cut. Ids and
their checksums are made once; what is shuffled and packed is a row of numbers a piece.
Pieces are dealt by hash into groups of about ``GROUP_PIECES``, so each task packs a bounded
list whatever the size of the table: best fit by falling length, then the search. The search
goes over the underfull sequences, emptiest first, and moves a piece into another one, or
exchanges one for one or two for one, whenever that raises the sum of squared fills, until
the group needs no more sequences than its tokens do or no exchange raises the sum.
A piece's place in its task is a salt, so equal rows are dealt over all groups.

Defined cases: a null text is empty; an empty text is the end id alone; rows with equal ids
and rows with null ids are packed as the separate rows they are; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm.batches import slices
from newsmill.llm.tokens import encoder, vocabulary_path
from newsmill.session import materialize, ship_package

CAPACITY = 2048
#: Pieces that one task packs together.
GROUP_PIECES = 8192

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int64())])


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of every piece; salts of a table differ."""
    ship_package(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path or vocabulary_path("word_bpe_49k.json"))
        salt = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist())):
                ids = np.frombuffer(raw, f"<u{enc.width}").astype("<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), salt))
                    salt += 1
            cols = list(zip(*rows)) or [()] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item, longest first, goes where it leaves the least room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    has = 0  # a bit for each amount of room that some bin has
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = has >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                has ^= 1 << left
            bins[b].append(i)
        else:
            b, left = len(bins), capacity
            bins.append([i])
        left -= n
        if left:
            room[left].append(b)
            has |= 1 << left
    return bins


class SwapSearch:
    """Empties underfull bins; every step raises the sum of squared fills, so it ends."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        fill = [int(lengths[b].sum()) for b in bins]
        self.full = [b for b, n in zip(bins, fill) if n == capacity]
        self.bins = [b for b, n in zip(bins, fill) if n < capacity]
        self.fill = np.array([n for n in fill if n < capacity], np.int64)
        self.item = np.array([i for b in self.bins for i in b], np.int64)
        self.size = self.lengths[self.item] if len(self.item) else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.bins)), [len(b) for b in self.bins])
        self.place = dict(zip(self.item.tolist(), range(len(self.item))))

    def _shift(self, source: int, out: list[int], target: int, back: list[int]) -> None:
        """Items ``out`` of bin ``source`` go to ``target``, items ``back`` the other way."""
        for items, a, b in ((out, source, target), (back, target, source)):
            for i in items:
                self.bins[a].remove(i)
                self.bins[b].append(i)
                self.owner[self.place[i]] = b
        moved = int(self.lengths[out].sum()) - int(self.lengths[back].sum())
        self.fill[source] -= moved
        self.fill[target] += moved

    def _best(self, source: int, sums: np.ndarray, size: np.ndarray, target: np.ndarray) -> tuple[int, int, int]:
        """(gain, which sum, which target) of the exchange that raises the sum of squares most; sums are ascending."""
        to = self.fill[target]
        room = self.capacity - to
        open_ = (to > 0) & (room > 0) & (target != source)
        # The gain 2m(to - from + m) of m moved tokens grows with m where it is positive, so the largest sum that fits is best.
        at = np.searchsorted(sums, size + room, side="right") - 1
        moved = np.where(open_ & (at >= 0), sums[np.maximum(at, 0)] - size, 0)
        gain = np.where(moved > 0, 2 * moved * (to - self.fill[source] + moved), -1)
        best = int(gain.argmax()) if len(gain) else 0
        return (int(gain[best]), int(at[best]), best) if len(gain) else (-1, 0, 0)

    def step(self, source: int) -> bool:
        """Make the exchange that takes tokens from ``source`` and raises the sum the most, if there is one."""
        own = sorted(self.bins[source], key=lambda i: (-self.lengths[i], i))
        takes: dict[int, list[int]] = {}
        for i in own:
            takes.setdefault(int(self.lengths[i]), [i])
        single = dict(takes)
        some = {n: [i for i in own if self.lengths[i] == n][:2] for n in single}  # two of a length are all a pair needs
        flat = [i for v in some.values() for i in v]
        for k, a in enumerate(flat):
            for b in flat[k + 1 :]:
                takes.setdefault(int(self.lengths[a] + self.lengths[b]), [a, b])
        ones, sums = np.array(sorted(single), np.int64), np.array(sorted(takes), np.int64)
        every = np.arange(len(self.bins))
        move = self._best(source, ones, np.zeros(len(every), np.int64), every)
        swap = self._best(source, sums, self.size, self.owner)
        if max(move[0], swap[0]) <= 0:
            return False
        if move[0] >= swap[0]:
            self._shift(source, single[int(ones[move[1]])], move[2], [])
        else:
            self._shift(source, takes[int(sums[swap[1]])], int(self.owner[swap[2]]), [int(self.item[swap[2]])])
        return True

    def run(self, total: int) -> list[list[int]]:
        """Passes over the bins, emptiest first, until no fewer bins can hold the total or a pass changes nothing."""
        least, changed = math.ceil(total / self.capacity), True
        while changed:
            changed = False
            for source in np.argsort(self.fill, kind="stable").tolist():
                if len(self.full) + int((self.fill > 0).sum()) <= least:
                    break
                while 0 < self.fill[source] < self.capacity and self.step(source):
                    changed = True
            changed = changed and len(self.full) + int((self.fill > 0).sum()) > least
        return self.full + [b for b in self.bins if b]


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return SwapSearch(best_fit(lengths, capacity), lengths, capacity).run(int(lengths.sum()))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (as :func:`token_pieces` makes them) with sequence_id and offset for salt. ``pieces`` should be cheap to read twice."""
    ship_package(pieces.sparkSession)
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def run(part: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("salt", "ascending")]
        part = part.sort_by(order)
        lengths = part.column("length").to_numpy().astype(np.int64)
        first = part.column("_group")[0].as_py() << 32
        sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for k, items in enumerate(pack_group(lengths, capacity)):
            sequence[items] = first + k
            offset[items] = np.r_[0, np.cumsum(lengths[items])[:-1]]
        columns = [part.column(f.name) for f in PIECES if f.name != "salt"]
        return pa.Table.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*(f.name for f in PIECES if f.name != "salt"), "sequence_id", "offset"])

    key = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", "salt"), F.lit(groups))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.withColumn("_group", key).groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    return pack(materialize(token_pieces(docs, id_col, text_col, capacity, end_id, path), "pieces"), capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
