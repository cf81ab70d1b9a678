"""Exact dedup through an extendible-hash index on shared files.

Texts are equal when their bytes are, after A-Z is lower-cased. The index's key is the XXH64 of these
bytes. It is built in three passes:

1. **Directory.** Tasks count rows and bytes of each hash. Their sums over the hashes' first
   ``MOST_DEPTH`` bits (65,536 rows at most, whatever the input's size) are all that the driver sees. It
   starts with one bucket and splits each overfull one by the next bit, doubling the directory where
   the bucket is as deep as that. A bucket is a range of keys. A hash that holds more rows than a
   ``HOT_SHARE``-th of the table can't be split by its bits: its rows are a chain of pages, dealt like
   buckets. There are fewer than ``HOT_SHARE`` such hashes.
2. **Buckets.** Tasks look up the directory, collapse the equal texts of a batch to one text with its ids, and send
   that to the bucket's owner. An owner reads its range of keys in order. Each hash has a chain of the
   different texts met so far; a text is compared byte by byte with the chain's and joins the one it
   equals, or makes the chain longer: a collision. The entries (hash, page, place in the chain, length,
   SHA-256, ids) are the index's files; the first text of each place goes with them where a hash has pages.
3. **Pages.** The first texts of a hot hash's pages meet, one a page, and are compared in the same way.

Groups are sums over entries. All that is carried over is in the shared folder, so a lost executor
costs its tasks only.

Defined cases: a null text is empty, and empty texts are equal; of rows that repeat an id and a text
one is kept; a null id is smaller than all others; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm.batches import slices
from newsmill.session import drop_shared, materialize, ship_package

#: Bits of the directory at most: a bound of what the driver and every task hold of it.
MOST_DEPTH = 16
#: A bucket has this many bytes, before equal texts are collapsed, or the table's share at the greatest depth.
BUCKET_BYTES = 16 << 20
#: A hash with more rows than the table's by this number has pages, of that many rows.
HOT_SHARE = 4096
#: Pages have this many rows at least.
PAGE_ROWS = 256
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Directory:
    """Buckets of hashes: ``pointers`` has the bucket of each prefix of ``depth`` bits; ``hot`` the first page and number of pages of a hash."""

    depth: int
    pointers: np.ndarray
    local_depth: np.ndarray
    hot: dict[int, tuple[int, int]]
    owners: int

    def bucket(self, h: int) -> int:
        return int(self.pointers[h >> 64 - self.depth] if self.depth else 0)

    def owner(self, h: int, salt: int) -> tuple[int, int]:
        """(page, owner); page is -1 where the hash has none."""
        if h in self.hot:
            first, pages = self.hot[h]
            page = salt % pages
            return page, first + page
        return -1, self.bucket(h)


def directory(counted: np.ndarray, hot: dict[int, int], most_bytes: int) -> Directory:
    """Split from one bucket on; ``counted``: bytes of each prefix of ``MOST_DEPTH`` bits; ``hot``: pages of a hash."""
    most_depth = int(len(counted)).bit_length() - 1
    sums = np.r_[0, np.cumsum(counted)]
    depth, pointers, local = 0, np.zeros(1, np.int64), [0]
    waiting = [(0, 0)]  # (first pointer at the greatest depth, bucket)
    while waiting:
        at, bucket = waiting.pop()
        width = 1 << most_depth - local[bucket]
        if sums[at + width] - sums[at] <= most_bytes or local[bucket] == most_depth:
            continue
        if local[bucket] == depth:  # the directory doubles: each pointer becomes two
            pointers, depth = np.repeat(pointers, 2), depth + 1
        local[bucket] += 1
        local.append(local[bucket])
        half = at + width // 2
        first, last = half >> most_depth - depth, (at + width) >> most_depth - depth
        pointers[first:last] = len(local) - 1
        waiting += [(at, bucket), (half, len(local) - 1)]
    # Buckets are named in the order of their keys, so owners hold ranges of them.
    names, order = np.unique(pointers, return_index=True)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(order)] = np.arange(len(names))
    depths = np.empty(len(names), np.int64)
    depths[rank] = [local[b] for b in names]
    pages, owners = {}, len(names)
    for h, n in sorted(hot.items()):
        pages[h] = (owners, n)
        owners += n
    return Directory(depth, rank[pointers], depths, pages, owners)


def _normal(texts: pa.Array) -> list[bytes]:
    """Each text's bytes with A-Z in lower case; null is empty."""
    return [(t or b"").translate(LOWER) for t in texts.cast(pa.binary()).to_pylist()]


def _unsigned(h: int) -> int:
    return h & (1 << 64) - 1


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashes(docs: DataFrame, text_col: str, digest=xxhash.xxh64_intdigest) -> DataFrame:
    """(h, n, size): rows and bytes of each hash, added up in tasks first."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            seen: dict[int, list[int]] = {}
            for t in _normal(b.column(0)):
                x = seen.setdefault(digest(t, seed=SEED), [0, 0])
                x[0] += 1
                x[1] += len(t)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_signed, seen)), pa.int64()), *(pa.array([x[i] for x in seen.values()], pa.int64()) for i in (0, 1))], ["h", "n", "size"])

    one = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h long, n long, size long")
    return one.groupBy("h").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))


def build_directory(slots: DataFrame, bucket_bytes: int = BUCKET_BYTES, page_rows: int = PAGE_ROWS) -> Directory:
    """The directory of counted hashes."""
    total = slots.agg(F.sum("n"), F.sum("size")).first()
    rows, size = total[0] or 0, total[1] or 0
    page = max(page_rows, rows // HOT_SHARE)
    hot = {_unsigned(r.h): -(-r.n // page) for r in slots.where(F.col("n") > page).select("h", "n").collect()}  # fewer than HOT_SHARE
    prefix = F.shiftrightunsigned("h", 64 - MOST_DEPTH).alias("prefix")
    counted = np.zeros(1 << MOST_DEPTH, np.int64)
    for r in slots.where(F.col("n") <= page).groupBy(prefix).agg(F.sum("size").alias("size")).collect():  # 65,536 rows at most
        counted[r.prefix] = r["size"]
    return directory(counted, hot, max(bucket_bytes, size >> MOST_DEPTH - 1))


DEALT = "h long, page int, owner int, text binary, ids array<bigint>"


def deal(docs: DataFrame, id_col: str, text_col: str, to: Directory, digest=xxhash.xxh64_intdigest) -> DataFrame:
    """(h, page, owner, text, ids): equal texts of a batch once."""

    def run(batches):
        salt = 0
        for b in slices(batches, "text", 4 << 20):
            chains: dict[int, list[tuple[bytes, list]]] = {}
            for i, t in zip(b.column(0).to_pylist(), _normal(b.column(1))):
                _join(chains.setdefault(digest(t, seed=SEED), []), t, lambda: [])[1].append(i)
            h, found = [], []
            for key, chain in chains.items():
                salt += 1
                h += [(_signed(key), *to.owner(key, xxhash.xxh64_intdigest(str(chain[0][1][0]), seed=salt)))] * len(chain)
                found += chain
            columns = [pa.array([x[k] for x in h], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([t for t, _ in found], pa.binary()), pa.array([i for _, i in found], pa.list_(pa.int64()))], ["h", "page", "owner", "text", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DEALT)
    return rows.repartitionById(to.owners, F.col("owner")).sortWithinPartitions("h", "page")


def _join(chain: list, text: bytes, new) -> tuple:
    """The chain's entry whose text equals ``text``, byte for byte; a longer chain if there is none."""
    for entry in chain:
        if entry[0] == text:
            return entry
    chain.append((text, new()))
    return chain[-1]


ENTRIES = "owner int, h long, page int, place int, size long, sha256 string, entry long, ids array<bigint>, first binary"


def entries(dealt: DataFrame) -> DataFrame:
    """The owners' entries: a row for each text that was sent, with its place in the chain of its hash and page; ``first`` is a place's text where there are pages."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, chain, number = None, [], 0
        for b in slices(batches, "text", 4 << 20):
            out = []
            h, page, owner, texts, ids = b.columns
            for key, p, o, t in zip(h.to_pylist(), page.to_pylist(), owner.to_pylist(), texts.to_pylist()):
                if now != (key, p):
                    now, chain = (key, p), []
                place = next((k for k, e in enumerate(chain) if e[0] == t), len(chain))
                first = place == len(chain)
                if first:
                    chain.append((t, hashlib.sha256(t).hexdigest()))
                out.append((place, len(t), chain[place][1], number, t if first and p >= 0 else None))
                number += 1
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            place, size, sha, count, first = (pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([owner, h, page, place, size, sha, count, ids, first], [x.split()[0] for x in ENTRIES.split(", ")])

    return dealt.mapInArrow(run, ENTRIES)


def settle_pages(found: DataFrame) -> DataFrame:
    """(h, page, place, common) of the hashes that have pages: the first texts of their places are compared, in the order of hashes."""

    def run(batches):
        now, chain = None, []
        for b in slices(batches, "first", 4 << 20):
            common = []
            for key, t in zip(b.column("h").to_pylist(), b.column("first").to_pylist()):
                if now != key:
                    now, chain = key, []
                common.append(_join(chain, t, lambda n=len(chain): n)[1])
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("page"), b.column("place"), pa.array(common, pa.int32())], ["h", "page", "place", "common"])

    firsts = found.where("first IS NOT NULL").select("h", "page", "place", "first").repartition("h").sortWithinPartitions("h", "page", "place")
    return firsts.mapInArrow(run, "h long, page int, place int, common int")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, page_rows: int = PAGE_ROWS, digest=xxhash.xxh64_intdigest) -> DataFrame:
    """The index's entries, in the shared folder: (owner, h, common, size, sha256, entry, ids). ``digest`` is for tests of collisions."""
    slots = materialize(hashes(docs, text_col, digest), "hash-slots")
    to = build_directory(slots, bucket_bytes, page_rows)
    drop_shared(slots)
    found = materialize(entries(deal(docs, id_col, text_col, to, digest)), "index-buckets")
    common = materialize(settle_pages(found), "index-pages")
    joined = found.drop("first").join(common, ["h", "page", "place"], "left")
    return joined.select("owner", "h", F.coalesce("common", "place").alias("common"), "size", "sha256", "entry", "ids")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, keep_id, group_size, kept, size, sha256) of every row of ``docs``."""
    index = materialize(build_index(docs, id_col, text_col, **options), "index")
    # An owner numbers its entries, so (owner, entry) names one; the greatest names the row that stays among equal ids.
    top = F.struct(F.array_max("ids").alias("id"), "owner", "entry")
    groups = index.groupBy("h", "common").agg(F.sum(F.size("ids")).cast("bigint").alias("group_size"), F.max(top).alias("top"))
    groups = materialize(groups, "index-groups")  # the join then stands on two plain exchanges, whose hot keys Spark splits
    rows = index.join(groups, ["h", "common"]).select("*", F.posexplode("ids").alias("at", "id"))
    stays = (F.col("owner") == F.col("top.owner")) & (F.col("entry") == F.col("top.entry"))
    stays &= F.col("at") + 1 == F.greatest(F.lit(1), F.coalesce(F.array_position("ids", F.col("top.id")), F.lit(1)))
    return rows.select("id", F.col("top.id").alias("keep_id"), "group_size", stays.alias("kept"), "size", "sha256")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
