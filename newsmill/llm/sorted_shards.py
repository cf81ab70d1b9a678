"""Token ids as sorted-string-table shards.

Documents are range-partitioned by id; each task writes shards one after another, each of at
most ``SHARD_BLOCKS`` blocks, so shards in the order of their first keys hold the documents in
ascending order. A shard is a list of records:

- data blocks of about ``BLOCK_BYTES``: zlib of entries (length of the key's prefix shared
  with the entry before it, length of its rest, length of the value, rest, value);
- a sparse index with the first key, place and size of each block;
- a Bloom filter over the keys;
- a footer of fixed size with places, counts, a checksum and a magic number.

Every record ends with a newline that belongs to it, so Spark's text sink can write the
records through any file system, with its commit protocol, and a lost task is run again. As
every shard but a task's last has the same number of records, the sink rolls its files there,
and a reader never holds more than one shard of bounded size. After writing, the shards are read
back once; their checksums are tested, and a catalogue in the folder ``_catalogue`` gets a row a shard: range
of ids, counts, index, filter. A lookup asks the catalogue's filters, searches its indexes and reads
the found blocks alone, by their place.

Keys are a byte that tells a null id (first) and the id as 8 big-endian bytes that sort like
the number. Defined cases: a null text is empty; an empty text has the end id alone; rows that
repeat an id are entries in a row; an empty table has no shard; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsmill.llm.batches import slices
from newsmill.llm.tokens import encoder, vocabulary_path
from newsmill.session import shared_path, ship_package

BLOCK_BYTES = 256 << 10
#: Blocks of a shard at most; a block is larger than BLOCK_BYTES only where its last document makes it so.
SHARD_BLOCKS = 125
CATALOGUE = "_catalogue"
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"NMSST01"
ENTRY, BLOCK, FOOTER = struct.Struct("<BBI"), struct.Struct("<QIB"), struct.Struct("<QIQIQQBI7s")


def key_of(doc: int | None) -> bytes:
    return b"\0" if doc is None else b"\1" + ((doc + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _places(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


def bloom(keys: list[bytes]) -> bytes:
    bits = max(64, BLOOM_BITS * len(keys))
    field = np.zeros(bits, bool)
    for k in keys:
        field[list(_places(k, bits))] = True
    return struct.pack("<Q", bits) + np.packbits(field, bitorder="little").tobytes()


def shard(entries: Iterator[tuple[bytes, bytes]], width: int, most: int = SHARD_BLOCKS, block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Records, without their newlines, of sorted (key, value) pairs until ``most`` blocks are full; width: bytes of an id."""
    place, index, keys, tokens = 0, [], [], 0
    parts: list[bytes] = []
    size, first, last = 0, b"", b""

    def block() -> bytes:
        nonlocal place
        record = zlib.compress(b"".join(parts), 1)
        index.append((place, len(record), first))
        place += len(record) + 1
        return record

    for key, value in entries:
        if not parts:
            first, last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(key, last)) if a != b), min(len(key), len(last)))
        parts += [ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        size, last = size + ENTRY.size + len(key) + len(value), key
        keys.append(key)
        tokens += len(value) // width
        if size >= block_bytes:
            yield block()
            parts, size = [], 0
            if len(index) == most:
                break
    if not keys:
        return
    if parts:
        yield block()
    listed = b"".join(BLOCK.pack(at, n, len(k)) + k for at, n, k in index)
    known = bloom(keys)
    yield listed
    yield known
    yield FOOTER.pack(place, len(listed), place + len(listed) + 1, len(known), len(keys), tokens, width, zlib.crc32(listed + known), MAGIC)


def shards(entries: Iterator[tuple[bytes, bytes]], width: int, most: int = SHARD_BLOCKS, block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The records of shards of ``most`` blocks, one after another."""
    entries = iter(entries)
    while (first := next(entries, None)) is not None:
        yield from shard(chain([first], entries), width, most, block_bytes)


def _blocks(index: bytes) -> list[tuple[bytes, int, int]]:
    """(first key, place, size) of each block."""
    found, i = [], 0
    while i < len(index):
        place, size, k = BLOCK.unpack_from(index, i)
        i += BLOCK.size + k
        found.append((index[i - k : i], place, size))
    return found


def may_hold(known: bytes, key: bytes) -> bool:
    (bits,) = struct.unpack_from("<Q", known)
    return all(known[8 + p // 8] >> p % 8 & 1 for p in _places(key, bits))


def entries_of(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a block's entries, in order."""
    raw, i, key = zlib.decompress(block), 0, b""
    while i < len(raw):
        shared, rest, n = ENTRY.unpack_from(raw, i)
        i += ENTRY.size
        key = key[:shared] + raw[i : i + rest]
        i += rest + n
        yield key, raw[i - n : i]


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        at, n, bat, bn, self.entries, self.tokens, self.width, crc, magic = FOOTER.unpack(self.data[-FOOTER.size - 1 : -1])
        self._index, self._bloom = bytes(self.data[at : at + n]), bytes(self.data[bat : bat + bn])
        if magic != MAGIC or crc != zlib.crc32(self._index + self._bloom):
            raise ValueError("not a shard, or a damaged one")
        self.blocks = _blocks(self._index)

    def _scan(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, size = self.blocks[block]
        return entries_of(self.data[place : place + size])

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self.blocks)):
            yield from self._scan(b)

    def may_hold(self, key: bytes) -> bool:
        return may_hold(self._bloom, key)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, by binary search over the blocks' first keys."""
        if not self.may_hold(key):
            return []
        firsts = [k for k, _, _ in self.blocks]
        return [v for b in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)) for k, v in self._scan(b) if k == key]


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str | None = None, shard_blocks: int = SHARD_BLOCKS, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode every text, append ``end_id``, write the shards to ``path`` and their catalogue beside them. Ids are made after the exchange, so its sampling pass only reads."""
    ship_package(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer or vocabulary_path("word_bpe_49k.json"))
        end = end_id.to_bytes(enc.width, "little")

        def entries():
            for b in slices(batches, "text", 1 << 20):
                for doc, ids in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist())):
                    yield key_of(doc), ids + end

        for record in shards(entries(), enc.width, shard_blocks, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])

    by_id = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    # The text's hash is part of the range, so rows of one id are spread.
    by_id = by_id.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    records = by_id.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    # Every shard but a task's last has this many records, so Spark's files end where shards end.
    records.write.option("maxRecordsPerFile", shard_blocks + 3).text(path)
    _catalogue(docs.sparkSession, path).write.parquet(f"{path}/{CATALOGUE}")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the shards; a scan reads the contents only if they are selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def _catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A row a shard, read back from what was written: its range of ids, counts, index and filter."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                s = Shard(data.as_buffer())
                last = list(s._scan(len(s.blocks) - 1))[-1][0]
                ids = [pa.array([id_of(k)], pa.int64()) for k in (s.blocks[0][0], last)]
                counts = [pa.array([n], pa.int64()) for n in (s.entries, s.tokens)]
                yield pa.RecordBatch.from_arrays([pa.array([name]), *ids, *counts, pa.array([s._index], pa.binary()), pa.array([s._bloom], pa.binary())], ["shard", "first_id", "last_id", "n_docs", "n_tokens", "index", "bloom"])

    return _shards(spark, path).select("path", "content").mapInArrow(run, "shard string, first_id long, last_id long, n_docs long, n_tokens long, index binary, bloom binary")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(shard, first_id, last_id, n_docs, n_tokens) of each shard, from the catalogue."""
    return spark.read.parquet(f"{path}/{CATALOGUE}").select("shard", "first_id", "last_id", "n_docs", "n_tokens")


def _read(spark: SparkSession, path: str, values: str, columns) -> DataFrame:
    """(shard, doc_id, shard_start, …): each entry in order within its shard; shard_start counts the shard's ids before it.

    ``columns(entries, width)`` makes the arrays that ``values`` declares, within the same Python pass.
    """
    ship_package(spark)
    names = ["shard", "doc_id", "shard_start", *(x.split()[0] for x in values.split(", "))]

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                s = Shard(data.as_buffer())
                start = 0
                for block in range(len(s.blocks)):
                    rows = list(s._scan(block))
                    sizes = np.array([len(v) // s.width for _, v in rows], np.int64)
                    starts = start + np.r_[0, np.cumsum(sizes)[:-1]]
                    start += int(sizes.sum())
                    ids = pa.array([id_of(k) for k, _ in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), ids, pa.array(starts, pa.int64()), *columns([v for _, v in rows], s.width)], names)

    return _shards(spark, path).select("path", "content").mapInArrow(run, "shard string, doc_id long, shard_start long, " + values)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, shard_start, ids, width) of every entry."""
    return _read(spark, path, "ids binary, width int", lambda v, width: [pa.array(v, pa.binary()), pa.array([width] * len(v), pa.int32())])


def places(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(shard, place, size): the blocks that may hold one of ``ids``, by the catalogue's ranges, filters and indexes."""
    ship_package(spark)
    keys = sorted(key_of(i) for i in ids)

    def run(batches):
        for b in batches:
            for name, index, known in zip(*(b.column(c).to_pylist() for c in ("shard", "index", "bloom"))):
                blocks, found = _blocks(index), set()
                firsts = [k for k, _, _ in blocks]
                for key in keys:
                    if may_hold(known, key):
                        found.update(range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)))
                rows = [blocks[i][1:] for i in sorted(found)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (0, 1))], ["shard", "place", "size"])

    asked = [i for i in ids if i is not None]
    near = F.col("last_id").isNull() | F.col("first_id").isNull()
    if asked:
        near |= (F.col("last_id") >= min(asked)) & (F.col("first_id") <= max(asked))
    return spark.read.parquet(f"{path}/{CATALOGUE}").where(near).select("shard", "index", "bloom").mapInArrow(run, "shard string, place long, size long")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> list[tuple[int | None, bytes]]:
    """(id, values as bytes) of a stated list of ids, in order.

    Tasks search the catalogue; of the shards only the blocks found are read, by their place, through
    the file system that Spark reads with.
    """
    keys, found = {key_of(i) for i in ids}, []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in places(spark, path, ids).orderBy("shard", "place").collect():  # a block or two for each id
        file = jvm.org.apache.hadoop.fs.Path(r.shard)
        stream = file.getFileSystem(conf).open(file)
        try:
            stream.seek(r.place)
            raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, r.size))
        finally:
            stream.close()
        found += [(k, v) for k, v in entries_of(raw) if k in keys]
    return [(id_of(k), v) for k, v in sorted(found, key=lambda x: x[0])]


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the shards' entries.

    The running sum of the catalogue's counts has one row a shard.
    """

    def digests(values: list[bytes], width: int) -> list[pa.Array]:
        wide = [np.frombuffer(v, f"<u{width}").astype("<u4") for v in values]
        return [pa.array([len(w) for w in wide], pa.int64()), pa.array([zlib.crc32(w.tobytes()) for w in wide], pa.int64())]

    rows = _read(spark, path, "n_tokens long, ids_crc32 long", digests)
    # Shards of one id alone are in the order of the tasks that wrote them.
    task = F.regexp_extract("shard", r"part-(\d+)", 1).try_cast("int")
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), task, "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = footers(spark, path).select("shard", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_starts(spark, path)
