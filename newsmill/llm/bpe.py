"""Byte-level BPE: encoding in batched merge rounds over flat numpy arrays, and decoding.

A batch's new pieces lie end to end in one array of symbols. In each round every piece with
a mergeable pair merges the pair of lowest rank wherever it stands in it; ranks come from a
binary search of the sorted pair keys. Pieces without a pair left are done and leave the
array, so the rounds are bounded by the merges of the longest piece. Symbols of a pair exist
before the pair's own rule, so a merge never makes a pair of lower rank than its own.

Defined cases: a null text is empty; an empty text has no ids; a text of any length is
encoded whole; rows are independent. Ids are little-endian unsigned 32-bit integers in one
binary value. A special token's string in a text is that token.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsmill.llm.batches import slices
from newsmill.llm.tokens import byte_letters, vocabulary_path
from newsmill.session import ship_package

#: How byte-level vocabularies cut a text into pieces (fixed by the vocabulary).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces whose ids a worker keeps, and the longest such piece. Results don't depend on them.
MEMO_PIECES, MEMO_CHARS = 400_000, 64
#: Symbols merged in one flat array, if no single piece is longer.
BATCH_SYMBOLS = 1 << 20

_loaded: dict = {}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = vocab[c]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made[order]
        self.memo: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done: list = [None] * len(pieces)
        last = len(self.keys) - 1
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), last)
            hit = (self.keys[at] == pair) & (owner[:-1] == owner[1:]) if last >= 0 else np.zeros(len(pair), bool)
            rank = np.where(hit, self.ranks[at], np.iinfo(np.int64).max)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, np.iinfo(np.int64).max], starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            open_piece = least < np.iinfo(np.int64).max
            for p in np.flatnonzero(~open_piece):
                done[owner[starts[p]]] = symbols[starts[p] : starts[p] + counts[p]].astype("<u4")
            if not open_piece.any():
                break
            merge_at = hit & (rank == np.repeat(least, counts)[:-1])
            # In a row of overlapping places (a a a) every other one merges, from the left.
            where = np.flatnonzero(merge_at)
            if len(where):
                fresh = np.r_[True, np.diff(where) > 1]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - first) % 2 == 0]
            symbols[where] = self.made[at[where]]
            keep = np.repeat(open_piece, counts)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return [x if x is not None else np.empty(0, "<u4") for x in done]

    def _learn(self, pieces: list[str]) -> None:
        batch, size = [], 0
        for p in sorted(pieces, key=len):
            batch.append(p)
            size += len(p)
            if size >= BATCH_SYMBOLS:
                self._learn_batch(batch)
                batch, size = [], 0
        if batch:
            self._learn_batch(batch)

    def _learn_batch(self, pieces: list[str]) -> None:
        self.memo.update(zip(pieces, (x.tobytes() for x in self.merge([p.encode() for p in pieces]))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        cut = [self._cut(t or "") for t in texts]
        memo = self.memo
        new = {p for pieces in cut for p in pieces if p not in memo}
        self._learn(list(new))
        out = [b"".join(map(memo.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return out

    def _cut(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.special):
            pieces = []
            for part in self.special_cut.split(text):
                if part in self.special:
                    self.memo[part] = self.special[part].to_bytes(4, "little")
                    pieces.append(part)
                else:
                    pieces += PIECES.findall(part)
            return pieces
        return PIECES.findall(text)

    def decode(self, ids: bytes) -> str:
        """Bytes of the ids in a row; what isn't UTF-8 becomes U+FFFD."""
        found = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, found)).decode("utf-8", "replace")


def codec(path: str) -> ByteBPE:
    """One codec for each worker and file."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` and the column of ids; a column of that name is replaced."""
    ship_package(df.sparkSession)

    def run(batches):
        bpe = codec(path or vocabulary_path("byte_bpe_50k.json"))
        for b in slices(batches, text_col, 4 << 20):
            yield _with(b, ids_col, pa.array(bpe.encode(b.column(text_col).to_pylist()), pa.binary()))

    return df.mapInArrow(run, _schema(df, ids_col, T.BinaryType()))


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` and the column of decoded texts; null ids stay null."""
    ship_package(df.sparkSession)

    def run(batches):
        bpe = codec(path or vocabulary_path("byte_bpe_50k.json"))
        for b in slices(batches, ids_col, 4 << 20):
            texts = [None if x is None else bpe.decode(x) for x in b.column(ids_col).to_pylist()]
            yield _with(b, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema(df, text_col, T.StringType()))


def query(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs).select("doc_id", "ids")
    return decode(coded).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
