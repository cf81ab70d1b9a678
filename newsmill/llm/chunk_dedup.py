"""Substring dedup by content-defined chunking.

A gear rolling hash runs over a text's bytes; each byte's hash depends on the ``WINDOW`` bytes
up to it alone. A chunk ends where the hash is low enough: after white space about every
``MEAN_WORDS`` words; after a letter of a script that is written without blanks (Han, kana,
Thai, Lao, Burmese, Khmer) about every ``2 * MEAN_WORDS`` letters; and, once ``STRETCH`` bytes
hold no white space, after any character about every ``6 * MEAN_WORDS`` bytes. All of this
looks back over a bounded stretch, so an insertion changes the chunks that it touches and no others.

Chunks have a 64-bit digest, and two chunks in a row have one of both. A pair that two or more
documents hold is repeated; overlapping repeated pairs of a document make a span, and spans of
at least ``min_words`` words are the repeats (two letters of a script without blanks count as a
word, and so do six bytes of a stretch). Pairs verify each chunk by a neighbour: a common word that is a chunk by chance repeats
everywhere, but seldom with what stands next to it. The document of the smallest id that holds
a pair keeps it; a chunk goes only if every pair that holds it is another document's.

Two pairs share a digest by chance with probability 5e-20; among 3e12 chunks (100 TB) one
in six million has such a twin, and spans need several in a row.

Plan: digests are written once, as arrays by document. Which pairs repeat is a partial
aggregate of the least and greatest id, written before it is joined, so the rows of
a passage that a third of all documents hold can be split. Texts are never shuffled.

Defined cases: a null text is empty; an empty text has no chunks; a text of one chunk has one
pair, with nothing; where the hash is never low a chunk ends ``MOST_BYTES`` bytes after the last
border, between code points; a document of a null id neither makes
nor has repeats; rows that repeat an id are one document, whose copies don't count as
another's, and rows that repeat id and text give their spans once; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsmill.llm.batches import joined_bytes, lists, slices
from newsmill.session import materialize, ship_package

WINDOW, MEAN_WORDS, STRETCH, MOST_BYTES = 16, 4, 64, 4096
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gears of the last WINDOW bytes, each shifted by 2 for every byte after it."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        later = h.copy()
        later[span:] += h[:-span] << np.uint32(2 * span)
        h, span = later, 2 * span
    return h


def unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes of letters of the scripts without blanks: U+0E00-0EFF, U+1000-109F, U+1780-17FF, U+3000-9FFF, U+20000 and up."""
    after = np.append(data[1:], 0)
    wide = (data >= 0xE3) & (data <= 0xE9)
    thai = (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    burmese = (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))
    return wide | thai | burmese | ((data == 0xF0) & (after >= 0xA0))


def unbroken(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes since the last white space or the text's beginning, less STRETCH."""
    at = np.arange(len(data))
    since = np.where(SPACES[data], at, -1)
    begin = ends[1:-1][ends[1:-1] < len(data)]
    since[begin] = begin
    return at - np.maximum.accumulate(np.maximum(since, 0)) - STRETCH


def borders(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks begin or end in texts laid end to end; ``ends`` are the texts' borders."""
    h, space = gear_hash(data), SPACES[data]
    few = lambda n: h < np.uint32((1 << 32) // n)
    low = space & few(MEAN_WORDS)
    if (data >= 0xE0).any():
        first = np.flatnonzero(unspaced(data))
        last = first + np.where(data[first] >= 0xF0, 3, 2)
        low[last] |= few(2 * MEAN_WORDS)[last]
    dense = unbroken(data, ends) >= 0
    if dense.any():
        whole = np.append(data[1:] & 0xC0 != 0x80, True)  # a character ends here
        low |= dense & whole & few(6 * MEAN_WORDS)
    cut = np.flatnonzero(low) + 1
    text = np.searchsorted(ends, cut, side="right") - 1
    cut = cut[cut - ends[text] >= WINDOW]  # before that the hash holds bytes of another text
    cut = np.union1d(cut, ends)
    wide = np.flatnonzero(np.diff(cut) > MOST_BYTES)
    if len(wide):
        more = []
        for i in wide:
            for at in range(int(cut[i]) + MOST_BYTES, int(cut[i + 1]), MOST_BYTES):
                while data[at] & 0xC0 == 0x80:
                    at -= 1
                more.append(at)
        cut = np.union1d(cut, more)
    return cut


def word_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many half words begin at each byte: two for a word between white space, one for a letter
    of a script without blanks and for three bytes after STRETCH without white space."""
    inside = ~SPACES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = ends[:-1][ends[:-1] < len(data)]
    first[begin] = inside[begin]  # whatever the text before ends with
    half = 2 * first.astype(np.int32)
    over = unbroken(data, ends)
    half = np.where((over >= 0) & (over % 3 == 0), 1, half)
    if (data >= 0xE0).any():
        half = np.where(unspaced(data), 1, half)
    return half


def pair_digests(digest: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of neighbouring chunks and the lists' borders; ``of`` are the documents' borders among the chunks."""
    d = np.append(digest.view(np.uint64), np.uint64(0))
    mixed = (d[:-1] ^ (d[:-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + d[1:]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    alone = (d[:-1] ^ (d[:-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    sizes = np.diff(of)
    keep = np.ones(len(digest), bool)
    last = of[1:][sizes > 0] - 1
    keep[last] = False
    single = of[:-1][sizes == 1]
    keep[single] = True
    mixed[single] = alone[single]
    return mixed[keep].view(np.int64), np.r_[0, np.cumsum(np.where(sizes == 1, 1, np.maximum(sizes - 1, 0)))]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, pairs, starts, halves): a row a document; starts are code points and hold one more, the length."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in slices(batches, "text", 2 << 20):
            data, ends = joined_bytes(b.column("text"))
            cut = borders(data, ends) if len(data) else ends[:1]
            raw, at = data.tobytes(), cut.tolist()
            digest = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(at, at[1:])], np.uint64).view(np.int64)
            points = np.r_[0, np.cumsum(data & 0xC0 != 0x80, dtype=np.int32)]
            halves = np.diff(np.r_[0, np.cumsum(word_starts(data, ends), dtype=np.int32)][cut])
            of = np.searchsorted(cut, ends)  # a text's border among the chunks' borders
            pairs, pair_ends = pair_digests(digest, of)
            starts = points[cut]
            own = [starts[i : j + 1] - starts[i] for i, j in zip(of, of[1:])]
            own_ends = np.cumsum([0, *map(len, own)])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("row"), lists(pairs, pair_ends, pa.int64()), lists(np.concatenate(own), own_ends, pa.int32()), lists(halves, of, pa.int32())],
                ["id", "row", "pairs", "starts", "halves"],
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, row long, pairs array<long>, starts array<int>, halves array<int>")


def _one_row_each(table: DataFrame) -> DataFrame:
    """One row of each (id, row). Only rows that repeat both are moved; their chunks are collapsed in tasks first."""
    twice = table.groupBy("id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "row")
    twice = materialize(twice, "repeated-rows")
    if not twice.limit(1).count():
        return table
    again = table.join(twice, ["id", "row"], "left_semi").groupBy("id", "row").agg(*(F.first(c).alias(c) for c in ("pairs", "starts", "halves")))
    return materialize(table.join(twice, ["id", "row"], "left_anti").unionByName(again), "chunks")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """(id, row, start, end, n_words, first_id, kept): the repeated spans in code points, ends exclusive.

    ``kept`` parts of a span have the smallest id among the holders of a pair over each of their
    chunks; the others are copies. A span of both kinds is cut where the kind changes.
    """
    table = _one_row_each(materialize(chunks(docs, id_col, text_col).where("id IS NOT NULL"), "chunks"))
    held = table.select("id", F.explode(F.array_distinct("pairs")).alias("pair"))
    repeated = held.groupBy("pair").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id <> last_id")
    repeated = materialize(repeated.select("pair", "first_id"), "repeated-pairs")
    at = table.select("id", "row", F.posexplode("pairs").alias("seq", "pair"))
    hits = at.join(repeated, "pair").select("id", "row", "seq", "first_id")
    order = Window.partitionBy("id", "row").orderBy("seq")
    runs = hits.withColumn("run", F.col("seq") - F.row_number().over(order))
    spans = runs.groupBy("id", "row", "run").agg(F.sort_array(F.collect_list(F.struct("seq", "first_id"))).alias("hits"))
    spans = spans.join(table.select("id", "row", "starts", "halves"), ["id", "row"])
    first = F.col("hits")[0]["seq"]
    count = F.least(F.size("hits") + 1, F.size("halves") - first)  # chunks; a text of one chunk has one pair
    total = F.aggregate(F.slice("halves", first + 1, count), F.lit(0), lambda a, x: a + x)
    spans = spans.where(total >= 2 * min_words)
    at_text = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(
        (first + k).alias("seq"), F.greatest(F.get("hits", k - 1)["first_id"], F.get("hits", k)["first_id"]).alias("first_id"),
        F.col("starts")[first + k].alias("start"), F.col("starts")[first + k + 1].alias("end"), F.col("halves")[first + k].alias("h"),
    ))
    parts = spans.select("id", "row", F.explode(at_text).alias("x")).select("id", "row", "x.*")
    parts = parts.withColumn("kept", F.col("first_id") == F.col("id"))
    by_kind = Window.partitionBy("id", "row", "kept").orderBy("seq")
    parts = parts.withColumn("run", F.col("seq") - F.row_number().over(by_kind))
    return parts.groupBy("id", "row", "kept", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.expr("sum(h) div 2").alias("n_words"), F.min("first_id").alias("first_id")
    ).select("id", "row", "start", "end", "n_words", "first_id", "kept")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """``docs`` whose texts lack the spans that a smaller id keeps."""
    gone = repeats(docs, id_col, text_col, min_words).where("NOT kept")
    gone = gone.groupBy(F.col("id").alias("_gid"), F.col("row").alias("_grow")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_gone"))
    gone = gone.where("_gid IS NOT NULL")
    text = F.col(text_col)
    joined = docs.join(gone, (F.col(id_col) == F.col("_gid")) & (F.xxhash64(text_col) == F.col("_grow")), "left")
    from_ = F.concat(F.array(F.lit(0)), F.col("_gone.end"))
    to = F.concat(F.col("_gone.start"), F.array(F.char_length(text)))
    kept = F.array_join(F.zip_with(from_, to, lambda a, b: F.substring(text, a + 1, b - a)), "")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNull(), text).otherwise(kept)).drop("_gid", "_grow", "_gone")


def query(spark, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", "n_words", F.col("first_id").alias("first_doc_id"), "kept")
