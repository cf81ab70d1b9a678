"""Line dedup with DataFrame functions only.

Every text is split at ``\\n``; a line's key is the line without ASCII white space at its
ends and with A-Z in lower case. Only 128-bit hashes of the keys travel. A key of at least
``min_chars`` code points that at least ``min_docs`` documents hold is repeated: all its
lines go except those of the largest id that holds it.

Plan: hashes of a document's lines are written once (ids and hashes, no text). Its long lines
are range-partitioned by hash and id and sorted by hash, id, text and position. Ids are part of
the range, so a line that a third of all documents hold is spread over many ranges. One pass
over each sorted range marks the first occurrence of a key in a document and folds the
document's places of the key into bitmaps, 64 lines a word; both need no further exchange.
What a range knows of a key (documents, greatest id) is one row, and these rows are added up
over the ranges' borders. Bitmaps of repeated keys are joined to one map a document.

Defined cases: a null or empty text is one empty line; rows that repeat an id are one
document, which null ids are, too (it is smaller than all others); an empty table gives an
empty table; columns named like a result (n_lines, n_dropped, kept) are replaced, others left
alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.session import materialize

SPACE = " \t\n\x0b\f\r"
RESULTS = ("n_lines", "n_dropped", "kept")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line, trimmed and with A-Z lowered; letters beyond ASCII stay as they are."""
    trimmed = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row, lines): for each line the two halves of its key's hash, or null if it is short."""

    def digest(line: Column) -> Column:
        long_enough = F.char_length(F.btrim(line, F.lit(SPACE))) >= min_chars
        key = line_key(line)
        return F.when(long_enough, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("row"),
        F.transform(lines_of(F.col(text_col)), digest).alias("lines"),
    )


def held_lines(hashes: DataFrame) -> DataFrame:
    """(h1, h2, id, row, word, bits, first): a document's bitmap of each key; one row of a key and id is ``first``."""
    at = hashes.select("id", "row", F.posexplode("lines").alias("pos", "k")).where(F.col("k").isNotNull())
    ranged = at.select("k.h1", "k.h2", "id", "row", "pos").repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "row", "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("row", "pos")) == 1
    return (
        ranged.withColumn("first", first)
        .groupBy("h1", "h2", "id", "row", F.expr("pos div 64").cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pmod(pos, 64))")).alias("bits"), F.bool_or("first").alias("first"))
    )


def repeated_keys(held: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper) of the keys that at least ``min_docs`` documents hold."""
    return (
        held.where("first").groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )


def drop_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """(id, row, words) of the documents that lose lines.

    ``row`` is the XXH64 of the text, which tells rows with one id apart. ``words`` maps
    line number div 64 to a bitmap of the lines to drop; words without a bit are left out.
    """
    hashes = materialize(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    held = materialize(held_lines(hashes), "held-lines")
    # Written, so that the join stands on two plain exchanges and Spark can split a hot key's rows.
    keys = materialize(repeated_keys(held, min_docs), "repeated-keys")
    gone = held.join(keys, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    words = gone.groupBy("id", "row", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` and the columns n_lines, n_dropped and kept (the lines that stay, joined by ``\\n``)."""
    d = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"))
    b = bitmaps.select(F.col("id").alias("_bid"), F.col("row").alias("_brow"), F.col("words").alias("_words"))
    joined = d.join(b, F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_row") == F.col("_brow")), "left")
    text = F.col("_doc").getField(text_col)
    lines = lines_of(text)
    dense = F.transform(
        F.sequence(F.lit(0), F.expr("(size(_lines) - 1) div 64").cast("int")),
        lambda w: F.coalesce(F.try_element_at("_words", w), F.lit(0).cast("bigint")),
    )
    dropped = F.aggregate(F.map_values("_words"), F.lit(0), lambda n, w: n + F.bit_count(w))
    with_lines = joined.withColumn("_lines", lines).withColumn("_dense", F.when(F.col("_words").isNotNull(), dense))
    stays = lambda line, i: F.getbit(F.element_at("_dense", (i / 64).cast("int") + 1), i % 64) == 0
    kept = F.array_join(F.filter("_lines", stays), "\n")
    others = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in RESULTS]
    return with_lines.select(
        *others,
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("_words").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("kept"),
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept."""
    return apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone
  FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
