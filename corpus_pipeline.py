"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, secret redaction, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the
last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsmill.llm import line_dedup, packing, quality_rules, secret_scan, simhash
from newsmill.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; n_chars keeps its type."""
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return docs.select("doc_id", "text", "lang", "source", n_chars)


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text hash are among ``keys`` (id, row), which are as many as documents and so are not broadcast."""
    same = docs["doc_id"].eqNullSafe(keys["id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys["row"])
    return docs.hint("merge").join(keys, same, "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed limits or lie far from their language and source go."""
    judged = quality_rules.judge(docs.withColumn("row", F.xxhash64("text")), carry=("doc_id", "row"))
    return _only(docs, judged.where("kept").select(F.col("doc_id").alias("id"), "row"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in one of them."""
    return _counted(line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one of the smallest id.

    Rows are told apart by id and text. Where rows repeat an id, the smallest text hash stays; of
    rows that repeat both, one stays. Rows without an id stay only where no row of an id is like them.
    """
    stays = materialize(simhash.keepers(simhash.near_duplicates(docs)), "keepers")
    once = _only(docs, stays.where("copies = 1"))
    repeated = _only(docs, stays.where("copies > 1")).withColumn("_row", F.xxhash64("text"))
    return once.unionByName(repeated.dropDuplicates(["doc_id", "_row"]).drop("_row"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _counted(secret_scan.redact(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: where it lies in which sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: Two stages (robust estimates, a tokenizer) are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
