"""A table that batches change by key, and a memo kept in one.

Rows lie in buckets by a hash of their keys. A batch reads and writes only the buckets it touches, into a folder of its
own number; a row a bucket in the log, written last, makes them the buckets' newest version. So a batch that dies
leaves nothing that counts and is done again from the start, a batch whose number is in the log changes
nothing, and the files of untouched buckets stay as they are. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from newsmill.session import materialize

LOG = StructType([StructField("batch", LongType()), StructField("bucket", LongType())])

#: (old rows of the touched buckets, the batch's rows) to the buckets' new rows.
Change = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """``keys`` name a row; ``schema`` has them and the values."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, keys, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("bigint")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def log(self) -> DataFrame:
        """(batch, bucket) of all batches that ended."""
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log") if self._exists(f"{self.path}/log") else self.spark.createDataFrame([], LOG)

    def versions(self) -> dict[int, int]:
        """The newest batch of each bucket: a row a bucket at most."""
        return {r.bucket: r.batch for r in self.log().groupBy("bucket").agg(F.max("batch").alias("batch")).collect() if r.bucket >= 0}

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        paths = [f"{self.path}/batch={n}/bucket={b}" for b, n in self.versions().items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, number: int, change: Change) -> bool:
        """Applies a batch; False where its number is in the log already."""
        if self.log().where(F.col("batch") >= number).limit(1).count():
            return False
        rows = materialize(rows.withColumn("_bucket", self._bucket()), "keyed-batch")
        touched = {r[0] for r in rows.select("_bucket").distinct().collect()}  # not more than there are buckets
        after = change(self.read(touched), rows.drop("_bucket")).select(*self.schema.names)
        placed = after.withColumn("bucket", self._bucket()).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        for b in touched:  # a bucket that a deletion emptied has a version, too
            if not self._exists(f"{self.path}/batch={number}/bucket={b}"):
                self.spark.createDataFrame([], self.schema).coalesce(1).write.parquet(f"{self.path}/batch={number}/bucket={b}")
        ended = [(number, b) for b in sorted(touched)] or [(number, -1)]
        self.spark.createDataFrame(ended, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return True

    def upsert(self, rows: DataFrame, number: int, order: str) -> bool:
        """The greatest ``order`` of a key counts, of a batch and of what is there; equal ones go by the greatest values."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in self.schema.names if c not in self.keys]
            both = old.unionByName(new.select(*self.schema.names))
            return both.groupBy(*self.keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_v")).select(*self.keys, "_v.*")

        return self.merge(rows, number, change)

    def increment(self, rows: DataFrame, number: int, counters: list[str]) -> bool:
        """Adds a batch's counters to a key's; a new key starts at zero, other values are the greatest ones."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.unionByName(new.select(*self.schema.names))
            rest = [c for c in self.schema.names if c not in (*self.keys, *counters)]
            return both.groupBy(*self.keys).agg(*(F.sum(F.coalesce(c, F.lit(0))).cast(self.schema[c].dataType).alias(c) for c in counters), *(F.max(c).alias(c) for c in rest))

        return self.merge(rows, number, change)

    def insert(self, rows: DataFrame, number: int) -> bool:
        """Rows of new keys; of several of a key the smallest."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in self.schema.names if c not in self.keys]
            fresh = new.join(old.select(*self.keys), self.keys, "left_anti").groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("_v")).select(*self.keys, "_v.*")
            return old.unionByName(fresh.select(*self.schema.names))

        return self.merge(rows, number, change)

    def delete(self, keys: DataFrame, number: int) -> bool:
        """Without the rows of ``keys``; unknown keys delete nothing."""
        return self.merge(keys.select(*self.keys), number, lambda old, gone: old.join(gone.distinct(), self.keys, "left_anti"))

    def sink(self, stream: DataFrame, apply: Callable[[DataFrame, int], object]):
        """A writer that applies each of a stream's batches under its own number, for example ``lambda rows, n: table.upsert(rows, n, "at")``."""
        return stream.writeStream.foreachBatch(lambda rows, n: apply(rows, n) and None).option("checkpointLocation", f"{self.path}-state")

    def vacuum(self) -> int:
        """Deletes versions that no bucket has any more; how many. Not while somebody reads them."""
        now, jvm, gone = self.versions(), self.spark._jvm, 0
        for r in self.log().where("bucket >= 0").distinct().toLocalIterator():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={r.batch}/bucket={r.bucket}")
            if now[r.bucket] != r.batch and path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True):
                gone += 1
        return gone


MEMO = StructType([StructField("key", StringType()), StructField("value", StringType()), StructField("made_at", TimestampNTZType())])


def memoised(texts: DataFrame, memo: KeyedTable, compute: Callable[[Column], Column], key: Column, as_of: str, number: int, hours: int = 24) -> DataFrame:
    """``texts`` with value and computed: a result that is younger than ``hours`` at ``as_of`` is taken from the memo, the others are computed, once
    for each key, and put there. ``compute`` makes a string of the text column; of a key's texts the smallest is used.

    A result of exactly ``hours`` is too old, as one that was never there.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    rows = materialize(texts.withColumn("_key", key), "memo-texts")
    known = memo.read().where(F.col("made_at") > now - F.expr(f"INTERVAL '{hours}' HOUR")).select(F.col("key").alias("_key"), "value", F.lit(False).alias("computed"))
    asked = rows.groupBy("_key").agg(F.min("text").alias("text"))
    missing = asked.join(known, "_key", "left_anti")
    made = materialize(missing.select("_key", compute(F.col("text")).alias("value"), F.lit(True).alias("computed")), "memo-made")
    memo.upsert(made.select(F.col("_key").alias("key"), "value", now.alias("made_at")), number, "made_at")
    found = made.unionByName(known.join(asked.select("_key"), "_key", "left_semi"))
    return rows.join(materialize(found, "memo-found"), "_key").drop("_key")
