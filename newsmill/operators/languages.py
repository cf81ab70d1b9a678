"""Language detection: naive Bayes over the characters of texts whose language is known.

The model is fitted on at most ``SAMPLE`` texts a language (those of the smallest hashes) and their first ``FIT_CHARS`` characters,
whatever the table's size: counts of their n-grams of one to ``ORDER`` characters, hashed to ``SLOTS`` places.
It has a row of ``SLOTS`` logarithms for each of at most ``MOST_LANGUAGES`` languages. A text gets the language of the greatest
sum over all its n-grams; ties go to the first name.

Defined cases: a text without a letter has no language (null); without any known text nothing has one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.session import ship_package

SAMPLE, FIT_CHARS, ORDER, SLOTS, MOST_LANGUAGES = 1000, 4000, 3, 1 << 14, 500
#: Counted on top of each place, so that what was never seen has a chance.
PRIOR = 0.5


def gram_slots(text: str | None) -> np.ndarray:
    """The places of a text's n-grams: letters in lower case, all else a blank; none without a letter."""
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    low = f" {' '.join(low.split())} "
    if low.isspace():
        return np.empty(0, np.int64)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(found)


@dataclass(frozen=True)
class Detector:
    """Names and a row of logarithms for each."""

    names: tuple[str, ...]
    weights: np.ndarray

    def of(self, text: str | None) -> str | None:
        at = gram_slots(text)
        if not len(at) or not self.names:
            return None
        slots, n = np.unique(at, return_counts=True)
        return self.names[int((self.weights[:, slots] @ n).argmax())]

    def __call__(self, text: Column) -> Column:
        names, weights = self.names, self.weights

        @F.arrow_udf("string")
        def run(texts: pa.Array) -> pa.Array:
            own = Detector(names, weights)
            return pa.array([own.of(t) for t in texts.to_pylist()], pa.string())

        return run(text)


def fit(known: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Detector:
    """The model of ``known`` texts; rows without a language are left out."""
    ship_package(known.sparkSession)
    rows = known.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, FIT_CHARS).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    sample = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE)

    def run(batches):
        for b in batches:
            of = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for lang in dict.fromkeys(of.tolist()):
                counts = np.zeros(SLOTS, np.int64)
                for i in np.flatnonzero(of == lang):
                    counts += np.bincount(gram_slots(texts[i]), minlength=SLOTS)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "slot", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = counted.limit(MOST_LANGUAGES * SLOTS + 1).toArrow()  # a row a place and language
    names = tuple(sorted(set(table.column("lang").to_pylist())))
    if len(names) > MOST_LANGUAGES or table.num_rows > MOST_LANGUAGES * SLOTS:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.full((len(names), SLOTS), PRIOR)
    row = {x: i for i, x in enumerate(names)}
    counts[[row[x] for x in table.column("lang").to_pylist()], table.column("slot").to_numpy()] += table.column("n").to_numpy()
    return Detector(names, np.log(counts / counts.sum(1, keepdims=True)) if names else counts)
