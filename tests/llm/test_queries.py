"""Registered queries, as they are, against plain restatements of what they are to return; and rows that crowd one key."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_chunks_and_vectors import plain_spans
from test_filters import plain_statistics
from test_near_duplicates import brute, plain_fingerprint
from test_tokens_and_files import word_ids

from newsmill.llm import chunk_dedup, ngram_quality, packing, quality_rules, secret_scan, simhash, sorted_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 160))) for _ in range(60)]
    texts += [texts[3], texts[3] + " tail", texts[7].upper(), "Ä ö é " * 40, "# $ x\n# $ x\n" * 30, "one two", "", None, "word " * 3000]
    return [(1000 - 3 * i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{d}/documents.parquet")
    return d


def test_simhash_query(spark, rows, sf_dir):
    got = simhash.query(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    component = brute(sorted(prints))
    assert sorted(map(tuple, got.collect())) == sorted((i, f"{x:016x}", component[i]) for i, x in prints)


def test_sorted_shards_query(spark, rows, sf_dir):
    got = sorted_shards.query(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    want, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array(word_ids(t) + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got.collect())) == want


def test_quality_query(spark, rows, sf_dir):
    got = quality_rules.query(spark, sf_dir)
    assert [c for c, _ in got.dtypes[:8]] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert {k for _, k in got.dtypes[1:6]} == {"bigint"}
    texts = {r[0]: r[1] for r in rows}
    found = got.collect()
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(rows)
    for r in found:
        stats = plain_statistics(texts[r.doc_id])
        failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        assert tuple(r)[1:7] == (*stats, failed) and not (failed and r.kept)


def test_chunk_query(spark, rows, sf_dir):
    got = chunk_dedup.query(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "end", "n_words", "first_doc_id", "kept"]
    assert {tuple(r) for r in got.collect()} == plain_spans([(r[0], r[1]) for r in rows])


def test_packing_query(spark, rows, sf_dir):
    found = packing.query(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns)
    found = found.collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(word_ids(t) + [0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            want[i, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    for s in {r.sequence_id for r in found}:
        end = 0
        for r in sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048


def test_shards_of_one_crowded_id(spark, tmp_path):
    """A third of all rows has one id; their texts spread them over tasks."""
    path = f"{tmp_path}/hot"
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be one task
    try:
        sorted_shards.write_shards(df, path, shard_blocks=3, block_bytes=200)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = [r for r in sorted_shards.read_shards(spark, path).select("shard", "doc_id").collect() if r.doc_id == 5]
    assert len(hot) == 300 and len({r.shard.rsplit("part-", 1)[1][:5] for r in hot}) > 1
    rows = sorted_shards.token_starts(spark, path).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows][:-1]]).tolist()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert len(sorted_shards.lookup(spark, path, [5])) == 300


def test_repeats_of_one_crowded_row(spark):
    """A third of all rows repeats an id and a text: they are one row."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    shared = " ".join(rng.sample(words, 60))
    docs = [(i, " ".join(rng.sample(words, 30)) + " " + shared) for i in range(40)]
    df = spark.createDataFrame(docs + [docs[4]] * 200, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r[c] for c in ("id", "start", "end", "n_words", "first_id", "kept")) for r in chunk_dedup.repeats(df).collect())
    assert got == sorted(plain_spans(docs))


def test_the_dictionary_takes_ties_by_name(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta", "alpha zeta eta theta", "zeta"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ranked = ["alpha", "beta", "delta", "gamma", "zeta", "eta", "theta"]
    for most in range(1, 9):
        assert secret_scan.ranked_words(df, most=most, least_docs=1) == ranked[:most]


def test_limits_are_counts_and_repeat(spark):
    rng = random.Random(6)
    values = [("en", 0, rng.uniform(1, 500)) for _ in range(997)] + [("de", 1, rng.uniform(5, 9)) for _ in range(19)]
    df = spark.createDataFrame(values, "l string, size int, perplexity double")
    found = set()
    for parts in (1, 5):
        binned = df.repartition(parts).withColumn("bin", F.floor(F.log("perplexity") * ngram_quality.BINS)).groupBy("l", "size", "bin").agg(F.count(F.lit(1)).alias("n"))
        found.add(tuple(map(tuple, ngram_quality._limits(binned, ["l", "size"], 0.99, 1.25, 20, "limit").collect())))
    ((lang, size, limit),) = found.pop()
    at = sorted(x for lang, _, x in values if lang == "en")[987 - 0]
    assert not found and (lang, size) == ("en", 0) and at * 1.25 <= limit <= at * 1.25 * 1.0011


