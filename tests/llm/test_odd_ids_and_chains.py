"""Large and null ids, long chains of links, and rows that repeat an id."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsmill.llm import line_dedup, linking, ngram_quality, packing, simhash

BIG = 1152921504606846977


def test_packing_keeps_large_and_null_ids(spark):
    df = spark.createDataFrame([(BIG, "a b"), (None, "a b"), (None, None), (BIG + 2, "c")] + [(5, "same text")] * 40, "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i in [BIG, BIG + 2, None, None, *[5] * 40])


def test_equal_pieces_are_dealt_over_all_groups(spark):
    df = spark.createDataFrame([(5, "same text")] * 300, "doc_id long, text string")
    pieces = packing.token_pieces(df)
    rows = packing.pack(pieces, group_pieces=30).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(rows) == 300 and len(groups) == 10 and max(map(len, groups.values())) < 60


@pytest.mark.parametrize("low, high, most", [(300, 1100, 1.015), (500, 1024, 1.07), (1, 300, 1.0)])
def test_swap_search_stops_only_where_no_exchange_helps(low, high, most):
    lengths = np.random.default_rng(low).integers(low, high, 1500)
    search = packing.SwapSearch(packing.best_fit(lengths, 2048), lengths, 2048)
    bins = search.run(int(lengths.sum()))
    least = -(-int(lengths.sum()) // 2048)
    assert least <= len(bins) <= most * least + 1
    assert len(bins) == least or not any(search.step(s) for s in range(len(search.bins)) if 0 < search.fill[s] < 2048)


def test_joined_scores_keep_large_ids(spark):
    texts = [(BIG, "en", "abc abd"), (None, "en", "abd"), (3, None, "abc")]
    docs = spark.createDataFrame(texts, "id long, lang string, text string")
    trusted = spark.createDataFrame([(3,), (BIG,)], "id long")
    got = {}
    for limit in (0, 10**6):
        got[limit] = sorted(((r.id is None, r.id or 0), round(r.perplexity, 9)) for r in ngram_quality.perplexities(docs, trusted, limit).collect())
    assert got[0] == got[10**6] and [x[0] for x in got[0]] == [(False, 3), (False, BIG), (True, 0)]


def test_a_long_chain_in_one_bucket():
    n = 5000
    order = np.random.default_rng(0).permutation(n)
    stars = linking.Stars(np.arange(n) + 10)
    for at in range(0, n - 1, 700):
        stars.add(order[at : at + 700][: n - 1 - at], order[at + 1 : at + 701])
    rows = stars.rows()
    assert rows.num_rows == n and set(rows.column("root").to_pylist()) == {10}
    assert pa.compute.sum(rows.column("links")).as_py() == 2 * (n - 1)


def test_a_chain_of_a_thousand_fingerprints(spark):
    """Each differs from the next in four bits of the lower half, so that many share a bucket."""
    rng = np.random.default_rng(1)
    x, chain = 0, []
    for i in range(1000):
        chain.append((i, x))
        for bit in rng.choice(40, 4, replace=False):
            x ^= 1 << int(bit)
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in chain], "id long, fp long").repartition(4)
    got = {r.id: r.component for r in df.join(simhash.fingerprint_components(df), "fp").collect()}
    assert len(got) == 1000 and set(got.values()) == {0}


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    words = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    third = " ".join(f"third{i}" for i in range(80))
    rows = [(1, words), (5, words), (5, other), (5, other), (None, words), (None, third), (None, third), (7, other)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text[:5]) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect())
    assert got == [((False, 1), "word0"), ((False, 5), "other"), ((True, 0), "third")]


def test_line_dedup_replaces_columns_named_like_its_results(spark):
    line = "a line that is certainly longer than forty characters"
    df = spark.createDataFrame([(i, line, "x", i, "y") for i in range(6)], "doc_id long, text string, kept string, n_lines int, _doc string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_doc", "n_lines", "n_dropped", "kept"]
    assert sorted((r.doc_id, r.kept) for r in out.collect()) == [(i, line if i == 5 else "") for i in range(6)]


def test_line_ranges_need_one_exchange(spark):
    hashes = line_dedup.line_hashes(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text")), "doc_id", "text", 40)
    plan = line_dedup.held_lines(hashes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
