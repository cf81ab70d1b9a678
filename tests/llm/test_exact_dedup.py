"""The extendible-hash index against a dictionary of texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from newsmill.llm import exact_dedup


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    """(id, keep_id, group_size, kept, sha256) of each (id, text)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stays = True
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out.append((i, keep, len(ids), stays and i == keep, hashlib.sha256(t.encode()).hexdigest()))
            stays = stays and i != keep
    return Counter(out)


def clash():
    """Few hashes, in few prefixes: every chain is long. (Made here, so that it travels by value.)"""
    return lambda text, seed: xxhash.xxh64_intdigest(text, seed=seed) % 5 << 60


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "Äpfel A"), (5, "äpfel A"), (6, "Äpfel a"), (7, "x"), (7, "x"), (7, "X"), (None, "x"), (None, "only null"), (None, "ONLY null"),
    (8, "long " * 400_000), (9, "LONG " * 400_000), (10, "long " * 400_000 + "."), (1 << 61, "x\x00y"), (-5, "X\x00Y"), (11, "x\ny"),
]
SCHEMA = "doc_id long, text string, h string, owner string, ids string"


@pytest.mark.parametrize("digest", [lambda: xxhash.xxh64_intdigest, clash])
def test_groups_equal_a_dictionary_of_texts(spark, digest):
    hot = [(100 + i, "The same Text" if i % 3 else f"text {i % 40}") for i in range(3000)]
    rows = ROWS + hot
    docs = spark.createDataFrame([(i, t, "h", "o", None) for i, t in rows], SCHEMA).repartition(7)
    found = exact_dedup.dedup_exact(docs, bucket_bytes=3000, page_rows=50, digest=digest()).collect()
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, r.sha256) for r in found) == plain(rows)


def test_a_hot_hash_has_pages_and_small_buckets(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text number {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    to = exact_dedup.build_directory(exact_dedup.hashes(docs, "text"), bucket_bytes=2000, page_rows=100)
    h = xxhash.xxh64_intdigest("copy", seed=exact_dedup.SEED)
    assert list(to.hot) == [h] and to.hot[h][1] == 20
    dealt = exact_dedup.deal(docs, "doc_id", "text", to)
    sizes = Counter(r.owner for r in dealt.select("owner").collect())
    assert max(sizes.values()) < 150 and sum(sizes.values()) < 4000 + 41


def test_directory_splits_overfull_buckets_only():
    counted = np.zeros(1 << exact_dedup.MOST_DEPTH, np.int64)
    counted[:64] = 100  # a crowded corner
    counted[40_000] = 10**9  # can't be split
    to = exact_dedup.directory(counted, {7: 3}, 500)
    rng = np.random.default_rng(1)
    sums = np.bincount(to.pointers.repeat(1 << exact_dedup.MOST_DEPTH - to.depth), counted)
    deepest = to.local_depth == exact_dedup.MOST_DEPTH
    assert (sums[~deepest] <= 500).all() and to.owners == len(sums) + 3
    assert (np.diff(to.pointers) >= 0).all()
    assert (np.bincount(to.pointers) == 1 << to.depth - to.local_depth).all()
    for h in rng.integers(0, 1 << 63, 100).tolist():
        assert to.owner(h, 5) == (-1, to.pointers[h >> 64 - to.depth])
    assert to.owner(7, 5) == (2, len(sums) + 2)


def test_one_bucket_and_an_empty_table(spark):
    empty = exact_dedup.directory(np.zeros(1 << exact_dedup.MOST_DEPTH, np.int64), {}, 1)
    assert (empty.depth, empty.owners, empty.bucket((1 << 64) - 1)) == (0, 1, 0)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.dedup_exact(docs).count() == 0


def test_query(spark, tmp_path):
    docs = [(i, t, "en", "a", 1) for i, t in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = exact_dedup.query(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
    assert Counter(map(tuple, got.collect())) == plain(ROWS)
