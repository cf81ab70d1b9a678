"""Tokenizing operators against the tokenizers library, and files against what went in."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsmill.llm import bpe, packing, sorted_shards
from newsmill.llm.tokens import encoder, vocabulary_path

TEXTS = [
    None,
    "",
    " ",
    "a\x1cb c\x1d\x1e\x1f d  ",
    "Héllo <|endoftext|>world <|endoftext|>\x1cfoo\x85bar᠎baz​q a b İstanbul ΣΑΣ x́ é",
    "don't we'll  ' 's",
    "１２ ½ ⅷ 漢字　x \U0001f600",
    "a" * 70_000,
    "ab" * 3000 + " " + "word " * 9000,
    "\n\n\n  \t x",
    "the same text",
    "the same text",
    "<|startoftext|>x<|endoftext|>",
]
SCHEMA = "doc_id long, text string, lang string, ids string, _group string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "x", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def word_ids(text):
    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_library():
    enc = encoder(vocabulary_path("word_bpe_49k.json"))
    got = [np.frombuffer(x, "<u2").tolist() for x in enc.ids(TEXTS)]
    assert got == [word_ids(t) for t in TEXTS]


def test_byte_bpe_equals_library(spark, docs):
    lib = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text", "lang"))).collect()
    assert len(coded) == len(TEXTS)
    for r in coded:
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs.where("false")).count() == 0


def test_shards_round_trip_and_lookup(spark, docs, tmp_path):
    path = f"{tmp_path}/shards"
    more = docs.unionByName(spark.createDataFrame([(None, "null id", "en", None, None), (3, "again", "en", None, None), (-5, "below zero", "en", None, None)], SCHEMA))
    sorted_shards.write_shards(more, path)
    rows = sorted_shards.token_starts(spark, path).collect()
    expected = sorted([(-(1 << 62) if r.doc_id is None else r.doc_id, r.doc_id, [*word_ids(r.text), 2]) for r in more.collect()], key=lambda x: x[0])
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [x[1] for x in expected]
    assert sorted(r.n_tokens for r in got) == sorted(len(x[2]) for x in expected)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    by_id = {}
    for _, d, ids in expected:
        by_id.setdefault(d, []).append(ids)
    for r in got:
        assert r.ids_crc32 in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in by_id[r.doc_id]]
    found = sorted_shards.lookup(spark, path, [3, -5, 8, 77, None])
    assert [i for i, _ in found] == [None, -5, 3, 3, 8]
    for i, ids in found:
        assert np.frombuffer(ids, "<u2").tolist() in by_id[i]


def test_shards_roll_and_lookups_read_blocks(spark, tmp_path):
    path = f"{tmp_path}/rolled"
    df = spark.range(400).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text")).repartition(2)
    sorted_shards.write_shards(df, path, shard_blocks=4, block_bytes=200)
    feet = sorted_shards.footers(spark, path).collect()
    assert len(feet) > 8 and sum(r.n_docs for r in feet) == 400
    assert all(a.last_id < b.first_id for a, b in zip(sorted(feet, key=lambda r: r.first_id), sorted(feet, key=lambda r: r.first_id)[1:]))
    rows = sorted_shards.token_starts(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [3 * i for i in range(400)]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows][:-1]]).tolist()
    assert sorted_shards.places(spark, path, [600]).count() <= 2
    assert [i for i, _ in sorted_shards.lookup(spark, path, [600, 601, 9999, 0, 1197])] == [0, 600, 1197]


def test_shards_of_an_empty_table(spark, docs, tmp_path):
    sorted_shards.write_shards(docs.where("false"), f"{tmp_path}/none")
    assert sorted_shards.token_starts(spark, f"{tmp_path}/none").count() == 0


def test_shard_blocks_are_prefix_compressed_and_searchable():
    entries = [(sorted_shards.key_of(i * 7), bytes([i % 251]) * 2000) for i in range(1000)]
    data = b"".join(r + b"\n" for r in sorted_shards.shard(iter(entries), 2))
    s = sorted_shards.Shard(data)
    assert len(s.blocks) > 3 and list(s) == entries
    assert all(s.get(k) == [v] for k, v in entries[::37])
    misses = [sorted_shards.key_of(i * 7 + 1) for i in range(1000)]
    assert all(s.get(k) == [] for k in misses) and sum(map(s.may_hold, misses)) < 50
    with pytest.raises(ValueError):
        sorted_shards.Shard(data[:-3] + b"xx\n")


def test_packing_keeps_every_token_once(spark, docs):
    rows = packing.pack_documents(docs).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*word_ids(t), 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 2048))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_swap_search_never_worse_than_best_fit():
    rng = np.random.default_rng(1)
    for top in (300, 900, 1500, 2047):
        lengths = rng.integers(1, top, 700)
        before = packing.best_fit(lengths, 2048)
        after = packing.pack_group(lengths)
        assert sorted(i for b in after for i in b) == list(range(700))
        assert all(lengths[b].sum() <= 2048 for b in after) and len(after) <= len(before)


def test_swap_search_empties_a_bin_that_best_fit_leaves():
    lengths = np.array([5, 5, 4, 4, 3, 3, 3, 3])  # 30 in all: best fit by length takes 4 bins of 10
    assert len(packing.pack_group(lengths, 10)) == 3


def test_digest_columns(spark):
    row = next(r for r in bpe.query(spark, "/root/testdata/sf0.001").collect() if r.doc_id == 7)
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == 7).first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_word_encoder_on_latin_words():
    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA0, 0x250), 0x301, 0x3A3, 0x130, 0x1E9E, 0x212A]]
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 9, 6000)]
    words += [a + b for a in ("'s", "'T", "ÉE", "x1", "İa") for b in letters]
    enc = encoder(vocabulary_path("word_bpe_49k.json"))
    lib = enc.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.ids(words)] == [x.ids for x in lib]
