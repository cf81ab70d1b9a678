"""Scores of words by shards: blocks, rare and split words, and what they write."""

import os
import random
from urllib.parse import urlparse

import numpy as np
import pytest
from test_filters import clean_texts, plain_model
from test_word_model import as_characters

from newsmill.llm import ngram_quality, word_shards
from newsmill.session import shared_dir


def test_blocks_keep_triples_texts_and_counts():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ab cd ef gh , . xyzzy plugh".split(), k=rng.randint(0, 40))) for _ in range(30)]
    names, flat = word_shards.words_of(texts)
    sp = word_shards.Spelling(np.concatenate([np.array([0, 1, 2], np.uint64), names[3:6]]), np.array([1, 1, 1, 3, 1, 2]), 4)
    codes, rare = sp.spell(names)
    u, v, w, text = word_shards._triples(flat)
    shard = sp.shard(names, codes, v, w)
    got = []
    for s, block in word_shards._blocks(codes[u], codes[v], codes[w], text, rare, shard, len(sp.words), True):
        more, bu, bv, bw, per, docs, counts = word_shards.unpacked(block)
        bu, bv, bw = (np.concatenate([sp.words, more])[x] for x in (bu, bv, bw))
        first = np.zeros(len(docs), bool)
        first[np.cumsum(per + 1) - per - 1] = True
        at = np.repeat(np.arange(len(bu)), per + 1)
        got += [(s, *map(int, x)) for x, n in zip(zip(bu[at], bv[at], bw[at], word_shards._from_starts(docs, first)), counts) for _ in range(n + 1)]
    assert sorted(got) == sorted((int(s), *map(int, x)) for s, *x in zip(shard, names[u], names[v], names[w], text))


@pytest.mark.parametrize("table, split", [(0, 10**9), (15, 40), (1 << 18, 40)])
def test_rare_and_split_words(spark, monkeypatch, table, split):
    """The spelling and the parts of a word change nothing."""
    for name, value in (("TABLE", table), ("SPLIT", split), ("LAYOUT_TEXTS", 1), ("LEAST_SHARDS", 7)):
        monkeypatch.setattr(word_shards, name, value)
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(80)]
    texts = [" ".join(rng.choices(words, [3 / (i + 1) for i in range(80)], k=rng.randint(1, 60))) for i in range(60)] + clean_texts(rng, 2) + [None, "", "unseen", "unseen words here", words[0]]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "id long, lang string, text string").repartition(3)
    got = {r.id: r.perplexity for r in ngram_quality.perplexities(docs, spark.range(40), 0, ngram_quality.WORDS).collect()}
    plain = as_characters(texts)
    _, perplexity = plain_model(plain[:40], ngram_quality.WORDS.order)
    assert got == {i: pytest.approx(perplexity(t)) if t else None for i, t in enumerate(plain)}


def test_what_the_query_writes_is_no_multiple_of_the_texts(spark):
    folder = urlparse(f"{shared_dir(spark)}/newsmill").path

    def files():
        return {p: os.path.getsize(p) for d, _, names in os.walk(folder) for p in (os.path.join(d, n) for n in names) if p.endswith(".parquet")}

    before = files()
    documents = "/root/testdata/sf0.01/documents.parquet"
    assert ngram_quality.query(spark, "/root/testdata/sf0.01").count() == spark.read.parquet(documents).count()
    written = sum(size for p, size in files().items() if p not in before)
    assert written < 1.5 * os.path.getsize(documents), written
