"""The registered quality query against a dictionary Kneser-Ney model of words."""

import random

import pytest
from pyspark.sql import functions as F
from test_filters import clean_texts, plain_model

from newsmill.llm import ngram_quality


def as_characters(texts):
    """A private character for every word, so that the character model of dictionaries is one of words."""
    names = {}
    return ["".join(names.setdefault(w, chr(0xE000 + len(names))) for w in ngram_quality.WORD.findall((t or "").lower())) for t in texts]


def test_words():
    assert ngram_quality.WORD.findall("don't stop, été 3D") == ["don", "'", "t", "stop", ",", "été", "3D"]
    assert ngram_quality.WORD.findall("新闻 ニュース") == [*"新闻", *"ニュース"]


def test_query_scores_words_by_joins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_quality, "score_with_broadcast", None)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 60))) + "." for _ in range(50)] + clean_texts(rng, 2) + [None, "", " \n", "新闻 new words"]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    held_out = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(ngram_quality.HELD_OUT)) == 0
    trained = [r.doc_id for r in labels.where(~held_out).collect()]
    got = {r.doc_id: r for r in ngram_quality.query(spark, str(tmp_path)).collect()}
    plain = as_characters(texts)
    _, perplexity = plain_model([plain[i] for i in trained], ngram_quality.WORDS.order)
    for i, t in enumerate(texts):
        assert got[i].n_chars == len(t or "")
        assert got[i].perplexity == (pytest.approx(perplexity(plain[i])) if plain[i] else None)
