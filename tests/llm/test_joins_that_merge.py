"""Tables that grow with the input are not sent through the driver: near-dedup's joins merge, however small Spark takes a side to be."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsmill.llm import linking, simhash
from newsmill.operators import components


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written on the way."""
    found = []

    def noted(write):
        def run(df, name):
            found.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return write(df, name)

        return run

    for module in (linking, simhash, components, corpus_pipeline):
        monkeypatch.setattr(module, "materialize", noted(module.materialize))
    return found


def test_near_dedup_broadcasts_nothing(spark, plans):
    words = [" ".join(f"w{(i - i % 3) * 31 + k}" for k in range(40)) + " x" * (i % 3 == 1) for i in range(60)]
    docs = spark.createDataFrame([(i, w, "en", "s", len(w)) for i, w in enumerate(words)], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    plans.append(("kept", kept._jdf.queryExecution().executedPlan().toString()))
    assert {r.doc_id for r in kept.collect()} >= set(range(0, 60, 3)) and kept.count() < 60
    assert {"bucket-sizes", "edges", "low", "below", "fingerprint-components", "keepers"} <= {n for n, _ in plans}
    assert [n for n, p in plans if "Broadcast" in p] == []


def test_exploded_keys_are_not_broadcast(spark):
    """An exploded table counts as no larger than what it was exploded from: fifteen keys a row went to the driver."""
    keys = spark.range(50).select(F.explode(F.array(*[F.pmod("id", F.lit(k)) for k in range(2, 17)])).alias("bucket"), F.col("id").alias("member"))
    groups = linking.candidate_groups(keys)
    assert "Broadcast" not in groups._jdf.queryExecution().executedPlan().toString()
    assert groups.select("bucket", "member").distinct().count() > 50
