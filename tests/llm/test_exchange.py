"""Packed exchanges whose partitions hold several buckets give what a partition for each bucket gives."""

import random

import numpy as np
import pandas as pd
import pytest

from learntrail.llm import common, embeddings, minhash, substring

DOCS = "doc_id long, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows = []
    for k in range(40):
        own = words(60)
        rows += [(3 * k, " ".join(own)), (3 * k + 1, " ".join([*own[:-2], "x", "y"])), (3 * k + 2, " ".join([*words(30), *own[:20], *words(30)]))]
    return spark.createDataFrame([*rows, (500, None), (501, "")], DOCS)


@pytest.mark.parametrize("run", [lambda d: minhash.near_duplicates(d), lambda d: substring.remove_repeats(d)])
def test_documents(docs, monkeypatch, run):
    alone = rows_of(run(docs))
    monkeypatch.setattr(common, "REDUCERS", 5)
    assert rows_of(run(docs)) == alone


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = [(k, (base[k % 30] + 0.02 * rng.normal(size=16)).tolist(), 1) for k in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    alone = rows_of(embeddings.near_vectors(vectors))
    assert any(r[1] for r in alone)
    monkeypatch.setattr(common, "REDUCERS", 5)
    assert rows_of(embeddings.near_vectors(vectors)) == alone


def test_a_partition_holds_whole_buckets_in_runs(spark, monkeypatch):
    records = spark.range(1000).selectExpr("id % 37 AS bucket", "id")
    count = lambda batches: (pd.DataFrame({"bucket": [g.bucket.iloc[0]], "kinds": [g.bucket.nunique()], "n": [len(g)]}) for g in common.bucket_groups(batches))
    for most in (37, 5, 1):
        monkeypatch.setattr(common, "REDUCERS", most)
        spread = common.exchanged(records, 37)
        assert spread.rdd.getNumPartitions() == most
        found = spread.mapInPandas(count, "bucket long, kinds long, n long").collect()
        assert sorted(map(tuple, found)) == [(b, 1, 28 if b == 0 else 27) for b in range(37)]
    assert list(common.bucket_groups(iter([records.limit(0).toPandas()]))) == []
