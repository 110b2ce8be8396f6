"""Bands of hyperplanes: recall against the exact search on the given tables and on grouped vectors, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import lsh, retrieval

PLACE = ("vec_id",)


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def asked(rows, every=50):
    return rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, tmp_path, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    buckets = lsh.build(spark, rows, PLACE, f"file://{tmp_path}/buckets")
    n = rows.count()
    assert {r["band"]: r["count"] for r in buckets.tables.groupBy("band").count().collect()} == dict.fromkeys(range(lsh.BANDS), n)
    questions = asked(rows)
    exact = retrieval.nearest(questions, rows, 10, PLACE)
    found = lsh.search(questions, buckets, 10)
    told = lsh.recall(found, exact, PLACE).first()
    print(sf, told, lsh.reached(questions, buckets))
    assert told["hits"] == 10 * questions.count() and told["recall"] >= 0.9
    # What is found has its true score.
    true = {(r["query_id"], r["vec_id"]): r["score"] for r in exact.collect()}
    assert all(abs(true[r["query_id"], r["vec_id"]] - r["score"]) < 1e-6 for r in found.collect() if (r["query_id"], r["vec_id"]) in true)


def test_grouped_vectors_are_found_with_few_probes(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 32))
    rows = frame(spark, x)
    buckets = lsh.build(spark, rows, PLACE, f"file://{tmp_path}/buckets")
    questions = asked(rows, 30)
    exact = retrieval.nearest(questions, rows, 10, PLACE)
    assert lsh.recall(lsh.search(questions, buckets, 10, 4), exact, PLACE).first()["recall"] >= 0.9
    assert lsh.reached(questions, buckets, 4) < lsh.BANDS * 0.15


def test_all_buckets_are_the_exact_search(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(2).integers(-2, 3, size=(300, 6))
    rows = frame(spark, x)
    buckets = lsh.build(spark, rows, PLACE, f"file://{tmp_path}/buckets", bands=2, bits=3)
    questions = asked(rows, 11)
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    exact = key(retrieval.nearest(questions, rows, 7, PLACE))
    assert key(lsh.search(questions, buckets, 7, 8)) == exact
    monkeypatch.setattr(lsh, "BLOCK", 8)
    assert key(lsh.search(questions, buckets, 7, 8)) == exact


def test_probes_begin_with_the_own_bucket_and_differ():
    rng = np.random.default_rng(7)
    x, planes = rng.normal(size=(20, 9)), rng.normal(size=(3, 5, 9))
    looked = lsh.probed(x, planes, 12)
    assert np.array_equal(looked[:, :, 0], lsh.codes(x, planes))
    assert all(len(set(c)) == 12 for q in looked.tolist() for c in q)


def test_a_vector_that_stands_many_times(spark, tmp_path):
    x = np.vstack([np.tile([1.0, 2.0, 3.0], (2000, 1)), np.random.default_rng(0).normal(size=(100, 3))])
    rows = frame(spark, x)
    buckets = lsh.build(spark, rows, PLACE, f"file://{tmp_path}/buckets", bands=2, bits=2)
    got = lsh.search(asked(rows, 1000).where("query_id < 2000"), buckets, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(q, r + 1, r) for q in (0, 1000) for r in range(3)]


def test_nothing_to_find(spark, tmp_path):
    none = frame(spark, np.zeros((1, 3))).where("vec_id > 5")
    buckets = lsh.build(spark, none, PLACE, f"file://{tmp_path}/none")
    assert lsh.search(asked(none), buckets, 3).collect() == []
    nulls = spark.createDataFrame([(0, None), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    buckets = lsh.build(spark, nulls.where("vec_id = 1"), PLACE, f"file://{tmp_path}/one")
    assert [r["vec_id"] for r in lsh.search(asked(nulls, 1), buckets, 3).collect()] == [1]
    assert lsh.recall(none.withColumn("query_id", F.lit(1)), none.withColumn("query_id", F.lit(1)), PLACE).first()["recall"] is None
    with pytest.raises(ValueError):
        lsh.build(spark, nulls, PLACE, f"file://{tmp_path}/x", bits=0)
