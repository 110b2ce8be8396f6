"""The pruned search against the search of everything, what it skips, and odd indexes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import pruning, retrieval

PLACE = ("a", "b")


def frame(spark, x, ids=None):
    rows = [(int(i) // 7, int(i) % 7, [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "a long, b long, embedding array<double>").repartition(5)


def asked(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "query_id long, embedding array<double>")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["a"], r["b"], round(r["score"], 6)) for r in df.collect())


def grouped(n=4000, groups=25, width=16, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, width))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_equal_to_the_whole_search_and_meets_under_half_on_grouped_vectors(spark, tmp_path):
    x = grouped()
    rows, questions = frame(spark, x), asked(spark, x[::50] + 0.001)
    index = pruning.build(spark, rows, PLACE, f"file://{tmp_path}/index")
    assert index.counts.sum() == len(x) and len(index.clusters) <= 63
    got, reach = pruning.search(questions, index, 10)
    assert hits(got) == hits(retrieval.nearest(questions, rows, 10, PLACE))
    told = reach.collect()
    assert len(told) == 80
    share = sum(r["vectors"] for r in told) / (len(told) * len(x))
    print(f"share of vectors that bounds could not rule out: {share:.3f}")
    assert share < 0.5


def test_folders_out_of_reach_are_not_read(spark, tmp_path, monkeypatch):
    x = grouped()
    index = pruning.build(spark, frame(spark, x), PLACE, f"file://{tmp_path}/index")
    reads = []
    plain = pruning._candidates
    monkeypatch.setattr(pruning, "_candidates", lambda held, index, needed, k: reads.append(index.counts[needed].sum()) or plain(held, index, needed, k))
    got, _ = pruning.search(asked(spark, x[:1]), index, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert reads[-1] < len(x) / 2 and "PartitionFilters: [" in plan and "cluster" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("gate", [0.0, 0.01, 0.5, 4.0])
def test_the_gate_bounds_the_search(spark, tmp_path, gate):
    x = grouped(1500, 10)
    rows, questions = frame(spark, x), asked(spark, np.vstack([x[::90], -x[:3]]))
    index = pruning.build(spark, rows, PLACE, f"file://{tmp_path}/index")
    got, reach = pruning.search(questions, index, 7, gate)
    assert hits(got) == hits(retrieval.nearest(questions, rows, 7, PLACE, gate))
    if gate <= 0.01:
        assert sum(r["vectors"] for r in reach.collect()) < 0.5 * len(x) * 20


@pytest.mark.parametrize("kind", ["no groups", "one vector", "ties", "few", "long", "line"])
def test_odd_indexes_give_the_same(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    x = {
        "no groups": rng.normal(size=(600, 8)),
        "one vector": np.ones((400, 4)),
        "ties": rng.integers(-1, 2, size=(800, 3)).astype(float),
        "few": rng.normal(size=(3, 5)),
        "long": np.vstack([1e6 * rng.normal(size=(50, 4)), rng.normal(size=(300, 4)), np.zeros((5, 4))]),
        "line": np.arange(500.0)[:, None],
    }[kind]
    rows, questions = frame(spark, x), asked(spark, np.vstack([x[:: max(1, len(x) // 12)], x[:2] * 0.5]))
    index = pruning.build(spark, rows, PLACE, f"file://{tmp_path}/index")
    got, want = hits(pruning.search(questions, index, 9)[0]), hits(retrieval.nearest(questions, rows, 9, PLACE))
    if kind == "long":  # where sums of doubles differ in what is shown
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[4] for r in got], [r[4] for r in want], rtol=1e-9, atol=1e-3)
    else:
        assert got == want


def test_more_questions_than_a_block(spark, tmp_path, monkeypatch):
    x = grouped(700, 6)
    rows, questions = frame(spark, x), asked(spark, x[::7])
    index = pruning.build(spark, rows, PLACE, f"file://{tmp_path}/index")
    monkeypatch.setattr(pruning, "BLOCK", 16)
    got, reach = pruning.search(questions, index, 3)
    assert hits(got) == hits(retrieval.nearest(questions, rows, 3, PLACE)) and reach.count() == 100


def test_nothing_to_ask_or_to_find(spark, tmp_path):
    x = grouped(50, 3)
    index = pruning.build(spark, frame(spark, x), PLACE, f"file://{tmp_path}/index")
    assert pruning.search(asked(spark, x[:0]), index, 3)[0].collect() == []
    empty = pruning.build(spark, frame(spark, x[:0]), PLACE, f"file://{tmp_path}/empty")
    got, reach = pruning.search(asked(spark, x[:2]), empty, 3)
    assert got.collect() == [] and reach.collect() == []
    nulls = spark.createDataFrame([(1, 1, None), (1, 2, [1.0, 0.0])], "a long, b long, embedding array<double>")
    one = pruning.build(spark, nulls, PLACE, f"file://{tmp_path}/nulls")
    assert hits(pruning.search(asked(spark, [[0.0, 1.0]]), one, 3)[0]) == [(0, 1, 1, 2, 2.0)]


def test_the_index_is_the_same_after_loading_and_rebuilding(spark, tmp_path):
    x = grouped(900, 9)
    path = f"file://{tmp_path}/index"
    first = pruning.build(spark, frame(spark, x), PLACE, path)
    again = pruning.build(spark, frame(spark, x).repartition(2), PLACE, path, clusters=len(first.clusters))
    loaded = pruning.load(spark, path, PLACE)
    assert np.array_equal(loaded.counts, again.counts) and np.allclose(loaded.centroids, again.centroids)
    assert loaded.vectors.groupBy("cluster").agg(F.max("away").alias("m")).count() == len(loaded.clusters)
