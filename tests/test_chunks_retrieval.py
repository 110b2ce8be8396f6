import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.config import NO_ANSWER, Settings
from quern.operators import answering, chunking, citations, embedding, evaluation, retrieval
from quern.sources import index as store


def starts(n, size, overlap):
    out, at = [], 0
    while at < n:
        out.append(at)
        if at + size >= n:
            break
        at += size - overlap
    return out


def pages(spark, texts):
    rows = [(k + 1, None if k % 2 else "book", f"c{k}", None, "u", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_no long, book string, chapter string, section string, source_url string, text string")


@pytest.mark.parametrize(("size", "overlap"), [(5, 2), (1, 0), (7, 6), (500, 100)])
def test_window_starts(spark, size, overlap):
    got = spark.range(0, 40).select("id", chunking.window_starts(F.col("id"), size, overlap).alias("s")).collect()
    assert all(r["s"] == starts(r["id"], size, overlap) for r in got)


@given(st.integers(1, 300), st.integers(1, 40), st.integers(0, 39))
def test_windows_overlap_and_cover(n, size, overlap):
    overlap = min(overlap, size - 1)
    at = starts(n, size, overlap)
    assert at[0] == 0 and at[-1] + size >= n and all(b - a == size - overlap for a, b in zip(at, at[1:], strict=False))


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (5, -1), (5, 5), (-1, 0)])
def test_bad_windows(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.windows(pages(spark, ["a"]), size, overlap)


def test_chunks(spark):
    words = " ".join(f"w{k}" for k in range(12))
    got = chunking.chunk_pages(pages(spark, ["c0\n" + words, " ", "x"]), 5, 2).orderBy("page_no", "chunk_no").collect()
    assert [(r["page_no"], r["chunk_id"]) for r in got] == [(1, "01-001"), (1, "01-002"), (1, "01-003"), (1, "01-004"), (3, "03-001")]
    assert got[1]["text"] == "w3 w4 w5 w6 w7" and got[3]["text"] == "w9 w10 w11"
    assert got[0]["book"] == "book" and got[0]["section"] == ""
    assert pages(spark, ["a"]).select(chunking.chunk_id(F.lit(123), F.lit(1000)).alias("x")).first()["x"] == "123-1000"


def indexed(spark, texts):
    return store.vectors(chunking.chunk_pages(pages(spark, texts), 6, 2))


def asked(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, question string")
    return rows.withColumn("embedding", embedding.questions(F.col("question")))


TEXTS = ["red fox runs far away now", "red fox sleeps", "blue whale swims deep", "blue whale swims deep", "nothing alike here"]


def test_hits(spark):
    got = retrieval.retrieve(asked(spark, ["blue whale", "red fox", "  "]), indexed(spark, TEXTS), 3, 1.0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["page_no"]) for r in got] == [(0, 1, 3), (0, 2, 4), (0, 3, 1), (1, 1, 2), (1, 2, 1), (1, 3, 3)]
    assert got[0]["passes_threshold"] and not got[2]["passes_threshold"] and got[2]["score"] == 2.0
    assert got[0]["score_metric"] == "l2_distance" and got[0]["higher_is_better"] is False
    passing = retrieval.retrieve(asked(spark, ["blue whale"]), indexed(spark, TEXTS), 3, 1.0, only_passing=True)
    assert [r["page_no"] for r in passing.orderBy("rank").collect()] == [3, 4]
    assert retrieval.retrieve(asked(spark, ["blue"]), indexed(spark, ["a"]), 5).count() == 1


def by_expressions(questions, index, k):
    """The same ranking with built-in expressions alone, over all pairs of a small table."""
    difference = F.aggregate(F.zip_with("embedding", "other", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = index.crossJoin(questions.select("query_id", F.col("embedding").alias("other")))
    scored = pairs.select("query_id", *retrieval.PLACE, F.round(difference, retrieval.DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", *retrieval.PLACE)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def test_product_agrees_with_expressions(spark, monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"v{w}" for w in rng.integers(0, 30, 8)) for _ in range(60)]
    index, questions = indexed(spark, texts).cache(), asked(spark, texts[:9]).cache()
    want = sorted(map(tuple, by_expressions(questions, index, 4).select("query_id", "rank", "page_no", "chunk_no").collect()))
    for block in (4096, 4):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        got = retrieval.nearest(questions, index, 4, retrieval.PLACE).select("query_id", "rank", "page_no", "chunk_no")
        assert sorted(map(tuple, got.collect())) == want


def test_gate_is_inclusive_and_cosine_is_held(spark):
    row = spark.range(1).select(retrieval.passes(F.lit(0.4), 0.4), retrieval.passes(F.lit(0.4000001), 0.4), retrieval.cosine_from_score(F.lit(3.0)), retrieval.cosine_from_score(F.lit(0.0))).first()
    assert tuple(row) == (True, False, -1.0, 1.0)


HITS = "query_id long, rank long, score double, passes_threshold boolean, book string, chapter string, section string, source_url string, text string, chunk_id string"


def test_answers(spark):
    hits = spark.createDataFrame(
        [(1, 1, 0.1, True, "b", "c", "s", "u", "one two", "x"), (1, 2, 0.2, True, "b", "c", "t", "u", "three", "y"), (1, 3, 0.3, True, "b", "", "", "", "four", "z"), (1, 4, 0.35, True, "b", "d", "", "v", "five", "w"), (2, 1, 0.9, False, "b", "c", "", "u", "six", "x")], HITS
    )
    questions = spark.createDataFrame([(1, " q? "), (2, "r"), (3, "")], "query_id long, question string")
    got = {r["query_id"]: r for r in answering.answers(questions, hits).collect()}
    assert got[1]["found"] and got[1]["answer"] == "one two"
    assert [tuple(s) for s in got[1]["sources"]] == [("b", "c", "s", "u"), ("b", "", "", "")]
    assert (got[2]["answer"], got[2]["found"], got[2]["sources"]) == (NO_ANSWER, False, [])
    assert got[3]["answer"] == NO_ANSWER
    prompt = answering.prompts(answering.contexts(hits), questions).first()["prompt"]
    assert prompt.startswith(answering.INTRO + "\n[1] অধ্যায়: c / s\nউৎস: u\nপাঠ্য:\none two\n\n[2]") and "q?" in prompt and "[4]" not in prompt
    assert answering.contexts(hits, 0).count() == 1
    silent = {r["query_id"]: r for r in answering.answers(questions, hits, 3, lambda: lambda p: f"x {NO_ANSWER}").collect()}
    assert not silent[1]["found"] and silent[1]["sources"] == []


def test_citations(spark):
    rows = spark.createDataFrame([("b", "c", " ", "u"), (None, "", "", ""), ("", "", "s", None)], "book string, chapter string, section string, url string")
    got = [r[0] for r in rows.select(citations.format_citation(*(F.col(c) for c in rows.columns))).collect()]
    assert got == ["b, c — u", citations.UNNAMED, "s"]
    assert spark.createDataFrame([("", "m"), ("t", "m"), (None, None)], "t string, m string").select(citations.merged(F.col("t"), F.col("m"))).toPandas().iloc[:, 0].tolist() == ["m", "t", ""]


def test_evaluation(spark):
    questions = spark.createDataFrame([(1, " Answerable", "é"), (2, "answerable", "x"), (3, "unanswerable", None), (4, "other", "x"), (5, "unanswerable", None)], "query_id long, type string, expected_chapter string")
    hits = spark.createDataFrame([(1, 1, 0.5, False, "b", "z", "", "", "", ""), (1, 2, 0.6, False, "b", "é ", "", "", "", ""), (2, 1, 0.1, True, "b", "y", "", "", "", ""), (3, 1, 0.1, True, "b", "y", "", "", "", "")], HITS)
    rows = evaluation.eval_rows(questions, hits)
    got = {r["query_id"]: (r["hit"], r["passes_threshold"], r["best_score"]) for r in rows.collect()}
    assert got == {1: (True, False, 0.5), 2: (False, True, 0.1), 3: (None, True, 0.1), 4: (None, False, None), 5: (None, False, None)}
    s = evaluation.eval_summary(rows).first()
    assert (s["answerable"], s["hits"], s["hit_rate"], s["threshold_passes"], s["unanswerable"], s["unanswerable_gated"]) == (2, 1, 0.5, 1, 2, 1)
    assert evaluation.eval_summary(rows.where("type = 'other'")).first()["hit_rate"] is None
    lines = {r["query_id"]: r["line"] for r in evaluation.report(rows).collect()}
    assert lines[1] == "[answerable] best 0.5000 gate FAIL chapter HIT" and lines[5] == "[unanswerable] best n/a gate FAIL chapter -"
    order = evaluation.compare({"A": (rows.where("type = 'other'"), hits), "B": (rows, hits)}).collect()
    assert [(r["id"], r["hit_rate"]) for r in order] == [("B", 0.5), ("A", None)]


@pytest.mark.parametrize("gate", [None, 0.6])
def test_a_task_holds_a_tile_of_scores_and_gives_k_rows_a_question(spark, gate):
    """However many questions and batches: full scores of these would take four times 48 MB, and each batch gave k rows a question."""
    rng = np.random.default_rng(3)
    asked, k = 3000, 5
    questions = rng.integers(-2, 3, (asked, 3)).astype(float)
    block = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(questions)], "query_id long, embedding array<double>")
    vectors = rng.integers(-2, 3, (4007, 3)).astype(float)
    place = rng.permutation(len(vectors))
    columns = [pa.array(place // 10), pa.array(place % 10), pa.array(vectors.tolist(), pa.list_(pa.float64()))]
    batches = pa.table(columns, names=["page_no", "chunk_no", "embedding"]).to_batches(max_chunksize=2000)
    run, _ = retrieval._search(block, k, retrieval.PLACE, gate)
    tracemalloc.start()
    out = list(run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and sum(b.num_rows for b in out) <= asked * k
    got = sorted(zip(*(c.to_pylist() for c in pa.Table.from_batches(out).select(["query_id", "score", "page_no", "chunk_no"]).columns), strict=True))
    want = []
    for q in range(asked):
        score = ((vectors - questions[q]) ** 2).sum(1)
        near = np.lexsort((place, score))[:k]
        want += [(q, score[j], place[j] // 10, place[j] % 10) for j in near if gate is None or score[j] <= gate]
    assert got == sorted(want)


def test_reported_numbers_are_rounded_as_printf_does(spark):
    numbers = [round(i * 1e-6, 6) for i in range(0, 1_300_000, 1237)] + [0.61515, 0.00005, 0.00004, 0.000049, 0.12345, 1.00005, 0.0, 2.0]
    rows = spark.createDataFrame([(i, "unanswerable", s, True, None) for i, s in enumerate(numbers)], "query_id long, type string, best_score double, passes_threshold boolean, hit boolean")
    got = {r["query_id"]: r["line"] for r in evaluation.report(rows).collect()}
    assert got == {i: f"[unanswerable] best {s:.4f} gate PASS chapter -" for i, s in enumerate(numbers)}
    rates = [h / a for a in (7, 16, 800, 20_000) for h in range(0, a + 1, 1 + a // 900)] + [0.00005]
    shown = spark.createDataFrame([(r,) for r in rates] + [(None,)], "rate double").select(evaluation.percent(F.col("rate"))).toPandas().iloc[:, 0].tolist()
    assert shown == [f"{r * 100:.2f}%" for r in rates] + ["n/a"]


def test_settings():
    assert Settings.load({}) == Settings()
    got = Settings.load({"TOP_K": " 7 ", "BOOK_TITLE": " ", "RETRIEVAL_THRESHOLD": "0.5"})
    assert (got.top_k, got.book_title, got.retrieval_threshold) == (7, Settings().book_title, 0.5)
    with pytest.raises(ValueError):
        Settings.load({"TOP_K": "many"})


def test_errors_models_and_content(spark):
    try:
        try:
            raise OSError("Connection refused")
        except OSError as e:
            raise ConnectionError("no answer") from e
    except ConnectionError as e:
        text = answering.error_text(e)
    assert text == "no answer connection refused"
    assert spark.range(1).select(answering.error_class(F.lit(text))).first()[0] == "server_down"
    assert answering.is_installed(["m:latest"], " m ") and not answering.is_installed(["m:1"], "m") and answering.is_installed(["m:1"], "m:1")
    assert answering.content_text([" a", {"text": "b"}, {"x": 1}, 3]) == "ab" and answering.content_text(" c ") == "c"
