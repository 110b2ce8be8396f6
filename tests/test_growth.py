"""What a task or a worker holds stays the same as inputs grow."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from jobs.settings import shipped
from quern import shared, shipping
from quern.operators import embedding
from quern.plans import fixtures


def most_rows(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    rows = 4000
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"id": range(rows), "text": [f"{i} {i * i}" * 20 for i in range(rows)]}), path, row_group_size=rows, compression="none")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "32k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= 4 and most_rows(df) == rows
        assert most_rows(shared.spread(df)) <= rows // 4 + 4
        monkeypatch.setattr(shared, "TASK_BYTES", 1 << 16)
        got = shared.spread(df)
        assert most_rows(got) < rows // 8 and got.exceptAll(df).isEmpty() and got.count() == rows
    finally:
        spark.conf.set(setting, before)


def test_input_in_small_parts_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "even")
    spark.range(400).repartition(8).write.parquet(path)
    setting = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64m")
    try:
        df = spark.read.parquet(path)
        assert shared.spread(df) is df
    finally:
        spark.conf.set(setting, before)


def test_first_occurrences_give_a_text_once_a_task_however_many_items_share_it(spark, monkeypatch):
    texts = ["b c", "c", "zz", "", None, "b c d"]
    items = spark.createDataFrame([(10 * r + i, t) for r in range(8) for i, t in enumerate(texts)], "item_id long, text string")
    documents = spark.createDataFrame([(None, "b c"), (9, "c"), (7, "a b c"), (3, None), (4, "a b c d"), (8, "b c d"), (6, "")], "doc_id long, text string")
    want = {(10 * r + i, 4) for r in range(8) for i in (0, 1, 5)}
    made = []
    own = type(documents).mapInArrow
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, *a: made.append(own(self, *a)) or made[-1])
    for block in (4096, 2, 1):
        assert {tuple(r) for r in fixtures.first_occurrences(documents.coalesce(1), items, block).collect()} == want
    assert made[0].count() == 3
    again = items.union(spark.createDataFrame([(0, "c"), (0, "a b")], items.schema))
    assert {tuple(r) for r in fixtures.first_occurrences(documents, again).collect()} == want


def test_batches_for_python_are_bounded_in_bytes_and_jobs_restore_that(spark):
    before = {name: spark.conf.get(name) for name, *_ in shipping.SMALL}
    try:
        for name, default, _ in shipping.SMALL:
            spark.conf.set(name, default)
        with shipped(spark):
            size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
            rows = spark.range(400, numPartitions=1).select(size(F.concat(F.repeat(F.lit("x"), 100_000), "id")).alias("n"))
            assert rows.agg(F.max("n")).first()[0] <= 90
        assert {name: spark.conf.get(name) for name in before} == {name: default for name, default, _ in shipping.SMALL}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_an_embedder_remembers_so_many_words(monkeypatch):
    texts = [" ".join(f"w{i % 7} v{i}{j}" for j in range(9)) for i in range(50)]
    want = embedding.HashEmbedder()(texts)
    monkeypatch.setattr(embedding, "REMEMBERED", 20)
    few = embedding.HashEmbedder()
    assert (few(texts) == want).all() and len(few.memory) == 20


ODD_PAGES = [
    (1, "b", "One", "Sec", "One\nSec\n a  b\tc　d   e\u001cf​ g­\r\n\r\n\r\nh ﻿   i"),
    (2, None, "c", None, " ".join(f"w{i % 37}" for i in range(1, 200))),
    (3, "b", "c", "s", "é é o‌p\n\n\n\n\x0b\x0c\x85q  r"),
    (4, "b", "c", "s", "c"),
    (5, "b", "c", "s", " \n "),
    (6, "b", "c", "s", None),
]


def prepared_windows(spark, size, overlap):
    from quern.operators import chunking
    from quern.sources import index

    pages = spark.createDataFrame([(*r[:4], "u", r[4]) for r in ODD_PAGES], "page_no long, book string, chapter string, section string, source_url string, text string")
    return index.windows(chunking.prepared(pages), size, overlap), index.vectors(chunking.nonempty(chunking.chunk_pages(pages, size, overlap)))


def test_windows_of_prepared_pages_are_those_of_their_texts(spark):
    for size, overlap in ((3, 1), (50, 10), (1000, 0)):
        got, want = prepared_windows(spark, size, overlap)
        assert got.columns == want.columns and got.count() == want.count() > 2
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert [r["text"] for r in got.where("page_no IN (1, 3)").orderBy("page_no").collect()] == ["a b c d e f g h i", "é é o‌p q r"]


def test_a_window_is_handed_to_python_without_its_page(spark):
    for df in prepared_windows(spark, 50, 10):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        below = [line for line in lines[next(i for i, line in enumerate(lines) if "Generate posexplode" in line) :]]
        kept = below[0].rsplit("[", 2)[-2]
        assert "page_no" in kept and "words_" not in kept and "buckets" not in kept
