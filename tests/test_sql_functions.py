"""Functions in SQL text against the library's own, and their plans."""

import pytest
from pyspark.sql import functions as F

from quern.functions import sql
from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import chunking, discovery, retrieval

TEXTS = [None, "", " \t\n", "one", " a b　c \x1cd e ", "query: x", "  passage: y ", "कथा का", " ".join(f"w{k}" for k in range(57)), "a'b\\c \"d\""]


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    sql.register(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "page_no long, text string")


@pytest.mark.parametrize(("size", "overlap"), [(1, 0), (4, 1), (5, 4), (57, 3), (500, 100)])
def test_windows_are_those_of_the_library(spark, rows, size, overlap):
    pages = rows.select("*", *[F.lit("x").alias(c) for c in ("book", "chapter", "section", "source_url")])
    want = sorted(map(tuple, chunking.windows(pages, size, overlap).select("page_no", "chunk_no", "start_word", "text").collect()))
    lateral = spark.sql(f"SELECT page_no, w.* FROM (SELECT page_no, word_windows(text, {size}, {overlap}) AS ws FROM {{rows}}) LATERAL VIEW OUTER inline(ws) w WHERE chunk_no IS NOT NULL", rows=rows)
    whole = spark.sql(f"SELECT page_no, chunk_no, start_word, text FROM chunk_words(TABLE({{rows}}), {size}, {overlap})", rows=rows)
    assert sorted(map(tuple, lateral.collect())) == sorted(map(tuple, whole.collect())) == want
    plan = lateral._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Exchange" not in plan
    assert plan.count("split(") == 1  # words are cut once a text


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (3, 3), (3, -1)])
def test_windows_that_make_no_sense_are_errors(spark, rows, size, overlap):
    for query in (f"SELECT word_windows(text, {size}, {overlap}) FROM {{rows}}", f"SELECT * FROM chunk_words(TABLE({{rows}}), {size}, {overlap})"):
        with pytest.raises(Exception, match="window|overlap"):
            spark.sql(query, rows=rows).collect()


def test_scalars_are_those_of_the_library(spark, rows):
    got = spark.sql(
        """SELECT text_words(text) AS words, e5_prefix(text, 'passage: ') AS prefixed, nfc(coalesce(text, '') || 'é') AS normal, chunk_id(page_no + 98, page_no) AS id,
        l2_to_cosine(page_no / 3.0D) AS cosine, passes_threshold(page_no / 10.0D, 0.4D) AS passes FROM {rows} ORDER BY page_no""",
        rows=rows,
    ).collect()
    want = rows.orderBy("page_no").select(
        T.words(F.col("text")).alias("words"), T.with_prefix(F.col("text"), "passage: ").alias("prefixed"), T.nfc(F.concat(F.coalesce("text", F.lit("")), F.lit("é"))).alias("normal"),
        chunking.chunk_id(F.col("page_no") + 98, F.col("page_no")).alias("id"), retrieval.cosine_from_score(F.col("page_no") / 3.0).alias("cosine"),
        retrieval.passes(F.col("page_no") / 10.0, 0.4).alias("passes"),
    ).collect()
    assert got == want


def test_addresses_and_pages(spark):
    sql.register(spark)
    urls = ["https://www.h.org/wiki/A_b%20c?x=1#f", "HTTPS://H.org:80/w/index.php?title=T", "http://other/x", None, "//h.org/wiki/%E0%A6%B0"]
    html = '<div id="mw-content-text">a <a href="/wiki/B">b</a><a href="/wiki/C">c</a></div>'
    rows = spark.createDataFrame([(k, u, html if k % 2 else None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = spark.sql("SELECT title_from_url(url) AS title, canonical_url(url, 'http://b/') AS canonical, host_allowed(url, 'http://h.org/') AS allowed, extract_text(html) AS text FROM {rows} ORDER BY page_id", rows=rows)
    from quern.functions import html as H

    want = rows.orderBy("page_id").select(U.title_from_url(F.col("url")).alias("title"), U.canonical_url(F.col("url"), F.lit("http://b/")).alias("canonical"), U.host_allowed(F.col("url"), F.lit("http://h.org/")).alias("allowed"), H.extract_text(F.col("html")).alias("text"))
    assert got.collect() == want.collect()
    links = spark.sql("SELECT * FROM page_links(TABLE(SELECT page_id, url, html FROM {rows}))", rows=rows)
    assert sorted(map(str, links.collect())) == sorted(map(str, discovery.page_links(rows).select(*links.columns).collect())) and links.count() == 4
    with pytest.raises(Exception, match="page_links takes"):
        spark.sql("SELECT * FROM page_links(TABLE(SELECT url FROM {rows}))", rows=rows).collect()
