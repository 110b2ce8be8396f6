import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, discovery
from quern.sources import index as store
from quern.sources import landing, tables
from quern.streaming import answers


def titles(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "title string")


@pytest.mark.parametrize(
    ("names", "root"),
    [
        (["T/a"], "T"), (["T"], "T"), (["T (1)", "T (1)/a", "T (2)", "T (2)/a", "T (2)/b", "U", "U/a", "U/b", "U/c"], "T (2)"), (["U", "V", "V/a"], "V"), (["UU", "V"], "V"), (["b", "a"], "a"), ([], "T"), (["x/y"], "T"),
    ],
)
def test_choose_root(spark, names, root):
    assert [r["root"] for r in discovery.choose_root(titles(spark, *names), "T").collect()] == [root]


def test_ordered_union(spark):
    a = spark.createDataFrame([(2, "x"), (1, "y"), (3, "x")], "p long, k string")
    b = spark.createDataFrame([(0, "z"), (1, "y")], "p long, k string")
    got = discovery.ordered_union([a, b], "k", "p").orderBy("source_no", "p").collect()
    assert [(r["source_no"], r["p"], r["k"]) for r in got] == [(0, 1, "y"), (0, 2, "x"), (1, 0, "z")]


def test_table_of_contents(spark):
    html = '<div id="mw-content-text">' + "".join(f'<a href="{h}">x</a>' for h in ("/wiki/R/b", "/wiki/R", "/wiki/R/a#f", "/wiki/R/b", "https://o.org/wiki/R/z", "/wiki/Talk:R", "/wiki/X", "/wiki/R/c?action=edit")) + "</div><a href='/wiki/R/out'>y</a>"
    pages = spark.createDataFrame([(1, "https://h.org/wiki/R", html)], "page_id long, url string, html string")
    links = discovery.page_links(pages, (("#mw-content-text",),)).withColumn("root", F.lit("R"))
    found, skipped = discovery.toc_titles(discovery.judge_links(links))
    assert [r["title"] for r in found.orderBy("link_no").collect()] == ["R/b", "R/a"]
    assert skipped.first()["skipped"] == 4


def test_outcomes_and_records(spark):
    rows = [(1, "u1", None, False, None, ""), (2, "u2", 404, False, "R/a", "t"), (3, "u3", 200, True, "R/a", "t"), (4, "u4", 200, False, "X", "t"), (5, "u5", 200, False, "R/a", ""), (6, "u6", 200, False, "R/a/b", "কথা"), (7, "u7", 200, False, None, "t")]
    pages = spark.createDataFrame([(*r, "R") for r in rows], "page_no long, url string, status int, missing boolean, title string, text string, root string")
    got = discovery.outcomes(pages)
    assert [r["outcome"] for r in got.orderBy("page_no").collect()] == ["fetch failed", "http error", "missing", "outside", "empty", "page", "outside"]
    kept = discovery.records(got, "book")
    assert [(r["chapter"], r["section"], r["char_count"]) for r in kept.collect()] == [("a", "b", 3)]
    assert tuple(discovery.summary(kept).first()) == (1, 3, "a", "a")


def test_listings(spark):
    html = "<ul class='mw-prefixindex-list'><li><a href='/wiki/B'>b</a><li><a href='/wiki/Page:1'>p</a><li><a href='/wiki/A'>a</a><li><a href='/wiki/B'>b</a></ul><a class='mw-nextlink' href='?from=C'>next</a>"
    rows = spark.createDataFrame([(0, "https://h/w/index.php", html), (1, "https://h/w/index.php", html.replace("wiki/A", "wiki/C"))], "listing_no long, url string, html string")
    got = discovery.listed_titles(rows).orderBy("listing_no", "link_no").collect()
    assert [r["title"] for r in got] == ["B", "A", "C"]
    assert landing.next_link(html, "https://h/w/index.php?x=1") == "https://h/w/index.php?from=C"


def test_json_sources(spark, tmp_path):
    rows = [{"book": "b", "chapter": "c", "text": "কথা", "char_count": 3}, {"book": "d"}]
    (tmp_path / "pages.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2))
    got = tables.read_pages(spark, str(tmp_path / "pages.json")).collect()
    assert [(r["position"], r["book"], r["text"]) for r in got] == [(0, "b", "কথা"), (1, "d", None)]
    (tmp_path / "q.json").write_text(json.dumps({"no_answer": "x", "questions": [{"question": "q", "expected_chapter": None, "type": "answerable"}]}))
    (tmp_path / "bare.json").write_text(json.dumps([{"question": "q", "type": "unanswerable"}]))
    assert [tables.read_questions(spark, str(tmp_path / f))[["question"]].count() for f in ("q.json", "bare.json")] == [1, 1]
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        tables.read_pages(spark, str(tmp_path / "none.json"))
    with pytest.raises(FileNotFoundError):
        tables.read_chunks(spark, str(tmp_path / "absent.json"))


PAGES = "page_no long, book string, chapter string, section string, source_url string, text string"


def test_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    chunks = chunking.chunk_pages(spark.createDataFrame([(1, "b", "c", "", "u", "red fox"), (2, "b", "d", "", "v", "blue whale")], PAGES))
    assert not store.exists(spark, path)
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    assert store.build(chunks, path).count() == 2 and store.exists(spark, path)
    assert store.get(spark, path, chunks.limit(1), rebuild=True).count() == 1
    with pytest.raises(ValueError):
        store.build(chunks.where("false"), path + "2")


def test_stream(spark, tmp_path):
    chunks = chunking.chunk_pages(spark.createDataFrame([(1, "b", "c", "", "u", "red fox"), (2, "b", "d", "", "v", "blue whale")], PAGES))
    index = store.build(chunks, f"file://{tmp_path}/index")
    spark.createDataFrame([(1, "red fox"), (2, "green")], "query_id long, question string").write.parquet(f"file://{tmp_path}/in")
    questions = spark.readStream.schema("query_id long, question string").parquet(f"file://{tmp_path}/in")
    run = answers.answer_stream(questions, index, f"file://{tmp_path}/out", f"file://{tmp_path}/marks", threshold=0.5)
    run.processAllAvailable()
    run.stop()
    got = {r["query_id"]: (r["found"], r["answer"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[1] == (True, "red fox") and not got[2][0]


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def fetch(replies, allow=True):
    clock = Clock()
    pace = landing.Pace(1.0, lambda: clock.now, clock.sleep)
    left = list(replies)

    def get(url):
        r = left.pop(0)
        if isinstance(r, Exception):
            raise r
        return url, "x", r

    try:
        return landing.fetch("u", pace, allow, get)[2], len(left), clock.slept
    except RuntimeError:
        return "failed", len(left), clock.slept


def test_fetching():
    assert fetch([200])[:2] == (200, 0)
    assert fetch([503, 429, 503])[0] == 503
    assert fetch([503, OSError(), 200])[0] == 200
    assert fetch([404, 200]) == (404, 1, [])
    assert fetch([404, 404, 404], allow=False)[0] == "failed"
    assert fetch([503, OSError(), OSError()])[0] == "failed"
    assert landing.listing_pages("a", lambda u: (u, u, 500 if u == "c" else 200), lambda h, u: {"a": "b", "b": "c"}[u]) == [("a", "a", 200), ("b", "b", 200)]
    assert len(landing.listing_pages("a", lambda u: (u, u, 200), lambda h, u: {"a": "b", "b": "a"}[u])) == 2


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def _names():
    from quern.plans import catalog

    return sorted(catalog.SQL)


def _plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", _names())
def test_queries_against_sql(spark, engine, name):
    from quern.plans import catalog

    got = catalog.QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    result = engine.sql(catalog.SQL[name])
    assert cols == sorted(result.columns)
    want = engine.sql(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall()
    rows = [tuple(map(_plain, r)) for r in got.select(*cols).collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(_plain, r))) for r in want)


FOREIGN = [{"book": "b", "chapter": f"c{k}", "text": f'say "{{[,]}}" {k}'} for k in range(7)]


@pytest.mark.parametrize("kind", ["one line", "pretty", "lines", "lines with commas", "tight", "pretty in two files", "empty file beside"])
def test_folders_of_other_tools_give_all_rows(spark, tmp_path, kind):
    folder = tmp_path / "pages"
    folder.mkdir()
    dumped = [json.dumps(r) for r in FOREIGN]
    files = {
        "one line": [json.dumps(FOREIGN[:3]), json.dumps(FOREIGN[3:])],
        "pretty": [json.dumps(FOREIGN, indent=2)],
        "lines": ["\n".join(dumped)],
        "lines with commas": ["[\n" + ",\n".join(dumped) + "\n]\n"],
        "tight": ["[" + dumped[0] + "," + dumped[1] + ",\n" + ",".join(dumped[2:]) + "]"],
        "pretty in two files": [json.dumps(FOREIGN[:5], indent=1), json.dumps(FOREIGN[5:], indent=4)],
        "empty file beside": ["", json.dumps(FOREIGN), " \n"],
    }[kind]
    for k, text in enumerate(files):
        (folder / f"part-{k}.json").write_text(text)
    got = tables.read_pages(spark, str(folder)).orderBy("position").collect()
    assert [(r["position"], r["book"], r["chapter"], r["text"], r["section"]) for r in got] == [(k, "b", r["chapter"], r["text"], None) for k, r in enumerate(FOREIGN)]


@pytest.mark.parametrize("text", ['{"book": "b"', '[{"book": "b"} {"book": "c"}]', '"text"', '[1, 2]', '{"a": 1} {"b": 2}', '[1, {"book": "b"}]', '[{"book": "b"},\n{"book": ]'])
def test_folders_that_are_no_list_raise(spark, tmp_path, text):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/a.json").write_text(text)
    with pytest.raises(ValueError):
        tables.read_chunks(spark, str(tmp_path / "pages"))
