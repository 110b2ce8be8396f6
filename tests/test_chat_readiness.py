import itertools
import json

import pytest

from quern.config import NO_ANSWER, Settings
from quern.functions import html as H
from quern.operators import chunking, retrieval
from quern.sources import chat, crawl, readiness, tables
from quern.sources import index as store

PAGES = "page_no long, book string, chapter string, section string, source_url string, text string"


def tags(*models):
    return lambda url, timeout: json.dumps({"models": list(models)}).encode()


def lost(url, timeout):
    raise OSError("connection refused")


def test_probe():
    asked = []
    assert readiness.probe("http://h/", "m", lambda u, t: asked.append((u, t)) or b'{"models": [{"name": " m:latest "}]}') is None
    assert asked == [("http://h/api/tags", 3.0)]
    assert readiness.probe("http://h", "m", lost) == "server_down"
    assert readiness.probe("http://h", "m", lambda u, t: b"<html>") == "server_down"
    assert readiness.probe("http://h", "m", lambda u, t: b"[]") == "server_down"
    assert readiness.probe("http://h", "m", lambda u, t: b"") == "model_missing"
    assert readiness.probe("http://h", "m:1", tags({"model": "m:latest"}, "odd", {"name": 3})) == "model_missing"
    assert readiness.probe("http://h", "m:1", tags({"model": "m:1"})) is None


def test_errors(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert readiness.errors(spark, path, "http://h", "m", lost) == ["index_missing", "server_down"]
    store.build(chunking.chunk_pages(spark.createDataFrame([(1, "b", "c", "", "u", "red fox")], PAGES)), path)
    assert readiness.errors(spark, path, "http://h", "m", tags({"name": "m"})) == []
    assert set(readiness.ADVICE) == {"index_missing", "server_down", "model_missing"}


def test_chat(spark, tmp_path):
    path, where = f"file://{tmp_path}/index", f"file://{tmp_path}/chats"
    clock = itertools.count(0, 10)
    one = chat.Chat(spark, where, "a", lambda: next(clock))
    assert one.messages().count() == 0 and one.ask("  ", path) is None
    assert one.ask("red fox", path)["error"] == "index_missing"
    store.build(chunking.chunk_pages(spark.createDataFrame([(1, "b", "c", "", "u", "red fox")], PAGES)), path)
    said = one.ask(" red fox ", path)
    assert said["content"] == "red fox" and said["found"] and said["sources"][0]["chapter"] == "c"
    assert one.ask("green", path)["content"] == NO_ANSWER

    def fails(asked, index):
        raise ValueError("model 'x' not found")

    assert one.ask("blue", path, fails)["error"] == "model_missing"
    rows = one.messages().collect()
    assert [r["role"] for r in rows] == ["user", "assistant"] * 4 and [r["content"] for r in rows[2:6]] == ["red fox", "red fox", "green", NO_ANSWER]
    other = chat.Chat(spark, where, "b", lambda: next(clock))
    other.add({"role": "user", "content": "x"})
    one.reset()
    assert one.messages().count() == 0 and other.messages().count() == 1
    with pytest.raises(ValueError):
        chat.Chat(spark, where, "a/b")


def test_json_round_trip(spark, tmp_path):
    rows = [(f"b{k}", None if k % 3 else f"c{k}", "s", f"u{k}", "t", f"],[ \"{k}\"\n লেখা", k) for k in range(250)]
    pages = spark.createDataFrame(rows, tables.PAGE).repartition(5)
    path = f"file://{tmp_path}/pages"
    tables.write_json(pages, path, ["char_count"])
    got = tables.read_pages(spark, path).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(k, *r) for k, r in enumerate(rows)]
    whole = "".join(p.read_text() for p in sorted((tmp_path / "pages").glob("part-*")))
    assert [tuple(r.values()) for r in json.loads(whole)] == rows
    tables.write_json(pages.limit(0), path, ["char_count"])
    assert json.loads("".join(p.read_text() for p in (tmp_path / "pages").glob("part-*"))) == []
    with pytest.raises(ValueError):
        tables.read_pages(spark, path)
    chunks = spark.createDataFrame([("1-1", "b", "c", "", "u", "t")], tables.CHUNK)
    tables.write_json(chunks, f"file://{tmp_path}/chunks", ["chunk_id"])
    assert [tuple(r)[1:] for r in tables.read_chunks(spark, f"file://{tmp_path}/chunks").collect()] == [("1-1", "b", "c", "", "u", "t")]


def test_pages_must_be_a_list(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"book": "b"}))
    with pytest.raises(ValueError):
        tables.read_pages(spark, str(tmp_path / "one.json"))
    with pytest.raises(FileNotFoundError):
        tables.read_pages(spark, f"{tmp_path}/none.json")


def test_landing_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crawl, "BATCH", 2)
    urls, asked, down = [f"u{k}" for k in range(5)], [], {"u3"}

    def fetch(url):
        asked.append(url)
        if url == "u4" and len(asked) < 6:
            raise KeyboardInterrupt
        if url in down:
            raise RuntimeError("lost")
        return url + "/final", f"<p>{url}", 200

    where = f"file://{tmp_path}/landed"
    with pytest.raises(KeyboardInterrupt):
        crawl.land(spark, urls, fetch, where)
    assert crawl.land(spark, ["u0"], fetch, where).count() == 1 and asked == urls
    down.clear()
    got = sorted(tuple(r) for r in crawl.land(spark, urls, fetch, where).collect())
    assert asked[5:] == ["u3", "u4"] and got == [(k + 1, f"u{k}/final", 200, f"<p>u{k}") for k in range(5)]


def test_content_is_read_once(spark):
    rows = [(1, "<div id=mw-content-text>a<p>b</div>"), (2, "<div id=mw-content-text><p class=noarticletext>x</div>"), (3, None)]
    pages = spark.createDataFrame(rows, "k long, html string")
    one = pages.select("k", H.content("html").alias("c")).select("k", "c.*").orderBy("k").collect()
    two = pages.select("k", H.extract_text("html").alias("text"), H.is_missing("html").alias("missing")).orderBy("k").collect()
    assert one == two


def test_questions_in_blocks(spark, monkeypatch):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)]
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = index.withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, retrieval.nearest(asked, index, 3, ("vec_id",)).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    assert sorted(map(tuple, retrieval.nearest(asked, index, 3, ("vec_id",)).collect())) == whole


def test_default_places():
    assert Settings.load({"DATA_DIR": "s3://x/"}).place("index") == "s3://x/vectorstore/index"
