"""The jobs over growing copies of the tables, with failures on the way, against SQL, and from the command line."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from jobs import catalog, judge_retrieval, keep_index
from quern.functions import text
from quern.shipping import BATCH

ROOT = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"
CONFIG = keep_index.Config.load()
SMALL = keep_index.Config(chunk_size=4, chunk_overlap=1, max_files_per_batch=64, columns=CONFIG.columns)


def land(spark, folder, name, rows):
    """One more file below ``folder``, later than those that are there."""
    made = folder.parent / f"made-{name}"
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(f"file://{made}")
    folder.mkdir(exist_ok=True)
    (part,) = made.glob("part-*.parquet")
    shutil.copy(part, folder / f"{name}.parquet")
    at = 1_700_000_000 + len(list(folder.iterdir()))
    os.utime(folder / f"{name}.parquet", (at, at))


def places(tmp_path, name="kept"):
    return f"file://{tmp_path}/in", f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}-checkpoint"


def state(spark, out):
    rows = keep_index.current(spark, out).select("page_no", "chunk_no", "book", "section", "text", F.size("embedding").alias("n"))
    return sorted(map(tuple, rows.collect()))


FIRST = [(0, "a b c d e f", "en", "s"), (1, "old text of one", "en", "s"), (2, "gone soon", "de", "t"), (3, None, "de", "t"), (None, "no id", "en", "s"), (4, "twice", "fr", "u"), (4, "twice", "fr", "u")]
SECOND = [(1, "new text of one now longer", "en", "s"), (2, " ", "de", "t"), (0, "a b c d e f", "en", "s"), (5, "first say", "fr", "u"), (5, "last say", "fr", "u"), (3, "now with text", "7", "t")]
EXPECTED = [
    (1, 1, "en", "s", "a b c d", 256), (1, 2, "en", "s", "d e f", 256), (2, 1, "en", "s", "new text of one", 256), (2, 2, "en", "s", "one now longer", 256),
    (4, 1, "7", "t", "now with text", 256), (5, 1, "fr", "u", "twice", 256), (6, 1, "fr", "u", "last say", 256),
]


def test_two_runs_over_growing_pages_take_only_what_is_new(spark, tmp_path, caplog):
    pages, out, checkpoint = places(tmp_path)
    land(spark, tmp_path / "in", "one", FIRST)
    assert keep_index.keep_index(spark, pages, out, checkpoint, SMALL) == 1
    before = state(spark, out)
    assert [r[:2] for r in before] == [(1, 1), (1, 2), (2, 1), (3, 1), (5, 1)]
    written = {f: f.stat().st_mtime_ns for f in (tmp_path / "kept").rglob("*.parquet")}
    assert keep_index.keep_index(spark, pages, out, checkpoint, SMALL) == 0 and state(spark, out) == before
    land(spark, tmp_path / "in", "two", SECOND)
    with caplog.at_level("INFO"):
        assert keep_index.keep_index(spark, pages, out, checkpoint, SMALL) == 1
    assert state(spark, out) == EXPECTED
    # What the first batch wrote stands as it was, and the second marks only pages that are new or changed.
    assert all(f.stat().st_mtime_ns == at for f, at in written.items())
    marks = {(r["batch"], r["page_no"]): r["copies"] for r in spark.read.schema(keep_index.MARKS).parquet(f"{out}/pages").collect()}
    assert marks == {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 1, (0, 5): 2, (1, 2): 1, (1, 3): 1, (1, 6): 2, (1, 4): 1}
    assert "batch 1: read 6 rows of 1 files, 0 of them without page_no" in caplog.text and "batch 1: wrote 4 new or changed pages and their 4 chunks" in caplog.text
    assert keep_index.keep_index(spark, pages, out, checkpoint, SMALL) == 0


@pytest.mark.parametrize("broken", ["chunks", "pages", "after"])
def test_a_batch_that_failed_comes_again(spark, tmp_path, monkeypatch, broken):
    pages, out, checkpoint = places(tmp_path)
    land(spark, tmp_path / "in", "one", FIRST)
    keep_index.keep_index(spark, pages, out, checkpoint, SMALL)
    before = state(spark, out)
    land(spark, tmp_path / "in", "two", SECOND)
    put, take = keep_index._put, keep_index.take_batch

    def failing_put(rows, path, *by):
        if path.endswith(broken):
            raise RuntimeError("lost")
        put(rows, path, *by)

    def failing_take(*args):
        take(*args)
        if broken == "after":
            raise RuntimeError("lost")

    monkeypatch.setattr(keep_index, "_put", failing_put)
    monkeypatch.setattr(keep_index, "take_batch", failing_take)
    with pytest.raises(StreamingQueryException):
        keep_index.keep_index(spark, pages, out, checkpoint, SMALL)
    monkeypatch.undo()
    assert state(spark, out) == (EXPECTED if broken == "after" else before)  # never half a batch
    assert keep_index.keep_index(spark, pages, out, checkpoint, SMALL) == 1
    assert state(spark, out) == EXPECTED


def test_files_one_by_one_and_at_once_give_the_same(spark, tmp_path):
    land(spark, tmp_path / "in", "one", FIRST)
    land(spark, tmp_path / "in", "two", SECOND)
    for k, files in enumerate((1, 64)):
        pages, out, checkpoint = places(tmp_path, f"kept{k}")
        config = keep_index.Config(4, 1, files, CONFIG.columns)
        assert keep_index.keep_index(spark, pages, out, checkpoint, config) == 2 - k
        assert state(spark, out) == EXPECTED


def test_pages_without_any_text(spark, tmp_path):
    pages, out, checkpoint = places(tmp_path)
    land(spark, tmp_path / "in", "one", [(1, None, "en", "s"), (None, "x", "en", "s")])
    with pytest.raises(FileNotFoundError):
        keep_index.current(spark, out)
    assert keep_index.keep_index(spark, pages, out, checkpoint, SMALL) == 1 and state(spark, out) == []
    with pytest.raises(ValueError, match="another checkpoint"):
        keep_index.keep_index(spark, pages, out, checkpoint + "-new", SMALL)


@pytest.mark.parametrize(
    "text", ["chunk_size = 0", "chunk_size = 5\nchunk_overlap = 5", "max_files_per_batch = 0", "[columns]\npage_no = 'a'"], ids=["size", "overlap", "files", "columns"]
)
def test_config_that_makes_no_sense(tmp_path, text):
    (tmp_path / "c.toml").write_text(text)
    with pytest.raises(ValueError):
        keep_index.Config.load(tmp_path / "c.toml")


QUESTIONS = [(1, "lazy dog", "ANSWERABLE", "c1"), (2, "red house", "answerable", "c9"), (3, "quantum flux", "unanswerable", None), (4, " ", "unanswerable", None)]
TEXTS = [(1, "b", "c1", "", "u1", "the quick brown fox and the lazy dog"), (2, "b", "c2", "s", "u2", "a red house on the hill"), (3, "b", "c3", "", "u3", None)]


def judge_config(**more):
    given = {"name": "t", "top_k": 2, "threshold": 1.2, "thresholds": [0.5, 1.2, 1.9, 2.0], "strategies": [{"id": "A", "chunk_size": 5, "overlap": 1}, {"id": "long", "chunk_size": 50, "overlap": 0}]}
    given |= {"pages": {c: c for c in ("page_no", "book", "chapter", "section", "source_url", "text")}, "questions": {c: c for c in ("query_id", "question", "type", "expected_chapter")}}
    return judge_retrieval.Config(**(given | more))


@pytest.fixture
def judged(spark, tmp_path):
    spark.createDataFrame(QUESTIONS, "query_id long, question string, type string, expected_chapter string").write.parquet(f"file://{tmp_path}/q")
    spark.createDataFrame(TEXTS, "page_no long, book string, chapter string, section string, source_url string, text string").write.parquet(f"file://{tmp_path}/p")
    return f"file://{tmp_path}/q", f"file://{tmp_path}/p", f"file://{tmp_path}/out"


def tables(spark, out, run):
    return [sorted(map(str, judge_retrieval.read(spark, out, t, run).collect())) for t in judge_retrieval.TABLES]


def test_judging_twice_gives_the_same_and_other_configs_are_other_runs(spark, judged):
    q, p, out = judged
    run = judge_retrieval.judge_retrieval(spark, q, p, out, judge_config())
    first = tables(spark, out, run)
    rows = {(r["strategy"], r["query_id"]): r for r in judge_retrieval.read(spark, out, "rows", run).collect()}
    assert len(rows) == 8 and rows["long", 1]["hit"] and rows["long", 2]["hit"] is False and rows["long", 3]["hit"] is None
    assert rows["A", 4]["best_score"] is None and not rows["A", 4]["passes_threshold"]
    other = judge_retrieval.judge_retrieval(spark, q, p, out, judge_config(top_k=1))
    assert other != run and tables(spark, out, run) == first
    assert judge_retrieval.judge_retrieval(spark, q, p, out, judge_config()) == run and tables(spark, out, run) == first


def test_thresholds_are_those_of_the_rows(spark, judged):
    q, p, out = judged
    run = judge_retrieval.judge_retrieval(spark, q, p, out, judge_config())
    rows = judge_retrieval.read(spark, out, "rows", run).collect()
    for name in ("A", "long"):
        got = judge_retrieval.read(spark, out, "thresholds", run).where(F.col("strategy") == name).orderBy("threshold").collect()
        mine = [r for r in rows if r["strategy"] == name]
        passes = lambda r, t: r["best_score"] is not None and r["best_score"] <= t
        means = []
        for g in got:
            t = g["threshold"]
            a, b = sum(passes(r, t) for r in mine if r["type"] == "answerable"), sum(not passes(r, t) for r in mine if r["type"] == "unanswerable")
            assert (g["threshold_passes"], g["unanswerable_gated"], g["answerable"], g["unanswerable"]) == (a, b, 2, 2)
            means.append(g["mean_rate"])
            assert g["mean_rate"] == (a / 2 + b / 2) / 2
        assert [g["best"] for g in got] == [k == means.index(max(means)) for k in range(4)]


def test_gold_is_the_first_page_that_holds_the_text(spark, judged):
    q, p, out = judged
    config = judge_config(questions={"query_id": "query_id", "question": "if(query_id = 3, 'the', question)"})
    run = judge_retrieval.judge_retrieval(spark, q, p, out, config)
    gold = {r["query_id"]: (r["type"], r["expected_chapter"]) for r in judge_retrieval.read(spark, out, "rows", run).where("strategy = 'A'").collect()}
    assert gold == {1: ("answerable", "c1"), 2: ("answerable", "c2"), 3: ("answerable", "c1"), 4: ("answerable", "c1")}  # a blank is in any text


@pytest.mark.parametrize("change", [{"strategies": []}, {"strategies": [{"id": "1", "chunk_size": 5, "overlap": 1}]}, {"questions": {"query_id": "a", "question": "b", "type": "c"}}], ids=["none", "digit", "half"])
def test_judging_config_that_makes_no_sense(tmp_path, change):
    def toml(v):
        return "{" + ", ".join(f"{k} = {toml(x)}" for k, x in v.items()) + "}" if isinstance(v, dict) else "[" + ", ".join(map(toml, v)) + "]" if isinstance(v, list) else repr(v)

    given = {"strategies": [{"id": "A", "chunk_size": 5, "overlap": 1}], "questions": {"query_id": "a", "question": "b"}} | change
    (tmp_path / "c.toml").write_text("\n".join(f"{k} = {toml(v)}" for k, v in given.items()))
    with pytest.raises(ValueError):
        judge_retrieval.Config.load(tmp_path / "c.toml")


def same(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-6) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_registered_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    setting = spark.conf.get(BATCH)
    got = catalog.QUERIES[name](spark, FOLDER)
    assert spark.conf.get(BATCH) == setting
    expected = con.execute(catalog.SQL[name])
    columns = sorted(d[0] for d in expected.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in expected.description].index(c) for c in columns]
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    others = sorted((tuple(r[k] for k in at) for r in expected.fetchall()), key=key)
    assert len(rows) == len(others) and all(same(a, b) for a, b in zip(rows, others, strict=True))


def test_command_line(tmp_path):
    shutil.copytree(FOLDER, tmp_path / "data", ignore=lambda d, names: [n for n in names if n not in ("documents.parquet", "benchmark.parquet")])
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    for args in (["jobs.keep_index", tmp_path / "data/documents.parquet", tmp_path / "kept", tmp_path / "mark"], ["jobs.judge_retrieval", tmp_path / "data/benchmark.parquet", tmp_path / "data/documents.parquet", tmp_path / "judged"]):
        ran = subprocess.run([sys.executable, "-m", *map(str, args)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert ran.returncode == 0, ran.stderr[-2000:]
        assert " read " in ran.stderr and " wrote " in ran.stderr
    assert list((tmp_path / "kept/chunks").glob("batch=0/book=*/*.parquet")) and list((tmp_path / "judged/rows").glob("run=nightly-*/strategy=A/*.parquet"))


def test_jobs_use_nothing_of_the_training_operators():
    for f in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        lines = [line for line in f.read_text().splitlines() if line.startswith(("import ", "from "))]
        assert not any("llm" in line or "corpus_pipeline" in line for line in lines)


def test_pages_are_prepared_once_for_all_strategies_and_runs(spark, judged, monkeypatch):
    q, p, out = judged
    made = []
    own = text.clean
    monkeypatch.setattr(text, "clean", lambda column: made.append(column) or own(column))
    run = judge_retrieval.judge_retrieval(spark, q, p, out, judge_config())
    assert len(made) == 1
    first = tables(spark, out, run)
    assert judge_retrieval.judge_retrieval(spark, q, p, out, judge_config()) == run and len(made) == 1 and tables(spark, out, run) == first
    # Pages that are others by then are prepared anew.
    page = spark.read.parquet(p).where("page_no = 1").withColumns({"page_no": F.lit(99).cast("long"), "chapter": F.lit("late")})
    page.write.mode("append").parquet(p)
    assert judge_retrieval.judge_retrieval(spark, q, p, out, judge_config()) == run and len(made) == 2
    index = judge_retrieval.read(spark, out, "index", run)
    assert index.where("page_no = 99 AND chapter = 'late'").count() == index.where("page_no = 1").count() > 0
