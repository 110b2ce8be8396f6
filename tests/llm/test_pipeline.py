import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import catalog, jaccard, secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents before the first stage and after each, written and read again between them."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_rows(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    counts = [s.count() for s in stages[:-1]]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0


def test_one_of_each_group_stays(spark, stages):
    kept = {r["doc_id"] for r in stages[3].collect()}
    groups = jaccard.join(spark, stages[2]).collect()
    assert kept == {r["component_id"] for r in groups}


def test_no_secret_stays_and_packing_is_whole(stages):
    for r in stages[4].collect():
        assert not secrets.base_spans(r["text"])
        assert r["n_chars"] == len(r["text"])
    from tokenizers import Tokenizer
    import public_tokenizers as P

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = stages[5].collect()
    for r in stages[4].collect():
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        own = sorted((p for p in pieces if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)


def near(spark, docs):
    return corpus_pipeline.near_duplicates(spark, docs, "")


def test_repeated_and_missing_ids(spark, docs, rows):
    kept = near(spark, docs)
    assert kept.columns == docs.columns
    # Of the rows that all stages share: 3, 4 and the near copies of 5 and 10 are told by text alone; what has no words stays.
    links = {6: 5, 8: 5, 7: 5, 11: 10, 4: 3}
    got = Counter(r["doc_id"] for r in kept.collect())
    want = Counter(i for k, (i, t) in enumerate(rows) if i not in links and (i, t) not in rows[:k])
    assert got == want


def test_ids_alone_drop_no_text(spark):
    def text(name, *changed):
        return " ".join(f"{name}{k}" if k not in changed else f"x{k}" for k in range(60))

    rows = [(None, text("a")), (None, text("z")), (7, text("a", 3)), (5, text("b")), (5, text("c")), (3, text("c", 4)), (8, text("d")), (8, text("d")), (None, ""), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = sorted((tuple(r) for r in near(spark, docs).collect()), key=repr)
    want = [(None, text("a")), (None, text("z")), (5, text("b")), (3, text("c", 4)), (8, text("d")), (None, ""), (None, None), (9, ""), (9, "")]
    assert got == sorted(((*r, "en") for r in want), key=repr)
    three = spark.createDataFrame([(None, text(n)) for n in "abc"], "doc_id long, text string")
    assert near(spark, three).count() == 3
    one_id = spark.createDataFrame([(7, text("a")), (7, text("b")), (8, text("c"))], "doc_id long, text string")
    assert near(spark, one_id).count() == 3
    same = spark.createDataFrame([(None, text("a"))] * 50, "doc_id long, text string").repartition(4)
    assert near(spark, same).count() == 1


NAMES = ("gone", "kept_rid", "kept_row", "rid", "row", "row_number", "file", "at", "place_0", "Place_1", "_metadata", "id", "n", "k1", "label", "task", "score", "kept", "rule", "toxic", "words", "size", "spans", "with.dot", "with space")


def stages_of(spark, folder, docs, tmp_path):
    """All stages but the last over a table of documents, each written and read again; the last one's pieces."""
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        yield docs


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('labels')}"
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_take_any_columns_null_texts_and_repeats(spark, labels, tmp_path):
    good = [" ".join(f"{w}{k}" for k in range(70)) for w in ("alpha", "beta", "gamma")]
    rows = [(1, good[0]), (1, good[1]), (None, good[2]), (2, None), (3, ""), (3, " \n"), (4, good[0]), (4, good[0]), (None, None)]
    schema = "doc_id long, text string" + "".join(f", `{n}` string" for n in NAMES)
    docs = spark.createDataFrame([(*r, *NAMES) for r in rows], schema)
    docs.write.parquet(f"file://{tmp_path}/in")
    sizes = [t.count() for t in stages_of(spark, labels, spark.read.parquet(f"file://{tmp_path}/in"), tmp_path)]
    assert sizes[:4] == [5, 5, 3, 3]
    # The later stages keep what has no words.
    for k in (1, 2, 3):
        out = corpus_pipeline.STAGES[k][1](spark, docs, labels)
        assert out.columns == docs.columns
        assert sorted(repr((r["doc_id"], r["text"])) for r in out.collect() if not (r["text"] or "").strip()) == sorted(repr(r) for r in rows if not (r[1] or "").strip())
    assert corpus_pipeline.STAGES[4][1](spark, docs, labels).select("doc_id").distinct().count() == 5


def test_stages_of_an_empty_table(spark, labels, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, gone int")
    assert [t.count() for t in stages_of(spark, labels, docs, tmp_path)] == [0] * 5


def test_names():
    assert sorted(catalog.QUERIES, key=lambda n: int(n[2:].split("_")[0])) and {int(n[2:].split("_")[0]) for n in catalog.QUERIES} == set(range(1, 13))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard", "secret_scans", "packing"]
