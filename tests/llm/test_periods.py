"""Periodic runs against a plain search of every period, the looping of texts word by word, and odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x):
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i < len(x) - q:
            s = i
            while i < len(x) - q and x[i] == x[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(6, 4 * q) and not any(all(x[k] == x[k + c] for k in range(s, s + n - c)) for c in range(1, q)):
                out.append((s, n, q))
            i += i == s
    return sorted(out)


def plain_looped(doc_id, text):
    ws = WORD.findall(text or "")
    if doc_id is None or not ws:
        return ws
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(ws)
    if h % 10:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def plain(doc_id, text):
    ws = plain_looped(doc_id, text)
    runs = plain_runs(ws)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    cut = {k for s, n, q in runs for k in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(ws) if k not in cut)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)


def looping(rnd):
    """Repeats of repeats, cut short anywhere, over few or many words."""
    x, n, words = [], rnd.randint(0, 150), rnd.choice([1, 2, 3, 50])
    while len(x) < n:
        kind = rnd.random()
        unit = [rnd.randrange(words) for _ in range(rnd.randint(1, rnd.choice([2, 5, 20])))]
        if kind < 0.5:
            unit *= rnd.randint(1, 9)
            x += unit[: len(unit) - rnd.randrange(max(1, len(unit) // 9))]
        elif kind < 0.7 and x:
            a = rnd.randrange(len(x))
            x += x[a : a + rnd.randint(1, 60)]
        else:
            x += unit
    return x


@given(st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_runs_are_those_of_the_plain_search(rnd):
    texts = [looping(rnd) for _ in range(rnd.randint(1, 5))]
    bounds = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
    found = periods.runs_of(np.array(sum(texts, []), np.int64), bounds)
    assert [found.get(k, []) for k in range(len(texts))] == [plain_runs(x) for x in texts]


def test_chunks_of_blocks_find_the_same(monkeypatch):
    rnd = random.Random(5)
    x = sum((looping(rnd) for _ in range(8)), [])
    monkeypatch.setattr(periods, "CHUNK", 4)
    assert periods.runs_of(np.array(x), np.array([0, len(x)]))[0] == plain_runs(x)


@pytest.mark.parametrize("x", [[0] * 200_000, ([0] * 3000 + [1]) * 40 + [2] + ([0] * 2000 + [1]) * 3], ids=["one word", "stretches"])
def test_repeats_everywhere_are_not_paired(x, monkeypatch):
    calls = []
    grow = periods.stretch
    monkeypatch.setattr(periods, "stretch", lambda *a: calls.append(1) or grow(*a))
    runs = periods.runs_of(np.array(x), np.array([0, len(x)]))[0]
    assert (0, 200_000, 1) in runs or (0, 120_040, 3001) in runs
    assert len(calls) < 3000


def test_primitive():
    assert all(periods.primitive(np.array(p)) for p in ([1], [1, 2], [1, 2, 1], [1, 1, 2, 1, 1, 3]))
    assert not any(periods.primitive(np.array(p)) for p in ([1, 1], [1, 2, 1, 2], [1, 2, 3] * 5))


@pytest.fixture(scope="module")
def odd(rows):
    loops = [
        "a a a a a a", "a a a a a", "a b a b a b a b c", "x " + "ja nein " * 7 + "ja", "é é é é é é é", "one\x1ctwo " * 6, "l1\nl2\n" * 9, "Z " * 500, "q\x85 " * 6,
        " ".join(f"u{k}" for k in range(40)) + " " + "t1 t2 t3 t4 t5 " * 5,
    ]
    more = [(100 + k, " ".join(random.Random(k).choices("ab", k=90))) for k in range(60)] + [(200, None), (201, " \n ")]
    return [r for r in rows if r[0] not in (10, 11)] + [(20 + k, t) for k, t in enumerate(loops)] + more


def test_rows(spark, odd):
    docs = spark.createDataFrame([(*r, 1, "r", "c") for r in odd], "doc_id long, text string, start int, runs string, collapsed string").repartition(3)
    got = periods.described(periods.find_runs(periods.looped(docs)))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain(*r) for r in odd), key=key)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in odd)


def test_very_long_text_and_ids_of_another_type(spark, rows):
    text = next(t for i, t in rows if i == 10)
    docs = spark.createDataFrame([("x", text + " loop it" * 9), (None, text)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in periods.find_runs(docs).collect()}
    n = len(text.split())
    assert [tuple(r) for r in got["x"]["runs"]] == [(n, 18, 2)] and got["x"]["collapsed"] == " ".join([*text.split(), "loop", "it"])
    assert got[None]["runs"] == [] and got[None]["collapsed"] == " ".join(text.split())


def test_empty_table(spark, none):
    assert periods.described(periods.find_runs(periods.looped(none))).collect() == []


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r["text"] or "") < 6000]
    got = {r["doc_id"]: tuple(r) for r in periods.op11_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs) and all(got[r["doc_id"]] == plain(*r) for r in short)
    assert sum(r[1] > 0 for r in got.values()) > 5
