import datetime
import random
from decimal import Decimal

import numpy as np
import pytest

from quern.llm import jaccard
from quern.llm.components import components


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] and sets[i] and sets[j] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    key = [(r[0] is not None, 0 if r[0] is None else r[0]) for r in rows]  # a missing id is the smallest
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(key[i], least.get(find(i), key[i]))
    out = [least[find(i)] if sets[i] else key[i] for i in range(len(rows))]
    return sorted(((r[0], len(s), c[1] if c[0] else None) for r, s, c in zip(rows, sets, out, strict=True)), key=repr)


def found(spark, rows, kind="long"):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    return sorted((tuple(r) for r in jaccard.join(spark, docs).collect()), key=repr)


def near_copies(groups, size, n, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words + ["tail"] * rng.randrange(2))))
    rng.shuffle(rows)
    return rows


def test_edge_cases(spark, docs, none, rows):
    got = sorted((tuple(r) for r in jaccard.join(spark, docs).collect()), key=repr)
    assert got == brute(rows)
    assert jaccard.join(spark, none).count() == 0


def test_near_copies_and_shared_passages(spark):
    rows = near_copies(6, 25, 70, 1)
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + k, passage + " " + " ".join(f"own{k}_{j}" for j in range(3 + 3 * k))) for k in range(40)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", ["tasks", "outsiders", "pairs"])
def test_limits_choose_ways_not_results(spark, monkeypatch, limit):
    rows = near_copies(2, 60, 50, 2)
    if limit == "outsiders":
        # Chains of texts, of which few are linked to a pivot, and a passage in all of them that brings them together.
        words = [f"s{k}" for k in range(120)]
        rows = [(100 * c + k, " ".join(f"c{c}{w}" if j < k * 3 else w for j, w in enumerate(words))) for c in range(5) for k in range(30)]
        monkeypatch.setattr(jaccard, "PAIRED", 4)
        monkeypatch.setattr(jaccard, "HEAVY_MAX", 1)
        monkeypatch.setattr(jaccard, "PIVOTS", 4)
        calls = []
        real = jaccard._second_tasks
        monkeypatch.setattr(jaccard, "_second_tasks", lambda cut: calls.append(1) or real(cut))
    if limit != "pairs":
        monkeypatch.setattr(jaccard, "TASK_ROWS", 20)
        monkeypatch.setattr(jaccard, "TILE", 16)
        monkeypatch.setattr(jaccard, "STRIPE", 64)
    else:
        monkeypatch.setattr(jaccard, "HEAVY_MAX", 5)
    assert found(spark, rows) == brute(rows)
    assert limit != "outsiders" or calls


@pytest.mark.parametrize("kind, name", [("string", str), ("int", int), ("decimal(20,2)", Decimal), ("date", lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(k))])
def test_ids_of_any_type(spark, kind, name):
    rows = [(None if k == 5 else name(k % 9), t) for k, t in near_copies(3, 6, 40, 4)]
    assert found(spark, rows, kind) == brute(rows)


def test_a_component_of_50_000_rows_is_not_copied(spark, monkeypatch):
    """Near copies of one text: what goes to tasks is little more than one set for each of them."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(50_000):
        words = list(base)
        words[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(words)))
    sent = []
    real = jaccard._product

    def product(spark, docs, wanted, members):
        sent.append((wanted.count(), members.count()))
        return real(spark, docs, wanted, members)

    monkeypatch.setattr(jaccard, "_product", product)
    got = found(spark, rows)
    assert len(got) == 50_000 and {c for _, _, c in got} == {0}
    assert sent[0][1] == 50_000 and sum(n for n, _ in sent) < 100_000, sent


def test_a_stars_centre_is_joined_to_written_minima(spark):
    """Both sides of each join are plain tables, so that the rows of one key may be split."""
    edges = spark.createDataFrame([(0, k) for k in range(1, 20_000)] + [(k, k + 50_000) for k in range(1, 100)], "a long, b long")
    got = components(spark, edges)
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 20_099


def test_bitmaps_never_refuse_a_link():
    rng = np.random.default_rng(0)
    for n, m in ((30, 33), (600, 640), (3000, 3300), (900, 1100)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 20], rng.integers(0, 2**63, m - n, dtype=np.uint64)])
        apart = len(np.setxor1d(a, b))
        assert jaccard.bits_apart(jaccard.parity(a), jaccard.parity(b)) <= apart


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(40)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(51)} | {100 + k: 100 for k in range(40)} | {200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_that_share_an_id_keep_their_links(spark):
    def text(name, *changed):
        return " ".join(f"{name}{k}" if k not in changed else f"x{k}" for k in range(60))

    a, b, z = text("a"), text("b"), text("z")
    # B and its near copy, and A's, link over other texts under the same ids; null ids, and three texts under one id.
    rows = [(None, a), (None, b), (20, text("b", 3)), (21, text("a", 5)), (3, z), (5, z), (5, text("q")), (9, text("q", 7)), (30, text("m")), (30, text("n")), (30, text("o")), (31, text("n", 1)), (32, text("o", 2)), (40, "one"), (40, "two")]
    assert found(spark, rows) == brute(rows)
    mixed = " ".join(f"s{k}" for k in range(40))
    rows = [(None if k % 3 == 0 else k % 7, f"{mixed} " + " ".join(f"t{k % 5}_{j}" for j in range(9 + k % 5))) for k in range(40)]
    assert found(spark, rows) == brute(rows)


def test_sets_of_one_task_are_told_apart_by_class():
    import pandas as pd

    a, b = (np.arange(k, k + 50, dtype=np.uint64) for k in (0, 1000))
    near = np.r_[b[:49], np.uint64(5000)]
    blob = pd.DataFrame({"slot": 0, "task": 1, "k1": [1, 2, 3], "label": [1, 2, 3], "side": 0, "crossed": False, "tokens": [x.tobytes() for x in (a, b, near)]})
    got = jaccard._links(blob)
    assert {tuple(sorted(x)) for x in got.itertuples(index=False)} == {(2, 3)}
