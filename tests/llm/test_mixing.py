"""The mix against lists of words laid out one by one, quotients listed one by one, and the contract on odd tables."""

import hashlib
import re

import duckdb
import pytest

from quern.llm import catalog, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, times=3):
    """sizes by source in order: weights' shares, what is above a cap dealt again until none is above."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        above = {k for k in open_ if weights[k] * unit > times * sizes[k]}
        if not above:
            for k in open_:
                target[k] = weights[k] * unit
            break
        for k in above:
            target[k] = float(times * sizes[k])
            left -= target[k]
        open_ -= above
    return target


def plain_seats(targets, blocks):
    """The source of each block in order, by highest quotient, the first source among equals."""
    seats, order = [0] * len(targets), []
    for _ in range(blocks):
        k = max((k for k in range(len(targets)) if targets[k] > 0), key=lambda k: (targets[k] / (2 * seats[k] + 1), -k))
        seats[k] += 1
        order.append(k)
    return order


def plain_taken(docs, seed="mix", block=16, times=3):
    """(doc_id, size, source_size, target, taken) of each (doc_id, text, source), word by word."""
    names = sorted({s for _, _, s in docs if s is not None}) + ([None] if any(s is None for _, _, s in docs) else [])
    md5 = lambda *p: hashlib.md5(" ".join((seed, *("" if x is None else str(x) for x in p))).encode()).hexdigest()
    rows = [(d, len(WORD.findall(t or "")), s, md5(d, t)[:16], k) for k, (d, t, s) in enumerate(docs)]
    sizes = [sum(r[1] for r in rows if r[2] == s) for s in names]
    targets = plain_targets(sizes, [1 + k % 3 for k in range(len(names))], times)
    order = plain_seats(targets, (2 * sum(sizes) + block) // (2 * block))
    taken = [0] * len(docs)
    for k, s in enumerate(names):
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[1], r[4]))
        words = [r[4] for r in mine for _ in range(r[1])]
        blocks = [words[i : i + block] for i in range(0, len(words), block)]
        n = len(blocks)
        stride = next((p for p in (999983, 999979, 999961) if n and n % p), 1)
        begin = int(md5(s)[:8], 16) % n if n else 0
        passed = [None] * n
        for b, part in enumerate(blocks):
            passed[(b * stride + begin) % n] = part
        drawn = [w for part in passed for w in part] * times
        for w in drawn[: order.count(k) * block]:
            taken[w] += 1
    return [(r[0], r[1], sizes[names.index(r[2])], targets[names.index(r[2])], taken[r[4]]) for r in rows]


def key(r):
    return tuple((v is not None, v) for v in r)


def mixed(spark, docs):
    out = mixing.mix(spark, docs)[0].select("doc_id", "size", "source_size", "target", "taken")
    return sorted(map(tuple, out.collect()), key=key)


@pytest.fixture(scope="module")
def odd(rows):
    """Sources of one word, of one long text, of repeated rows, without words, without a name, and an empty name."""
    names = ["a", "b", None, "", "é", "Z"]
    out = [(i, t if t is None or len(t) < 9000 else t[:9000], names[k % len(names)]) for k, (i, t) in enumerate(rows)]
    out += [(40, "one", "tiny"), (41, "w " * 2000, "long"), (42, None, "void"), (43, " \n", "void"), (None, "x y z", None)]
    return out + [(44, "again and again " * 3, "same")] * 40


def test_rows_are_those_of_the_plain_mix(spark, odd):
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in odd], "doc_id long, text string, source string, size int, place string, start int").repartition(3)
    got, expected = mixed(spark, docs), sorted(plain_taken(odd), key=key)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in expected]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, expected, strict=True))
    # Another distribution of the rows gives the same.
    assert mixed(spark, docs.repartition(7, "text")) == got
    assert all(0 <= r[4] <= 3 * r[1] for r in got)
    given = {}
    for r in got:
        given[r[2:4]] = given.get(r[2:4], 0) + r[4]
    assert abs(sum(r[1] for r in got) - sum(given.values())) <= 16 * len(given)  # a source at its most gives no block beyond it


def test_quotas_are_the_highest_quotients(spark):
    for targets, block, shards in (([50.0, 30.0, 20.0], 1, 7), ([7.0, 7.0, 7.0, 7.0], 1, 5), ([1000.0, 1.0, 0.0, 3.0, 160.0], 4, 3), ([5.0], 2, 4)):
        total = int(sum(targets))
        sizes = [total - (len(targets) - 1), *[1] * (len(targets) - 1)] if len(targets) > 1 else [total]
        sizes = [s if t > 0 else 0 for s, t in zip(sizes, targets, strict=True)]
        sizes[0] += total - sum(sizes)
        rows = [(k, f"s{k}", sizes[k], 10**9, t) for k, t in enumerate(targets)]
        sources = spark.createDataFrame(rows, "place long, source string, source_size long, most long, target double")
        got = mixing.quotas(spark, sources, block, shards).collect()
        order = plain_seats(targets, (2 * total + block) // (2 * block))
        ends = [len(order) * (j + 1) // shards for j in range(shards)]
        for r in got:
            lo = ends[r["shard"] - 1] if r["shard"] else 0
            assert r["blocks"] == order[lo : ends[r["shard"]]].count(r["place"])
            assert r["before"] == order[:lo].count(r["place"])


def test_pieces_are_what_is_taken(spark, odd):
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string").where("doc_id is not null and doc_id <> 44 and doc_id <> 15")
    rows, sources, shares = mixing.mix(spark, docs, shards=5)
    parts = mixing.pieces(rows).collect()
    taken = {r["doc_id"]: r["taken"] for r in rows.collect()}
    sizes = {r["doc_id"]: r["size"] for r in rows.collect()}
    for doc in taken:
        mine = [p for p in parts if p["doc_id"] == doc]
        assert sum(p["length"] for p in mine) == taken[doc]
        counts = [0] * sizes[doc]
        for p in mine:
            assert p["length"] > 0 and 0 <= p["start"] and p["start"] + p["length"] <= sizes[doc]
            for k in range(p["start"], p["start"] + p["length"]):
                counts[k] += 1
        assert not counts or max(counts) - min(counts) <= 1
    names = {r["place"]: r["source"] for r in sources.collect()}
    for r in shares.collect():
        got = sum(p["length"] for p in parts if p["shard"] == r["shard"] and p["source"] == names[r["place"]])
        assert abs(got - 16 * r["blocks"]) <= 3 * 16, r


def test_one_source_holds_most_rows(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 9 as int)) as text", "if(id % 3 = 0, concat('s', id % 7), 'hot') as source")
    rows, sources, _ = mixing.mix(spark, docs)
    by = {r["source"]: r for r in rows.groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()}
    assert len(by) == 8
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 32 for r in by.values())
    assert sum(r["sum(taken)"] for r in by.values()) - sum(r["sum(size)"] for r in by.values()) in range(-16 * 8, 9)


def test_each_document_is_its_own_source(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('w ', cast(20 + id % 90 as int)) as text", "cast(id as string) as source")
    rows = mixing.mix(spark, docs)[0].collect()
    assert len(rows) == 500 and all(abs(r["taken"] - r["target"]) <= 32 for r in rows)


def test_tables_without_words_or_rows(spark, none):
    assert mixed(spark, none.selectExpr("*", "cast(null as string) as source")) == []
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None), (2, "", "a")], "doc_id long, text string, source string")
    assert mixed(spark, docs) == sorted([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


def test_plan_has_no_python(spark):
    plan = mixing.op12_sainte_lague(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    expected = sorted(con.execute(catalog.ORACLE_SQL["op12_sainte_lague"]).fetchall())
    assert sorted(map(tuple, mixing.op12_sainte_lague(spark, folder).collect())) == expected
