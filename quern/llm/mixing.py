"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Everything here is DataFrame and SQL work. A source's target is its share of all words by weight, but at most TIMES its own words;
what is above goes to the others by weight, round after round, until none is above. The mix is cut into blocks of ``block``
words, which go to the sources by highest quotients target / (2 i + 1), i being the blocks that a source has. The first
blocks of that order are shard 0, the next are shard 1, and so on, so each shard is near the targets as well and gets a whole number of
blocks of each source. Equal quotients go to the source that comes first.

The quotients of all blocks are never listed. How many blocks a source has among the first N is round(target * x) for some x, and as
rounding moves the sum of S sources by S / 2 at most, x is within S / 2 blocks of N / total. So only seats in that distance are
candidates, about four a source and shard; they are ranked, and what lies below them is certain.

Which words a source gives: its documents stand one after another in an order drawn by the seed, cut into blocks; the
blocks are passed over in an order that a stride and a beginning drawn by the seed define, as often as the source's quota
asks, and the last pass ends within a block. So a source gives its quota to the word, a document at most TIMES its size,
and long documents give parts from everywhere in them.

Scale: documents become narrow rows, which are written and numbered over range partitions by source, so that a source
of any size spreads over many tasks; rows equal in all columns are told apart by a number drawn once in a written table. What the driver
gets are sums. Sources are rows of tables and may be many; they are broadcast to the documents only if counted as few.

Defined results: a null text has size 0, is in the mix with 0 words, and counts for no one; a null source is a source and comes last; null or repeated ids are ids
like any others; rows equal in all columns get the same takings as a group, in any order; an empty table gives an empty result, and a table without words a mix
of none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize, table
from quern.operators.ordering import positions

WEIGHTS = (1, 2, 3)
TIMES = 3
BLOCK = 16
SHARDS = 32
SEED = "mix"
SPACE, SPACES = " \t\n\x0b\x0c\r", "[\\x20\\x09-\\x0D]+"
#: Primes; a number of blocks that all of them divide is beyond long.
STRIDES = (999983, 999979, 999961)
#: Sources that are broadcast at most; with more, the documents meet them in a shuffled join.
BROADCAST_ROWS = 1 << 15
_BITS = 33


def _drawn(seed: str, *parts: Column) -> Column:
    """16 hexadecimal digits of a seed and texts."""
    return F.substring(F.md5(F.concat_ws(" ", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)


def sized(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words, and the document's place in its source's order: ``key``, and ``tie`` for equal rows."""
    bare = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE))
    size = F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), _drawn(seed, F.col("doc_id"), F.col("text")).alias("key"))
    return materialize(spark, rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "mix-rows")


def targeted(spark: SparkSession, rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES) -> DataFrame:
    """place (by code point, null last), source, source_size and target of each source of ``rows``, a written table."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = materialize(spark, sums.select("source", "source_size", F.lit(0).alias("all"), F.col("source").isNull().alias("unnamed")), "mix-sums")
    placed = positions(spark, sums, "all", ["unnamed", "source"], materialize).withColumnRenamed("position", "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = placed.select("place", "source", "source_size", weight.alias("weight"), (F.col("source_size") * times).alias("most"))
    sources = materialize(spark, sources, "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        at = sources.agg(F.count(F.when(above, 1)).alias("full"), F.sum(F.when(above, F.col("most"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("left")).first()
        if at["full"] == full or not at["left"]:
            break
        full, level = at["full"], (total - (at["held"] or 0)) / at["left"]
    return sources.select("place", "source", "source_size", "most", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def quotas(spark: SparkSession, sources: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """place, shard, blocks and before (blocks of earlier shards), of the mix of ``targeted`` sources."""
    row = sources.where("target > 0").agg(F.count("*").alias("n"), F.sum("source_size").alias("words"), F.sum("target").alias("total")).first()
    blocks = (2 * (row["words"] or 0) + block) // (2 * block)
    total = row["total"] or 1.0
    ends = F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")
    seats = sources.where("target > 0").select("place", "target", ends).withColumn("first", F.floor(F.col("shard").cast("long") * F.lit(blocks) / shards).cast("long"))
    share, off = F.col("target") * F.col("first") / F.lit(total), F.col("target") * F.lit(row["n"] / 2 / total)
    seats = seats.withColumns({"low": F.greatest(F.floor(share - off) - 1, F.lit(0)).cast("long"), "high": (F.floor(share + off) + 2).cast("long")})
    seats = materialize(spark, seats, "mix-seats")
    left = seats.groupBy("shard").agg((F.min("first") - F.sum("low")).alias("open"))
    asked = seats.select("shard", "place", "target", F.explode(F.sequence("low", F.col("high") - 1)).alias("i"))
    asked = materialize(spark, asked.select("shard", "place", (-F.col("target") / (2 * F.col("i") + 1)).alias("quotient")), "mix-quotients")
    ranked = positions(spark, asked, "shard", ["quotient", "place"], materialize)
    won = ranked.join(left, "shard").where("position < open").groupBy("shard", "place").agg(F.count("*").alias("won"))
    ended = seats.join(won, ["shard", "place"], "left").select("place", (F.col("shard") - 1).alias("shard"), (F.col("low") + F.coalesce("won", F.lit(0))).alias("ended"))
    earlier = F.coalesce(F.lag("ended").over(Window.partitionBy("place").orderBy("shard")), F.lit(0))
    ended = ended.withColumn("before", earlier)  # a row for each shard of a source
    return materialize(spark, ended.select("place", "shard", (F.col("ended") - F.col("before")).alias("blocks"), "before"), "mix-quotas")


def planned(spark: SparkSession, sources: DataFrame, shares: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """A row for each source: what it gives, and how its blocks are passed over."""
    got = shares.groupBy("place").agg(F.sum("blocks").alias("blocks"), F.sort_array(F.collect_list("before")).alias("befores"))  # one for each shard
    plan = sources.join(got, "place", "left").withColumn("words", F.least(F.coalesce("blocks", F.lit(0)) * block, F.col("most")))
    size, n = F.col("source_size"), F.col("n_blocks")
    plan = plan.withColumn("n_blocks", F.ceil(size / block).cast("long")).where("n_blocks > 0")
    stride = F.coalesce(*[F.when(n % p != 0, p) for p in STRIDES]).cast("long")
    begin = F.conv(F.substring(_drawn(seed, F.col("source")), 1, 8), 16, 10).cast("long") % n
    plan = plan.withColumns({"stride": stride, "begin": begin, "passes": F.floor(F.col("words") / size).cast("long"), "rest": F.col("words") % size, "tail": size - (n - 1) * block})
    plan = plan.withColumn("tail_at", ((n - 1) * F.col("stride") + F.col("begin")) % n)
    return materialize(spark, plan.select("place", "words", "n_blocks", "stride", "begin", "passes", "rest", "tail", "tail_at", "befores"), "mix-plan")


def started(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` (place, key, doc_id, size, tie, written) with ``start``: the words before it in its source's order."""
    order = ["place", "key", "doc_id", "size", "tie"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # Within a partition this counts up; the partition's number lies above.
    spread = materialize(spark, spread, "mix-order").withColumn("part", F.shiftright("at", _BITS))
    # A row for each partition and source that it holds some of.
    sums = spread.groupBy("place", "part").agg(F.sum("size").alias("held"))
    earlier = F.sum("held").over(Window.partitionBy("place").orderBy("part")) - F.col("held")
    sums = sums.select("place", "part", earlier.alias("earlier"))
    within = F.sum("size").over(Window.partitionBy("place", "part").orderBy("at")) - F.col("size")
    placed = spread.withColumn("within", within).join(sums, ["place", "part"])
    return placed.withColumn("start", F.col("within") + F.col("earlier")).drop("at", "part", "within", "earlier", "tie", "key")


def _in_block(b: Column, block: int) -> tuple[Column, Column, Column]:
    """Of a source's block: its words' place in a pass, and the document's part of it, from and to."""
    at = (b * F.col("stride") + F.col("begin")) % F.col("n_blocks")
    before = at * block - F.when(at > F.col("tail_at"), block - F.col("tail")).otherwise(0)
    length = F.when(b == F.col("n_blocks") - 1, F.col("tail")).otherwise(block)
    return before, F.greatest(F.col("start") - b * block, F.lit(0)), F.least(F.col("start") + F.col("size") - b * block, length)


def _span(block: int) -> Column:
    return F.sequence(F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long"))


def mix(
    spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = TIMES, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, sources and shards of a mix of ``docs`` (doc_id, text, source).

    Documents: doc_id, source, size, source_size, target, taken, and what ``pieces`` asks for. Sources: place, source,
    source_size, target. Shards: place, shard, blocks.
    """
    rows = sized(spark, docs, seed)
    sources = materialize(spark, targeted(spark, rows, weights, times), "mix-targets")
    shares = quotas(spark, sources, block, shards)
    plan = planned(spark, sources, shares, block, seed)
    few = sources.count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    names = small(sources.select("place", F.col("source").alias("name"), "source_size", "target"))
    placed = rows.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = started(spark, materialize(spark, placed, "mix-placed")).join(small(plan), "place", "left")

    def last_pass(got: Column, b: Column) -> Column:
        before, lo, hi = _in_block(b, block)
        return got + F.greatest(F.least(hi, F.col("rest") - before) - lo, F.lit(0))

    partly = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.aggregate(_span(block), F.lit(0).cast("long"), last_pass)).otherwise(0)
    taken = F.coalesce(F.col("passes") * F.col("size") + partly, F.lit(0)).cast("long")
    return placed.withColumn("taken", taken), sources, shares


def pieces(mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, shard, pass, start and length (words of the document) of all that a mix takes, from ``mix``'s documents."""
    each = mixed.where("taken > 0").withColumn("b", F.explode(_span(block)))
    before, lo, hi = _in_block(F.col("b"), block)
    each = each.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).withColumns({"before": before, "lo": lo, "hi": hi})
    end = F.when(F.col("pass") < F.col("passes"), F.col("hi")).otherwise(F.least("hi", F.col("rest") - F.col("before")))
    seat = F.floor((F.col("pass") * F.col("source_size") + F.col("before")) / block).cast("long")
    return each.withColumn("end", end).where("end > lo").select(
        "doc_id",
        "source",
        (F.size(F.filter("befores", lambda x: x <= seat)) - 1).alias("shard"),
        "pass",
        (F.col("b") * block + F.col("lo") - F.col("start")).alias("start"),
        (F.col("end") - F.col("lo")).alias("length"),
    )


def op12_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")
