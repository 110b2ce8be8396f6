"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes lie on a ring of 2**62 positions. A key's home is the next virtual node clockwise. Each
shard has room for a fixed number of rows; rows that find their home full continue clockwise to the next node
whose shard has room. The rooms add up to the number of rows and differ by one at most, so the counts do too (law
``rows``), and only what overflows leaves its home.

The ring is cut into cells. Only the cells' counts reach the driver (2**20 at most); it sweeps the ring once or
twice over them and hands back, for each cell, which ranks go to which shard. Ranks are counted over range partitions.
Rows that are equal in all columns share a place on the ring, and so a cell, however many they are; a number drawn for
each row, once and for all in a written table, lets them spread over the partitions.

Defined results: a null text has size 8 and checksum 0; null or repeated ids are rows like any others; rows that
share id, size and checksum get the same slots as a group, in any order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, table
from quern.operators.ordering import positions

SHARDS = 24
VNODES = 64
GRID_BITS = 12
RING_BITS = 62
MAX_CELL_BITS = 20
ROWS_PER_CELL = 2000


def virtual_nodes(shards: int, vnodes: int = VNODES, grid_bits: int = GRID_BITS) -> list[tuple[int, int]]:
    """(grid cell, shard) of each virtual node, in ring order. A taken cell sends a node to the next free one."""
    grid = 1 << grid_bits
    if shards * vnodes > grid // 2:
        raise ValueError("too many virtual nodes for the grid")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % grid
            while at in taken:
                at = (at + 1) % grid
            taken[at] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def sweep(counts: dict[int, int], cell_bits: int, shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where each cell's rows go."""
    nodes = virtual_nodes(shards, vnodes)
    scale = cell_bits - GRID_BITS
    room = capacities(sum(counts.values()), shards)
    used = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []
    over: list[list[tuple[int, int, int]]] = [[] for _ in nodes]

    def place(node: int, cell: int, lo: int, hi: int) -> int:
        """Rows that the node's shard takes; the rest starts at the returned rank."""
        shard = nodes[node][1]
        n = min(hi - lo, room[shard] - used[shard])
        if n:
            out.append((cell, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return lo + n

    node = 0
    for cell in sorted(counts):
        while node < len(nodes) and nodes[node][0] << scale < cell:
            node += 1
        home = node % len(nodes)
        lo = place(home, cell, 0, counts[cell])
        if lo < counts[cell]:
            over[home].append((cell, lo, counts[cell]))
    carried: deque[tuple[int, int, int]] = deque()
    at = 0
    while carried or at < len(nodes):
        here = at % len(nodes)
        while carried:
            cell, lo, hi = carried.popleft()
            lo = place(here, cell, lo, hi)
            if lo < hi:
                carried.appendleft((cell, lo, hi))
                break
        if at < len(nodes):
            carried.extend(over[here])
        at += 1
    return out


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs`` (doc_id, text)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # The checksum keeps rows that share an id, or have none, apart; ``tie`` cuts groups of rows that share all.
    keys = keys.withColumn("at", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - RING_BITS))
    keys = materialize(spark, keys.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "ring-keys")
    rows = keys.count()
    cell_bits = GRID_BITS
    while cell_bits < MAX_CELL_BITS and rows >> cell_bits > ROWS_PER_CELL:
        cell_bits += 1
    keys = keys.withColumn("cell", F.shiftright("at", RING_BITS - cell_bits).cast("int"))
    counts = {r["cell"]: r["count"] for r in keys.groupBy("cell").count().collect()}
    plan = spark.createDataFrame(
        sweep(counts, cell_bits, shards, vnodes), "cell int, lo long, hi long, shard int, slot0 long"
    )
    placed = positions(spark, keys, "cell", ["at", "doc_id", "text_crc32", "size", "tie"], materialize)
    return (
        placed.withColumnRenamed("position", "rank")
        .join(F.broadcast(plan), "cell")
        .where("rank >= lo and rank < hi")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("slot0") + F.col("rank") - F.col("lo")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, table(spark, sf_dir, "documents"))
