"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's id is hashed to a cell of the ring; a cell belongs to the next virtual node clockwise. A shard takes cells
until its bytes reach (1 + slack) times the mean; the cells beyond continue clockwise to the next shard with room.
A cell is what one key in 65,536 falls into; its keys go together, so it is cells that overflow and continue, not
single keys: a departure that keeps what the driver places of a fixed size.
The placing works on the ring's cells, whose number is fixed, so what the driver holds does not grow with the rows.

Defined cases: null text has no bytes (size 1); a null id hashes by its text; repeated rows get slots of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged, table

#: Cells of the ring. Fixed: the histogram that the driver places has at most so many rows.
CELLS = 1 << 16


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise."""
    point = lambda s, v: int.from_bytes(hashlib.sha256(f"shard:{s}:{v}".encode()).digest()[:8], "big") % CELLS
    return sorted((point(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def clockwise(nodes: list[tuple[int, int]]) -> list[list[int]]:
    """For each node the distinct shards that come from it on, clockwise."""
    out, order = [[]] * len(nodes), []
    for at in [*range(len(nodes)), *range(len(nodes))][::-1]:  # twice round: the end goes on at the start
        order = [nodes[at][1], *(s for s in order if s != nodes[at][1])]
        out[at] = order
    return out


def place(loads: dict[int, int], shards: int, virtual_nodes: int, slack: float) -> dict[int, int]:
    """cell -> shard. A cell goes to the first shard clockwise that it does not fill beyond (1 + slack) times the mean.

    Cells heavier than the slack come first, heaviest first, then all others in clockwise order. A cell that no shard
    has room for goes to the first shard clockwise that is not above the mean yet; there always is one.
    """
    nodes = ring(shards, virtual_nodes)
    cells, after, mean = [c for c, _ in nodes], clockwise(nodes), sum(loads.values()) / shards
    held, out = [0] * shards, {}
    for cell in sorted(loads, key=lambda c: (-loads[c] if loads[c] > slack * mean else 0, c)):
        onward = after[bisect.bisect_left(cells, cell) % len(nodes)]
        shard = next((s for s in onward if held[s] + loads[cell] <= (1 + slack) * mean), None)
        if shard is None:
            shard = next(s for s in onward if held[s] <= mean)
        held[shard] += loads[cell]
        out[cell] = shard
    return out


def shard(docs: DataFrame, shards: int = 8, virtual_nodes: int = 128, slack: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    spot = F.xxhash64(F.coalesce("doc_id", F.xxhash64("text_crc32", "size")))
    rows = staged(rows.withColumn("cell", F.pmod(spot, F.lit(CELLS)).cast("int")), "shard-rows")
    cells = rows.groupBy("cell").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")).collect()  # CELLS rows at most
    placed = place({r["cell"]: r["load"] for r in cells}, shards, virtual_nodes, slack)
    first, starts = [0] * shards, []
    for r in sorted(cells, key=lambda r: r["cell"]):
        s = placed[r["cell"]]
        starts.append((r["cell"], s, first[s]))
        first[s] += r["n"]
    plan = F.broadcast(spark.createDataFrame(starts, "cell int, shard int, first long"))  # CELLS rows at most
    inside = F.row_number().over(W.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(plan, "cell").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"))


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
