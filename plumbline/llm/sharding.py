"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import content_key
from plumbline.operators.ordered import dense_ranks
from plumbline.session import cut_lineage

#: Groups of at least 1/LARGE of a shard's mean load are scheduled one by one: at most shards * LARGE of them exist.
LARGE = 2048
#: Smaller groups are scheduled by classes of sizes that differ by at most 1/FINE.
FINE = 64


def schedule(loads: list[float], sizes: list[tuple[int, float]]) -> list[list[int]]:
    """Deal `sizes`, (count, size) in falling size, to the least-loaded shards; how many of each each shard gets.

    Many equal items go through the heap in shares: a shard takes as many as bring it level with the next shard.
    """
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for count, size in sizes:
        got = [0] * len(loads)
        while count:
            load, k = heapq.heappop(heap)
            n = 1
            if count > 4 * len(loads) and size > 0:
                n = max(1, min(count // (2 * len(loads)), int((heap[0][0] - load) / size) if heap else count))
            got[k] += n
            count -= n
            heapq.heappush(heap, (load + n * size, k))
        out.append(got)
    for load, k in heap:
        loads[k] = load
    return out


def longest_first_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of `docs`; law is `bytes`.

    Rows with equal texts stay together; a null text counts as the empty one. A row's size are the UTF-8 bytes of
    its text and 8 more. Groups in falling size go to the least-loaded shard: large ones one by one in a heap on
    the driver (their number is bounded by shards * LARGE, since each holds at least 1/LARGE of a shard), the rest by
    size classes, of which the heap sees counts only; a group's rank within its class then names its shard. Slots
    number a shard's rows in the order of doc_id (nulls first), equal ids by hash of the text; repeated rows have
    slots of their own. No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h1, h2 = content_key(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), h1.alias("h1"), h2.alias("h2"))
    rows = cut_lineage(rows, "sizes")
    groups = cut_lineage(rows.groupBy("h1", "h2").agg(F.sum("size").alias("weight")), "groups")
    total = groups.agg(F.sum("weight").alias("w")).first()["w"] or 0
    least = max(1, -(-total // (shards * LARGE)))
    large = groups.where(F.col("weight") >= least).collect()
    large.sort(key=lambda g: (-g["weight"], g["h1"], g["h2"]))
    loads = [0.0] * shards
    dealt = schedule(loads, [(1, float(g["weight"])) for g in large])
    named = spark.createDataFrame([(g["h1"], g["h2"], got.index(1)) for g, got in zip(large, dealt, strict=True)] or [(0, 0, 0)], "g1 long, g2 long, shard int")
    named = named if large else named.limit(0)
    # the class number falls with the size, so classes in rising order are sizes in falling order
    step = F.floor(F.log2(F.lit(float(least)) / F.col("weight")) * FINE).cast("int")
    small = groups.where(F.col("weight") < least).withColumn("class", step)
    small = cut_lineage(dense_ranks(small, ["class", "h1", "h2"], ["class"], "rank"), "small")
    classes = small.groupBy("class").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).orderBy("class").collect()
    quota = schedule(loads, [(c["n"], c["w"] / c["n"]) for c in classes])
    bounds = [(c["class"], np.cumsum(got).tolist()) for c, got in zip(classes, quota, strict=True)]
    table = spark.createDataFrame(bounds or [(0, [0])], "c int, upto array<long>")
    # one row for each class, at most 64 * FINE of them
    placed = small.join(F.broadcast(table), F.col("class") == F.col("c")).select(
        F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.size(F.filter("upto", lambda x: x <= F.col("rank"))).alias("shard"))
    placed = cut_lineage(placed.unionByName(named), "placed")
    out = rows.join(placed, (rows["h1"] == placed["g1"]) & (rows["h2"] == placed["g2"])).select("doc_id", "size", "text_crc32", "shard", "h1")
    out = dense_ranks(out, ["shard", "doc_id", "h1"], ["shard"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
