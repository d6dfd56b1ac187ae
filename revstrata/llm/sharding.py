"""Sharding by longest-processing-time scheduling: groups that must stay together, largest first, each to the shard that has
the least so far (the lowest number among equals), through a heap.

Groups are summed in Spark; only the histogram of their sizes (size, number of groups) goes to the driver. Groups of equal size
are interchangeable, so a whole class is placed at once: the shards below the least load plus that size take one each, in the
heap's order, and this round repeats until another shard joins; the outcome is the heap's, at a cost that depends on the number
of different sizes and not on the number of groups. A class's runs are (from, to, cycle of shards); each group finds its shard
by its rank in its class, in a join on size, and documents by their group's key. Ranks are taken in two levels (counts by size
and begin of the key, then within these), so a size that most groups have is still spread over all tasks. Texts are read once.

Defined results: a null key is the key ''; a null size is 0; a group of size 0 goes to the least loaded shard as any other;
repeated rows each add their size; ties between groups are broken by key. Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _exchange as X

#: Characters of the key by which the groups of a size are split.
HEAD = 3
SHARDS = 64


def schedule(classes: list[tuple[int, int]], shards: int) -> tuple[list[tuple[int, int, int, list[int]]], list[int]]:
    """Runs (size, first rank, rank after the last, cycle) for (size, count) by falling size, and the loads."""
    heap = [(0, i) for i in range(shards)]
    runs = []
    for size, count in classes:
        if count <= 4 or size == 0:
            if size == 0:
                runs.append((0, 0, count, [heap[0][1]]))
                continue
            cycle = []
            for _ in range(count):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + size, i))
                cycle.append(i)
            runs.append((size, 0, count, cycle))
            continue
        at = 0
        while at < count:
            heap.sort()
            least = heap[0][0]
            n = next((k for k, (load, _) in enumerate(heap) if load >= least + size), shards)
            rounds = (count - at) // n if n == shards else min((count - at) // n, (heap[n][0] - least) // size)
            cycle = [i for _, i in heap[:n]]
            if rounds:
                heap[:n] = [(load + rounds * size, i) for load, i in heap[:n]]
                runs.append((size, at, at + rounds * n, cycle))
                at += rounds * n
            else:
                rest = min(n, count - at)
                heap[:rest] = [(load + size, i) for load, i in heap[:rest]]
                runs.append((size, at, at + rest, cycle[:rest]))
                at += rest
        heapq.heapify(heap)
    return runs, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def shard_groups(groups: DataFrame, shards: int = SHARDS, broadcast_rows: int = 50_000) -> DataFrame:
    """(key, size, shard) for groups of (key, size), one row each.

    The runs, each of at most `shards` numbers, are broadcast up to `broadcast_rows` of them (16 MB); beyond, both sides shuffle.
    """
    spark = groups.sparkSession
    groups = groups.select("key", "size", F.substring("key", 1, HEAD).alias("head"))
    counts = X.written(groups.groupBy("size", "head").agg(F.count("*").alias("n")), "sizes")
    classes = [(r["size"], r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()]
    runs, _ = schedule(sorted(classes, reverse=True), shards)
    table = spark.createDataFrame(runs, "__size bigint, lo bigint, hi bigint, cycle array<int>")
    before = counts.select(F.col("size").alias("__s"), F.col("head").alias("__h"), (F.sum("n").over(Window.partitionBy("size").orderBy("head")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size", "head").orderBy("key"))
    ranked = groups.withColumn("inside", inside).join(before, (F.col("size") == F.col("__s")) & (F.col("head") == F.col("__h")))
    ranked = ranked.select("key", "size", (F.col("before") + F.col("inside") - 1).alias("rank"))
    if len(runs) <= broadcast_rows:
        table = F.broadcast(table)
    placed = ranked.join(table, (F.col("size") == F.col("__size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("key", "size", F.expr("cycle[cast(pmod(rank - lo, size(cycle)) as int)]").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, shard): documents of equal text stay together; a document's size is its number of characters."""
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"))
    rows = X.written(rows, "sized")
    groups = X.written(rows.groupBy("key").agg(F.sum("size").alias("size")), "to-shard")
    return rows.select("doc_id", "key").join(shard_groups(groups, shards).select("key", "shard"), "key").select("doc_id", "shard")
