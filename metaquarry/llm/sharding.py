"""Sharding by longest processing time: groups of equal texts, largest first, each to the least-loaded shard.

Groups of one total size are alike to the schedule, so it runs over the distinct sizes: for each size, largest first,
a heap hands its groups to the shards with the least load (ties to the lower number). Where one size has very many
groups, the level they fill up to is found by bisection and only the rest go through the heap, with the same loads
in the end. The driver takes the distinct sizes in descending order, AT_ONCE at a time, and writes their plan before
it takes more: it holds the shards' loads and one such portion, never the groups. A group finds its shard from its
number among the groups of its size.

Defined results: a null text counts as no bytes and shares a group with empty texts; repeated rows are one group; an
empty table gives no rows; slots follow a hash of the row.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaquarry.llm.common import drop, new_path, numbered, stored

OVERHEAD = 16
#: Distinct sizes that the driver holds at once.
AT_ONCE = 20_000
PLAN = "of long, ends array<long>, to array<int>"


def schedule(sizes: list[tuple[int, int]], shards: int, loads: list[int] | None = None) -> dict[int, list[int]]:
    """For each (size, groups): how many of these groups each shard takes. Greedy, largest size first. loads: the shards' loads before; changed to those after."""
    told, loads = loads, list(loads) if loads else [0] * shards
    out = {}
    for size, count in sorted(sizes, reverse=True):
        took = [0] * shards
        left = count
        if left > 4 * shards and size > 0:
            low, high = min(loads), max(loads) + size * (left // shards + 2)
            while low < high:  # the highest level at which what begins below it is at most `left`
                mid = (low + high + 1) // 2
                if sum(max(0, -(-(mid - x) // size)) for x in loads) <= left:
                    low = mid
                else:
                    high = mid - 1
            for k, x in enumerate(loads):
                took[k] = max(0, -(-(low - x) // size))
                loads[k] += took[k] * size
            left -= sum(took)
        heap = [(x, k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            x, k = heap[0]
            took[k] += 1
            heapq.heapreplace(heap, (x + size, k))
        loads = [x for _, x in sorted((k, x) for x, k in heap)]
        out[size] = took
    if told is not None:
        told[:] = loads
    return out


def planned(spark: SparkSession, sizes: DataFrame, shards: int) -> tuple[DataFrame, str]:
    """of, ends, to: for each size (total, n) the shards that take its groups, and up to which number. Sizes come a partition at a time, in order."""
    path, loads, held = new_path(spark, "plan"), [0] * shards, []

    def write() -> None:
        rows = []
        for total, took in schedule(held, shards, loads).items():
            takers = [(k, n) for k, n in enumerate(took) if n]
            rows.append((total, list(accumulate(n for _, n in takers)), [k for k, _ in takers]))
        spark.createDataFrame(rows, PLAN).coalesce(1).write.mode("append").parquet(path)
        held.clear()

    for r in sizes.orderBy(F.desc("total")).toLocalIterator():
        held.append((r["total"], r["n"]))
        if len(held) == AT_ONCE:
            write()
    write()
    return spark.read.schema(PLAN).parquet(path), path


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim, first = stored(
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).substr(1, 40).alias("same")),
        "rows",
    )
    groups, second = stored(slim.groupBy("same").agg(F.sum("size").alias("total")), "groups")
    sizes, sizes_at = stored(groups.groupBy("total").agg(F.count("*").alias("n")), "sizes")
    plan, plan_at = planned(spark, sizes, shards)
    ranked = numbered(groups, "total", ["same"], F.col("same").substr(1, 3), "number")
    placed = ranked.join(plan, ranked["total"] == plan["of"]).select(
        F.col("same").alias("key"), F.expr("to[size(filter(ends, e -> e <= number))]").alias("shard")
    )
    rows, third = stored(slim.join(placed, slim["same"] == placed["key"]).select("doc_id", "size", "text_crc32", "same", "shard"), "placed")
    drop(spark, first, second, sizes_at, plan_at)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    slots = numbered(rows, "shard", ["row"], F.pmod(F.xxhash64("row"), F.lit(1024)), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")
