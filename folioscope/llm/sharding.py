"""Sharding by longest processing time: equal texts stay together and shards come out near equal in bytes.

Groups of equal weight are alike to the scheduler, so the driver only sees how many groups have each weight: at most
the square root of twice the bytes of all texts, as distinct weights add up. A heap of shard loads takes the weights
from the heaviest down; a weight that many groups share is dealt in one step to the same shards that one pop after
the other would give.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import cut, ranked, table, utf8_size

SHARDS = 40
#: Bytes that a document takes besides its text.
OVERHEAD = 16


def level(loads: list[int], weight: int, count: int) -> list[int]:
    """How many of count groups of a weight each shard gets if each goes to the least-loaded shard (ties: the first).

    Those are the count smallest of all loads[i] + j * weight: a threshold found by halving, then ties in shard order.
    """
    lo, hi = min(loads), max(loads) + weight * (count // len(loads) + 2)
    below = lambda t: [max(0, -(-(t - x) // weight)) for x in loads]  # noqa: E731  starting loads under t
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= count else (lo, mid)
    got = below(lo)
    rest = count - sum(got)
    for i, x in enumerate(loads):
        if rest and (lo - x) >= 0 and (lo - x) % weight == 0:
            got[i] += 1
            rest -= 1
    return got


def schedule(weights: list[tuple[int, int]], shards: int = SHARDS) -> list[tuple[int, list[int], list[int]]]:
    """For each (weight, groups): the shards that take some, and up to which rank of the weight's groups each takes."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for weight, count in sorted(weights, reverse=True):
        got: dict[int, int] = {}
        if count <= 2 * shards:
            for _ in range(count):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + weight, i))
                got[i] = got.get(i, 0) + 1
        else:
            loads = [x for x, _ in sorted(heap, key=lambda p: p[1])]
            got = {i: n for i, n in enumerate(level(loads, weight, count)) if n}
            heap = [(x + weight * got.get(i, 0), i) for i, x in enumerate(loads)]
            heapq.heapify(heap)
        out.append((weight, list(got), np.cumsum(list(got.values())).tolist()))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): equal texts in one shard (null texts are equal to each other, not to empty ones).

    A group's weight is the bytes of all its rows. Slots number a shard's rows from 0 by id. Empty input: no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (utf8_size(text) + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("null")).alias("_key"),
    )
    rows = cut(rows, "digests")
    groups = cut(rows.groupBy("_key").agg(F.sum("size").alias("_weight")), "groups")
    weights = [(int(w), int(n)) for w, n in groups.groupBy("_weight").count().collect()]
    plan = schedule(weights, shards)
    made = pa.table(
        [pa.array([w for w, _, _ in plan], pa.int64()), pa.array([s for _, s, _ in plan], pa.list_(pa.int32())), pa.array([e for _, _, e in plan], pa.list_(pa.int64()))],
        names=["_weight", "_shards", "_ends"],
    )
    placed = ranked(groups, ["_weight"], ["_key"], "_rank").join(spark.createDataFrame(made), "_weight")
    own = F.element_at("_shards", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))) + 1)
    placed = rows.join(placed.select("_key", own.alias("shard")), "_key").drop("_key")
    return ranked(cut(placed, "placed"), ["shard"], ["doc_id", "text_crc32"], "slot").withColumnRenamed("doc_id", id_col)


def op3_longest_processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
